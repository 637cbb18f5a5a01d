"""Registered queries of sources, registers, names and projections: pages and documents are made of table rows and read back.

A page holds the lines of one order, of which there are seven at most, or sums by year, priority and nation; so no page
grows with the tables. ``QUERIES`` and ``ORACLES`` are those of ``parallax.plans.queries``, which these are added to.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.functions import names
from parallax.functions.expr import number
from parallax.operators import evaluate, lookup, model, quality, rates, resolve, screen, timeline
from parallax.plans import pipelines
from parallax.plans import queries as base
from parallax.plans.queries import DRAWS, FITS, RATE_SQL, RESAMPLED, SEASONS, SIDES, SPANS, STATS, SUMMED, TIERED, Read, check, cohorts, crossings, fit_sql, linked, long, loose_sql, n_rows, query, rounded, season_rows
from parallax.sources import html, pagecache, records, tables, urls
from parallax.sources.stored import new_path, stored

QUERIES, ORACLES = base.QUERIES, base.ORACLES


# Pages


def td(stat: str | Column, text: Column | str, tag: str = "td") -> Column:
    name = F.lit(stat) if isinstance(stat, str) else stat
    return F.concat(F.lit(f'<{tag} data-stat="'), name, F.lit('">'), F.lit(text) if isinstance(text, str) else text.cast("string"), F.lit(f"</{tag}>"))


def tr(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


def link(target: str, id: Column, text: Column) -> Column:
    return F.concat(F.lit(f'<a href="/register/{target}?id='), id, F.lit('">'), text, F.lit("</a>"))


def table(id: Column | str, body: Column, foot: Column | None = None) -> Column:
    name = F.lit(id) if isinstance(id, str) else id
    return F.concat(F.lit('<table id="'), name, F.lit('"><thead><tr><th data-stat="player">Player</th></tr></thead><tbody>'), body, F.lit("</tbody>"), *([F.lit("<tfoot>"), foot, F.lit("</tfoot>")] if foot is not None else []), F.lit("</table>"))


def order_lines(read: Read) -> DataFrame:
    """(o, rows, total): an order's few lines as structs (n, part, price, quantity, year), and its whole price."""
    price = long(F.floor("l_extendedprice"))
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), price.alias("price"), long(F.floor("l_quantity")).alias("quantity"), F.year("l_shipdate").alias("year"))
    return read("lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(line)).alias("rows"), F.sum(price).alias("total"))


def body(row) -> Column:
    return F.array_join(F.transform("rows", row), "")


def team_html(read: Read) -> DataFrame:
    """(page, html) of team pages: even orders bat, odd ones pitch, and half of the tables are in comments."""
    def row(r: Column) -> Column:
        part = r["part"].cast("string")
        return tr(td("player", link("player.fcgi", F.concat(F.lit("p"), part), F.concat(F.lit("Part "), part))), td("PA", F.format_number(r["price"], 0)), td("HR", r["n"]))

    lines = F.concat(body(row), F.lit('<tr class="thead"><th data-stat="player">Player</th></tr>'), tr(td("player", ""), td("PA", "")))
    foot = tr(td("player", "Team Totals"), td("PA", F.format_number("total", 0)))
    whole = table(F.when(F.col("o") % 2 == 0, "team_batting").otherwise("team_pitching"), lines, foot)
    return order_lines(read).select(F.col("o").cast("string").alias("page"), F.when(F.col("o") % 4 < 2, whole).otherwise(F.concat(F.lit("<!-- <div>"), whole, F.lit("</div> -->"))).alias("html"))


def team_sides(read: Read) -> list[DataFrame]:
    pages = team_html(read)
    return [records.team_rows(pages, side) for side in ("batting", "pitching")]


LINE_PAGES = "SELECT l_orderkey::VARCHAR AS page, CASE WHEN l_orderkey % 2 = 0 THEN 'batting' ELSE 'pitching' END AS side"


@query(f"""{LINE_PAGES}, 'p' || l_partkey AS player_register_id, false AS is_aggregate, floor(l_extendedprice)::DOUBLE AS pa, l_linenumber::DOUBLE AS hr FROM lineitem
UNION ALL {LINE_PAGES}, '', true, sum(floor(l_extendedprice))::DOUBLE, -1.0::DOUBLE FROM lineitem GROUP BY 1, 2""")
def team_pages(read: Read) -> DataFrame:
    both = [df.withColumn("side", F.lit(side)) for df, side in zip(team_sides(read), ("batting", "pitching"), strict=True)]
    rows = both[0].unionByName(both[1])
    return rows.select("page", "side", F.coalesce("player_register_id", F.lit("")).alias("player_register_id"), "is_aggregate", number(html.cell("PA")).alias("pa"), F.coalesce(number(html.cell("HR")), F.lit(-1.0)).alias("hr"))


@query("""SELECT l_orderkey::VARCHAR AS page, 'p' || l_partkey AS player_register_id, 'Part ' || l_partkey AS player, 'Part ' || l_partkey AS name_clean, '|part' AS name_strict_key, floor(l_extendedprice)::DOUBLE AS pa FROM lineitem WHERE l_orderkey % 2 = 0""")
def typed_players(read: Read) -> DataFrame:
    rows = team_sides(read)[0].filter("NOT is_aggregate").withColumn("team_bref_id", F.col("page"))
    typed = records.typed(rows, ["player", "PA"])
    return typed.select(F.col("team_bref_id").alias("page"), "player_register_id", "player", "name_clean", "name_strict_key", F.col("PA").alias("pa"))


@query("""SELECT id AS player_register_id, (least_seen // 1000000000000)::INT AS side, (least_seen % 1000000000000)::BIGINT AS page
FROM (SELECT 'p' || l_partkey AS id, min(l_orderkey % 2 * 1000000000000 + l_orderkey) AS least_seen FROM lineitem GROUP BY 1)""")
def page_player_ids(read: Read) -> DataFrame:
    batting, pitching = (df.withColumn("o", long(F.col("page"))) for df in team_sides(read))
    found = records.player_ids(batting, pitching, batting.limit(0), "o")
    return found.select("player_register_id", F.col("seen.t").alias("side"), F.col("seen.o").alias("page"))


def crawled(read: Read) -> records.Crawl:
    """A crawl of orders: seasons are years, teams priorities, players nations."""
    people = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_nationkey", "n_name")
    by = [F.year("o_orderdate").cast("string").alias("year"), F.substring("o_orderpriority", 1, 1).alias("p"), "n_nationkey", "n_name"]
    sums = read("orders").join(people, "o_custkey").groupBy(*by).agg(n_rows().alias("pa"), F.count_if(F.col("o_orderstatus") == "F").alias("hr"))
    player = link("player.fcgi", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.col("n_name"))
    born = F.concat(F.lit("1990-01-"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"))
    rows = {
        "bat": tr(td("player", player), td("PA", F.format_number("pa", 0)), td("HR", F.col("hr"))),
        "roster": tr(td("player", player), td("date_of_birth", born), td("birth_city", F.concat("n_name", F.lit(", KR")))),
    }
    joined = [F.array_join(F.array_sort(F.collect_list(r)), "").alias(n) for n, r in rows.items()]  # 25 nations
    teams = sums.groupBy("year", "p").agg(*joined, F.sum("pa").alias("pa"), F.sum("hr").alias("hr"))
    id = F.concat(F.lit("t"), "year", "p")
    team = F.concat(table("team_batting", F.col("bat"), tr(td("player", "Team Totals"), td("PA", F.col("pa")))), F.lit("<!--"), table("standard_roster", F.col("roster")), F.lit("-->"))
    listed = F.array_join(F.array_sort(F.collect_list(tr(td("team_ID", link("team.cgi", id, F.concat(F.lit("Team "), F.col("p")))), td("W", "1")))), "")  # five priorities
    years = teams.groupBy("year").agg(listed.alias("teams"), F.sum("pa").alias("pa"), F.sum("hr").alias("hr"))
    total = tr(td("team_ID", "League Totals"), td("PA", F.format_number("pa", 0)), td("HR", F.col("hr")))
    season = F.concat(table("regular_season", F.col("teams")), F.lit("<!--"), table("league_batting", tr(td("team_ID", "Team 1"), td("PA", "1")), total), F.lit("-->"))
    history = F.array_join(F.array_sort(F.collect_list(tr(td("year_ID", link("league.cgi", F.concat(F.lit("s"), "year"), F.col("year")), "th")))), "")  # the years
    index = years.agg(table("lg_history", F.concat(history, F.lit('<tr><th data-stat="year_ID">Totals</th></tr>'))).alias("html")).select(F.lit("index").alias("page"), "html")
    return records.crawl(index, years.select(F.concat(F.lit("s"), "year").alias("season_id"), season.alias("html")), teams.select(id.alias("team_bref_id"), team.alias("html")), 1995, 1998)


CRAWLED = "FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE year(o_orderdate) BETWEEN 1995 AND 1998"
TEAM = "year(o_orderdate)::INT AS season, 'Team ' || o_orderpriority[1] AS team_name, 't' || year(o_orderdate) || o_orderpriority[1] AS team_bref_id, 'n' || n_nationkey AS player_register_id"


@query(f"SELECT {TEAM}, n_name AS player, count(*)::DOUBLE AS pa, (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE AS hr {CRAWLED} GROUP BY ALL")
def crawl_players(read: Read) -> DataFrame:
    return crawled(read).batting.select("season", "team_name", "team_bref_id", "player_register_id", "player", F.col("PA").alias("pa"), F.col("HR").alias("hr"))


@query(f"SELECT DISTINCT {TEAM}, n_name || ', KR' AS birth_city, '1990-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') AS born {CRAWLED}")
def crawl_roster(read: Read) -> DataFrame:
    return crawled(read).roster.select("season", "team_name", "team_bref_id", "player_register_id", "birth_city", F.date_format("date_of_birth", "yyyy-MM-dd").alias("born"))


@query(f"SELECT year(o_orderdate)::INT AS season, 'batting' AS side, count(*)::DOUBLE AS pa, (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE AS hr {CRAWLED} GROUP BY 1")
def crawl_totals(read: Read) -> DataFrame:
    return crawled(read).league_totals.select("season", "side", F.col("PA").alias("pa"), F.col("HR").alias("hr"))


#: Columns of season tables on older and on newer pages.
OLD, NEW = ("year_ID", "team_ID", "PA", "AB", "HR"), ("year_id", "team_name_abbr", "b_pa", "b_ab", "b_hr")


@query("""SELECT l_orderkey::VARCHAR AS page, (1990 + (l_linenumber + 1) // 2)::INT AS season, 'T' || l_linenumber AS team, floor(l_quantity)::DOUBLE AS pa, l_linenumber::DOUBLE AS hr FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, (l_linenumber + 1) // 2 ORDER BY floor(l_quantity) DESC, l_linenumber) = 1""")
def player_pages(read: Read) -> DataFrame:
    """Two lines are a season, so a traded player's; odd orders' pages are of the older kind."""
    def row(kind: tuple[str, ...]):
        def cells(r: Column) -> Column:
            values = (F.floor((r["n"] + 1) / 2) + 1990, F.concat(F.lit("T"), r["n"].cast("string")), r["quantity"], r["quantity"], r["n"])
            return tr(*[td(c, v, "th" if i == 0 else "td") for i, (c, v) in enumerate(zip(kind, values, strict=True))])

        return cells

    def season_table(kind: tuple[str, ...]) -> Column:
        return table("seasons", body(row(kind)), tr(td(kind[0], "Career", "th"), *[td(c, "9999") for c in kind[2:]]))

    other = table("other", tr(td("x", "1")))
    pages = order_lines(read).select(F.col("o").cast("string").alias("page"), F.concat(other, F.when(F.col("o") % 2 == 0, season_table(NEW)).otherwise(season_table(OLD))).alias("html"))
    return records.page_seasons(pages, "batting").select("page", "season", "team", F.col("PA").alias("pa"), F.col("HR").alias("hr"))


@query("SELECT o_orderkey AS page, CASE WHEN o_orderstatus = 'P' THEN 'no page' ELSE 'no season table' END AS error FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW'")
def page_failures(read: Read) -> DataFrame:
    good = table("s", tr(*[td(c, v) for c, v in zip(NEW, ("1999", "T1", "10", "9", "1"), strict=True)]))
    pages = read("orders").select(F.col("o_orderkey").alias("page"), F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_orderpriority") == "5-LOW", "<p>none</p>").otherwise(good)).alias("html"))
    return records.failed_pages(pages, records.page_seasons(pages, "batting"))


@query("SELECT year(o_orderdate)::BIGINT AS season, 'batting' AS side, count(*)::DOUBLE AS pa, (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE AS hr FROM orders GROUP BY 1")
def page_totals(read: Read) -> DataFrame:
    """A league page for each year, with a team for each priority and a row that sums them."""
    sums = read("orders").groupBy(long(F.year("o_orderdate")).alias("season"), "o_orderpriority").agg(n_rows().alias("pa"), F.count_if(F.col("o_orderstatus") == "F").alias("hr"))
    row = tr(td(NEW[1], F.col("o_orderpriority")), td(NEW[2], F.col("pa")), td(NEW[3], F.col("pa")), td(NEW[4], F.col("hr")))
    total = tr(td(NEW[1], "League Average"), td(NEW[2], "9999"), td(NEW[3], "9999"), td(NEW[4], "9999"))
    pages = sums.groupBy("season").agg(F.concat(table("other", tr(td("x", "1"))), table("teams", F.array_join(F.collect_list(row), ""), total)).alias("html"))
    return records.page_league_totals(pages, "batting").select("season", "side", F.col("PA").alias("pa"), F.col("HR").alias("hr"))


# JSON documents


def documents(read: Read, stat) -> DataFrame:
    """(o, body): an order's lines as splits; the sixth is of another sport, the seventh of another kind of game."""
    def split(r: Column) -> Column:
        return F.struct(
            r["year"].cast("string").alias("season"), F.when(r["n"] == 7, "S").otherwise("R").alias("gameType"), F.struct(F.when(r["n"] == 6, 11).otherwise(1).alias("id")).alias("sport"),
            F.struct(F.concat(F.lit("T"), r["n"].cast("string")).alias("name")).alias("team"), stat(r).alias("stat"),
        )

    return order_lines(read).select("o", F.to_json(F.struct(F.array(F.struct(F.transform("rows", split).alias("splits"))).alias("stats"))).alias("body"))


def batting_stat(r: Column) -> Column:
    return F.struct(r["quantity"].alias("plateAppearances"), r["n"].alias("homeRuns"), (r["part"] % 15 + 20).alias("age"))


MAJOR_LINES = "FROM lineitem WHERE l_linenumber NOT IN (6, 7)"


@query(f"SELECT l_orderkey AS o, year(l_shipdate)::INT AS season, floor(l_quantity)::DOUBLE AS pa, l_linenumber::DOUBLE AS hr, (l_partkey % 15 + 20)::DOUBLE AS age, 'T' || l_linenumber AS team {MAJOR_LINES}")
def json_splits(read: Read) -> DataFrame:
    return records.json_splits(documents(read, batting_stat), "batting").select("o", "season", F.col("PA").alias("pa"), F.col("HR").alias("hr"), "age", "team")


@query(f"SELECT l_orderkey AS o, year(l_shipdate)::INT AS season, sum(floor(l_quantity))::DOUBLE AS pa, sum(l_linenumber)::DOUBLE AS hr, max(l_partkey % 15 + 20)::DOUBLE AS age {MAJOR_LINES} GROUP BY 1, 2")
def json_player_seasons(read: Read) -> DataFrame:
    found = records.player_seasons(documents(read, batting_stat), "batting", "o")
    return found.select("o", "season", F.col("PA").alias("pa"), F.col("HR").alias("hr"), "age")


@query(f"SELECT season, 'pitching' AS side, round(floor(outs / 3) + (outs % 3) / 10, 1) AS ip, so FROM (SELECT year(l_shipdate)::INT AS season, sum(floor(l_quantity) * 3 + l_linenumber % 3) AS outs, sum(l_linenumber)::DOUBLE AS so {MAJOR_LINES} GROUP BY 1)")
def json_league_totals(read: Read) -> DataFrame:
    def stat(r: Column) -> Column:
        return F.struct(F.concat_ws(".", r["quantity"].cast("string"), (r["n"] % 3).cast("string")).alias("inningsPitched"), r["n"].alias("strikeOuts"))

    return records.json_league_totals(documents(read, stat), "pitching").select("season", "side", F.round("IP", 1).alias("ip"), F.col("SO").alias("so"))


SITE = urls.Sites()


@query(f"""SELECT c_custkey, '{SITE.pages}/register/league.cgi?id=s' || c_custkey AS season, '{SITE.pages}/register/team.cgi?id=t' || c_custkey AS team, '{SITE.pages}/players/' || lower(c_mktsegment[1]) || '/' || lower(c_mktsegment[1]) || c_custkey || '.shtml' AS player,
    '{SITE.documents}/people/' || c_custkey || '/stats?stats=yearByYear&group=hitting' AS stats, substr(sha256('{SITE.pages}/register/team.cgi?id=t' || c_custkey), 1, 20) || '.html' AS page FROM customer""")
def addresses(read: Read) -> DataFrame:
    id = F.col("c_custkey").cast("string")
    team = SITE.team(F.concat(F.lit("t"), id))
    return read("customer").select("c_custkey", SITE.season(F.concat(F.lit("s"), id)).alias("season"), team.alias("team"), SITE.player(F.concat(F.lower(F.substring("c_mktsegment", 1, 1)), id)).alias("player"), SITE.player_stats(F.col("c_custkey"), "batting").alias("stats"), urls.page_key(team).alias("page"))


# Files: shards, records that are set apart, order, cached pages


BAD = "c_custkey % 50 = 7"


def sharded(read: Read) -> list[str]:
    """Folders of CSV files with the customers, of three headers; every fiftieth record lacks a cell or has one too many."""
    key, name, money = F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_acctbal").cast("string")
    headers = (("id", "name", "balance"), ("balance", "id", "other", "name"), ("id", "name"))
    cells = ((key, name, money), (money, key, F.lit("x"), name), (key, name))
    folder, paths = new_path(read("customer").sparkSession, "shards"), []
    for i, (header, own) in enumerate(zip(headers, cells, strict=True)):
        line = F.when(F.expr(BAD) & (F.col("c_custkey") % 100 == 7), F.concat_ws(",", *own, F.lit("more"))).when(F.expr(BAD), F.concat_ws(",", *own[:-1])).otherwise(F.concat_ws(",", *own))
        lines = read("customer").filter(F.col("c_custkey") % 3 == i).select(line.alias("value"))
        text = lines.mapInArrow(with_header(",".join(header)), "value string")  # a file for each task, as other tools write them
        text.write.text(f"{folder}/{i}")
        paths.append(f"{folder}/{i}")
    return paths


def with_header(header: str):
    def run(batches):
        for at, batch in enumerate(batches):
            yield batch if at else pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([header]), batch.column(0)])], schema=batch.schema)

    return run


SHARD = "id long, name string, balance double, missing int"


@query(f"SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 <> 2 THEN round(c_acctbal, 2) END AS balance, c_custkey % 3 AS shard FROM customer WHERE NOT {BAD}")
def sharded_rows(read: Read) -> DataFrame:
    rows, _ = tables.read_csv_apart(read("customer").sparkSession, sharded(read), SHARD)
    return rows.select("id", "name", F.round("balance", 2).alias("balance"), (F.col("id") % 3).alias("shard"))


@query(f"SELECT c_custkey % 3 AS shard, CASE WHEN c_custkey % 100 = 7 THEN 'more' ELSE 'fewer' END AS kind, (c_custkey % 3 = 0)::INT * 3 + (c_custkey % 3 = 1)::INT * 4 + (c_custkey % 3 = 2)::INT * 2 AS n_cells, count(*) AS n FROM customer WHERE {BAD} GROUP BY ALL")
def rejected_records(read: Read) -> DataFrame:
    _, bad = tables.read_csv_apart(read("customer").sparkSession, sharded(read), SHARD)
    shard = F.when(F.col("n_cells") == 3, 0).when(F.col("n_cells") == 4, 1).otherwise(2).cast("long")
    return bad.groupBy(shard.alias("shard"), F.when(F.endswith("record", F.lit(",more")), "more").otherwise("fewer").alias("kind"), "n_cells").agg(n_rows().alias("n"))


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def last_in_file(read: Read) -> DataFrame:
    """The last row in the file of each user and type: events lie in it by their number."""
    events = tables.with_ordinal(read("events")).withColumn("k", F.struct("user_id", "event_type"))
    return timeline.latest(events, "k", F.desc("ordinal")).select("user_id", "event_type", "event_id")


@query("SELECT 'http://x.test/customer/' || c_custkey AS url, '<p>' || c_name || '</p>' AS html, '' AS error FROM customer WHERE c_custkey BETWEEN 1 AND 40 UNION ALL SELECT 'http://x.test/customer/none', '', 'not in the cache, and offline'")
def cached_pages(read: Read) -> DataFrame:
    """Every customer's page is cached, and only those that the filter names are opened."""
    spark = read("customer").sparkSession
    address = F.concat(F.lit("http://x.test/customer/"), F.col("c_custkey").cast("string"))
    folder = new_path(spark, "pages")
    pagecache.write_cache(read("customer").select(address.alias("url"), F.concat(F.lit("<p>"), "c_name", F.lit("</p>")).alias("html")), folder)
    wanted = [f"http://x.test/customer/{i}" for i in (*range(1, 41), "none")]
    return pagecache.read_cache(spark, folder).filter(F.col("url").isin(*wanted)).select("url", *[F.coalesce(c, F.lit("")).alias(c) for c in ("html", "error")])


@query("SELECT DISTINCT l_orderkey AS o, CASE l_orderkey % 11 WHEN 3 THEN 'no json' WHEN 5 THEN 'no document' ELSE 'no splits' END AS error FROM lineitem WHERE l_orderkey % 11 IN (3, 5, 7)")
def json_failures(read: Read) -> DataFrame:
    """Bodies that are cut off, null or empty."""
    made = documents(read, batting_stat)
    k = F.col("o") % 11
    body = F.when(k == 3, F.expr("substring(body, 1, length(body) - 5)")).when(k == 7, F.lit('{"stats": []}')).when(k != 5, F.col("body"))
    return records.json_failures(made.select("o", body.alias("body")))


# Registers and names


@query("""SELECT c_custkey, trim(coalesce(nullif(c_mktsegment, 'BUILDING') || ' ', '') || c_name) AS name, coalesce(strftime(try_cast(printf('1990-%02d-%02d', c_custkey % 14, c_custkey % 33) AS DATE), '%Y-%m-%d'), '') AS born
FROM customer WHERE c_custkey % 3 > 0""")
def register_people(read: Read) -> DataFrame:
    parts = {"name_first": F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), "name_last": F.col("c_name"), "birth_year": F.lit("1990"), "birth_month": (F.col("c_custkey") % 14).cast("string"), "birth_day": (F.col("c_custkey") % 33).cast("string"), "mlb_played_first": F.nullif(F.col("c_custkey") % 3, F.lit(0))}
    register = read("customer").select("c_custkey", *[c.alias(n) for n, c in parts.items()])
    return records.people(records.played(register)).select("c_custkey", "name", F.coalesce(F.date_format("date_of_birth", "yyyy-MM-dd"), F.lit("")).alias("born"))


#: Surnames of the table with their classes, one that is not in it, and given names, one of them a weak surname.
SPELLED = (("Lee", "LEE"), ("Gim", "KIM"), ("Pak", "PARK"), ("Choe", "CHOI"), ("Kwon", "KWON"), ("Yun", "YOON"), ("Smith", ""))
FIRST, SECOND = ("Hyo", "Byeol", "Geun", "Tae"), ("Seop", "Myeong", "Min")
PLACES = ("Seoul, KR", "Nagoya, JP", "nan", "", "Boston, US")
SPELLED_SQL = f"""(SELECT c_custkey, {[s for s, _ in SPELLED]}[c_custkey % 7 + 1] AS s, {[c for _, c in SPELLED]}[c_custkey % 7 + 1] AS tag, {list(FIRST)}[c_custkey // 7 % 4 + 1] AS a, {list(SECOND)}[c_custkey // 28 % 3 + 1] AS b, {list(PLACES)}[c_custkey % 5 + 1] AS place FROM customer)"""
# Without a surname all parts are given names, but a lone weak spelling is taken as the surname.
CLASSED_SQL = f"(SELECT *, CASE WHEN tag = '' AND b = 'Min' THEN 'MIN' ELSE tag END AS class, CASE WHEN tag <> '' THEN [a, b] WHEN b = 'Min' THEN [a, s] ELSE [a, b, s] END AS given FROM {SPELLED_SQL})"


def spelled(read: Read) -> DataFrame:
    """Names of every form: given name first, surname first with a comma, hyphenated, with a suffix."""
    def pick(values: tuple[str, ...], at: str) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.expr(at).cast("int"))

    s, a, b = pick(tuple(s for s, _ in SPELLED), "c_custkey % 7"), pick(FIRST, "c_custkey div 7 % 4"), pick(SECOND, "c_custkey div 28 % 3")
    form = F.col("c_custkey") % 4
    name = F.when(form == 0, F.concat_ws(" ", a, b, s)).when(form == 1, F.concat(s, F.lit(", "), a, F.lit(" "), b)).when(form == 2, F.concat(a, F.lit(" "), b, F.lit(" "), s, F.lit(" Jr.*"))).otherwise(F.concat(a, F.lit("'  "), b, F.lit(" "), s, F.lit(" (note)")))
    return read("customer").select("c_custkey", name.alias("name"), pick(PLACES, "c_custkey % 5").alias("place"))


@query(f"""SELECT c_custkey, class || '|' || list_aggregate(list_sort([lower(g) for g in given]), 'string_agg', '') AS strict_key, class || '|' || list_aggregate(list_sort([{loose_sql('lower(g)')} for g in given]), 'string_agg', '') AS loose_key, class <> '' AS is_korean FROM {CLASSED_SQL}""")
def surname_keys(read: Read) -> DataFrame:
    keyed = spelled(read).withColumn("k", names.keys("name"))
    return keyed.select("c_custkey", F.col("k.strict").alias("strict_key"), F.col("k.loose").alias("loose_key"), F.col("k.is_korean").alias("is_korean"))


@query(f"""SELECT c_custkey, place = 'Seoul, KR' OR class <> '' AS korean,
    CASE WHEN place = 'Seoul, KR' THEN 'birthplace' WHEN class <> '' AND place NOT IN ('', 'nan') THEN 'name (born abroad)' WHEN class <> '' THEN 'name' WHEN place NOT IN ('', 'nan') THEN 'birthplace' ELSE 'name' END AS source FROM {CLASSED_SQL}""")
def nationalities(read: Read) -> DataFrame:
    korean, source = names.nationality(names.keys("name", "is_korean")["is_korean"], F.nullif(F.col("place"), F.lit("")))
    return spelled(read).select("c_custkey", korean.alias("korean"), source.alias("source"))


@query(f"SELECT c_custkey, class AS surname FROM {CLASSED_SQL}")
def surname_spellings(read: Read) -> DataFrame:
    return spelled(read).select("c_custkey", F.coalesce(names.keys("name", "surname")["surname"], F.lit("")).alias("surname"))


SYLLABLE_SQL = f"{names.INITIALS}[({{0}} // 588) + 1] || {names.MEDIALS}[({{0}} // 28) % 21 + 1] || {names.FINALS}[{{0}} % 28 + 1]"
TWO_SYLLABLES = "(SELECT p_partkey, p_partkey * 7919 % 11172 AS a, p_partkey * 104729 % 11172 AS b FROM part)"


@query(f"SELECT p_partkey, chr((44032 + a)::INT) || chr((44032 + b)::INT) AS said, {SYLLABLE_SQL.format('a')} || ' ' || {SYLLABLE_SQL.format('b')} AS roman FROM {TWO_SYLLABLES}")
def romanized_syllables(read: Read) -> DataFrame:
    """Two syllables for each part, of all that there are."""
    def syllable(factor: int) -> Column:
        return F.decode(F.unhex(F.hex(F.col("p_partkey") * factor % 11172 + names.FIRST)), "UTF-16BE")

    rows = read("part").select("p_partkey", F.concat(syllable(7919), syllable(104729)).alias("said"))
    return rows.select("p_partkey", "said", names.romanized(F.col("said")).alias("roman"))


@query("SELECT c_custkey, strftime(try_cast(born AS DATE), '%Y-%m-%d') AS born, coalesce(year(try_cast(born AS DATE)), 0)::INT AS birth_year FROM (SELECT c_custkey, printf('19%02d-%02d-%02d', c_custkey % 90 + 10, c_custkey % 13, c_custkey % 32) AS born FROM customer)")
def births(read: Read) -> DataFrame:
    """Dates of birth as match keys; impossible ones are null."""
    k = F.col("c_custkey")
    rows = read("customer").select("c_custkey", "c_name", F.format_string("19%02d-%02d-%02d", k % 90 + 10, k % 13, k % 32).alias("born"))
    return resolve.prepared(rows, "c_name", "born", "home", "c_custkey").select("c_custkey", F.date_format("_dob", "yyyy-MM-dd").alias("born"), F.coalesce("_birth_year", F.lit(0)).alias("birth_year"))


def by_supplier(sql: str) -> str:
    return sql.replace("c_custkey", "s_suppkey").replace("FROM customer", "FROM supplier")


LOOSE_SQL = f"class || '|' || list_aggregate(list_sort([{loose_sql('lower(g)')} for g in given]), 'string_agg', '')"


@query(f"""SELECT s_suppkey, k AS loose_key, n AS players, first AS first_player FROM (SELECT s_suppkey, {LOOSE_SQL} AS k FROM {by_supplier(CLASSED_SQL)})
JOIN (SELECT {LOOSE_SQL} AS k, count(*) AS n, min(c_custkey) AS first FROM {CLASSED_SQL} GROUP BY 1) USING (k)""")
def typed_names(read: Read) -> DataFrame:
    """Suppliers' names looked up among customers' names, which are stored by their sound."""
    index = lookup.name_index(spelled(read), "name", 8)
    known = index.groupBy("loose_key").agg(n_rows().alias("players"), F.min("c_custkey").alias("first_player"))
    typed = spelled(lambda _: read("supplier").select(F.col("s_suppkey").alias("c_custkey"))).select(F.col("c_custkey").alias("s_suppkey"), F.col("name").alias("typed"))
    return lookup.find(known, typed).select("s_suppkey", "loose_key", "players", "first_player")


#: Suppliers as players: names, places and teams by number; two seasons of three count, and five make a free agent here.
SEASON = 1997
ROSTER_SQL = f"""WITH lg AS (SELECT season, {', '.join(f"{RATE_SQL['batting'][s]} AS lg_{s}" for s in ('obp', 'slg'))} FROM {SUMMED}),
own AS (SELECT l_suppkey, season, PA, {', '.join(f"{RATE_SQL['batting'][s]} AS {s}" for s in ('obp', 'slg'))} FROM {SEASONS}),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY season DESC) AS k FROM own JOIN lg USING (season)),
score AS (SELECT l_suppkey, sum((obp + slg) * PA) / sum((lg_obp + lg_slg) * PA) AS score FROM r WHERE k <= 2 GROUP BY 1),
bar AS (SELECT quantile_cont(round(s, 3), 0.25) AS threshold FROM (SELECT l_suppkey, sum((obp + slg) * PA) / sum((lg_obp + lg_slg) * PA) AS s FROM r WHERE l_suppkey % 3 = 0 GROUP BY 1)),
who AS (SELECT s_suppkey, place = 'Seoul, KR' OR class <> '' AS korean FROM {by_supplier(CLASSED_SQL)}),
p AS (SELECT l_suppkey, 'T' || l_suppkey % 5 AS team_name, s::INT AS seasons, score, {SEASON} + greatest(0, 7 - s) AS earliest_posting_season FROM (SELECT l_suppkey FROM own WHERE season = {SEASON}) JOIN (SELECT l_suppkey, count(DISTINCT season) AS s FROM own WHERE (l_suppkey + season) % 3 <> 0 GROUP BY 1) USING (l_suppkey)
    JOIN score USING (l_suppkey) JOIN who ON s_suppkey = l_suppkey CROSS JOIN bar WHERE korean AND s < 5 AND score >= threshold)"""


@query(f"""{ROSTER_SQL} SELECT l_suppkey::VARCHAR AS player_register_id, team_name, seasons, round(score, 5) AS score, earliest_posting_season::INT AS earliest_posting_season, count(*) OVER (PARTITION BY team_name, earliest_posting_season) AS club_eligible_that_year,
    count(*) OVER (PARTITION BY team_name, earliest_posting_season) > 1 AS posting_likely_delayed FROM p""")
def season_roster(read: Read) -> DataFrame:
    """The roster of a season with all its filters, screen and congestion, of suppliers."""
    rows = season_rows(read)
    league = rates.league_rates(rows.drop("l_suppkey"), "batting")
    people = spelled(lambda _: read("supplier").select(F.col("s_suppkey").alias("c_custkey"))).select(F.col("c_custkey").alias("l_suppkey"), F.col("name").alias("player"), F.nullif(F.col("place"), F.lit("")).alias("birth_city"))
    named = rates.relative_rates(rows, league, "batting").join(people, "l_suppkey")
    id = F.col("l_suppkey").cast("string").alias("player_register_id")
    home = named.select("*", id, F.concat(F.lit("T"), (F.col("l_suppkey") % 5).cast("string")).alias("team_name"), F.lit(25.0).alias("age"))
    profile = screen.score(home.filter(F.col("l_suppkey") % 3 == 0), "batting", ["player_register_id"]).withColumn("score", F.round("score", 3))
    served = home.filter((F.col("l_suppkey") + F.col("season")) % 3 != 0)
    bundle = pipelines.Bundle("batting", SEASON, home, served, league, None, None, profile, people.select(id, "birth_city"), fa_seasons=5)
    return bundle.roster().select("player_register_id", "team_name", "seasons", F.round("score", 5).alias("score"), "earliest_posting_season", "club_eligible_that_year", "posting_likely_delayed")


@query("""WITH own AS (SELECT o_custkey, year(o_orderdate)::INT AS season, count(*)::DOUBLE AS pa, avg(o_totalprice) / 500000 AS obp, max(o_totalprice) / 500000 AS slg FROM orders GROUP BY 1, 2),
lg AS (SELECT year(o_orderdate)::INT AS season, avg(o_totalprice) / 500000 AS lg FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY season DESC) AS k FROM own JOIN lg USING (season) WHERE o_custkey % 3 > 0 AND season < 1996 + o_custkey % 3)
SELECT o_custkey::VARCHAR AS player_register_id, any_value(c_name) AS player, (1996 + o_custkey % 3)::INT AS first_mlb, round_even(sum((obp + slg) * pa) / sum(2 * lg * pa), 3) AS score, (max(season) - 1970)::DOUBLE AS age_last_kbo
FROM r JOIN customer ON c_custkey = o_custkey WHERE k <= 2 AND o_custkey % 2 = 0 GROUP BY o_custkey""")
def screen_profile(read: Read) -> DataFrame:
    """The profile of customers who crossed in 1997 or 1998, by their last two years before; odd ones are no Koreans here."""
    year, price = F.year("o_orderdate").alias("season"), F.col("o_totalprice") / 500000
    own = read("orders").groupBy("o_custkey", year).agg(n_rows().cast("double").alias("PA"), F.avg(price).alias("obp"), F.max(price).alias("slg"))
    league = read("orders").groupBy(year).agg(F.avg(price).alias("lg_obp"), F.avg(price).alias("lg_slg"))
    people = read("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("player"))
    home = own.join(league, "season").join(people, "o_custkey").select("*", F.col("o_custkey").cast("string").alias("player_register_id"), (F.col("season") - 1970).alias("age"))
    posted = read("customer").select(F.col("c_custkey").cast("string").alias("player_register_id"), F.when(F.col("c_custkey") % 3 > 0, 1996 + F.col("c_custkey") % 3).alias("first_mlb"))
    return screen.profile(home, posted, "batting", lambda name, key: key.cast("long") % 2 == 0)


# Cohorts and checks


@query(f"SELECT c_custkey AS o_custkey, c_mktsegment, coalesce(cohort, 'unknown') AS cohort, coalesce(n_kbo, 0) AS n_kbo, coalesce(n_mlb, 0) AS n_mlb FROM customer LEFT JOIN ({SPANS}) ON o_custkey = c_custkey")
def attached_cohorts(read: Read) -> DataFrame:
    people = read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return timeline.attach(people, cohorts(read), "o_custkey").select("o_custkey", "c_mktsegment", "cohort", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_kbo", "n_mlb")])


@query(f"""{TIERED}, z AS (SELECT (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM customer) AS people)
SELECT 'orders.non_empty' AS name, n > 0 AS passed, 'error' AS severity, CASE WHEN n > 0 THEN 0 ELSE 1 END::BIGINT AS n_bad, CASE WHEN n > 0 THEN 'rows present' ELSE 'no rows' END AS message FROM (SELECT count(*) AS n FROM orders)
UNION ALL SELECT 'orders.required_columns', false, 'error', 1, 'missing columns: [''wins'']'
UNION ALL {check("crosswalk.uniqueness", "k > 1", "(SELECT count(*) AS k FROM m GROUP BY c_custkey)", "each player links to at most one record", "players link to several records")}
UNION ALL SELECT 'crosswalk.size', matched >= 50 AND matched <= 0.75 * people, CASE WHEN matched < 50 OR matched > 0.75 * people THEN 'error' ELSE 'info' END, 0,
    CASE WHEN matched < 50 THEN printf('only %d players linked', matched) WHEN matched > 0.75 * people THEN printf('%.1f%% of players linked, implausibly many', 100.0 * matched / people) ELSE printf('%d players linked (%.1f%%)', matched, 100.0 * matched / people) END FROM z""")
def link_checks(read: Read) -> DataFrame:
    left, matches, _ = linked(read)
    size = matches.agg(n_rows().alias("matched")).crossJoin(left.agg(n_rows().alias("kbo_players")))  # one row each
    return quality.audit([quality.non_empty(read("orders"), "orders"), quality.required_columns(read("orders"), ("o_orderkey", "wins"), "orders"), quality.crosswalk_uniqueness(matches, "c_custkey"), quality.crosswalk_size(size)])


# Models


SUMMARY = ("b1 AS retention_slope", "b0 AS intercept", "exp(b0) AS level_ratio", "b2 AS age_coef", "b3 AS direction_coef", "sd AS residual_sd", "r2 AS r_squared")


@query(f"SELECT stat, {', '.join('round_even({}, 3) AS {}'.format(*s.split(' AS ')) for s in SUMMARY)}, n::BIGINT AS n_pairs, players AS n_players FROM {FITS}")
def fit_summary(read: Read) -> DataFrame:
    return model.summary(model.fit(model.design(crossings(read), STATS)))


#: Refits by ``DRAWS`` draws of a congruence, with noise of their deviation by another, in place of random numbers.
NOISY = f"(SELECT split_part(which, ':', 1) AS stat, split_part(which, ':', 2)::INT AS draw, b0, b1, b2, b3, sd * ((split_part(which, ':', 2)::INT * 37) % 11 - 5) / 5.0 AS noise FROM {fit_sql(RESAMPLED, 'which')})"


def noisy(read: Read) -> DataFrame:
    rows = stored(model.design(crossings(read), STATS), "design")
    drawn = model.bootstrap(rows, DRAWS, drawn=base.draws_by_congruence(rows))
    return drawn.withColumn("noise", F.col("sd") * ((F.col("draw") * 37) % 11 - 5) / 5.0)


CENTRE = "b0 + b1 * ln(rate) + b2 * (age - 27) / 10 + b3"


@query(f"""SELECT p_partkey, stat, round(exp(avg({CENTRE})), 4) AS point, {', '.join(f'round(quantile_cont(exp({CENTRE} + noise), {q}), 4) AS p{round(q * 100)}' for q in model.LEVELS)}, count(*) AS n_draws
FROM (SELECT p_partkey, p_size / 25.0 AS rate, p_partkey % 20 + 20.0 AS age FROM part WHERE p_size > 0), {NOISY} GROUP BY 1, 2""")
def prediction_intervals(read: Read) -> DataFrame:
    stats = F.explode(F.array(*map(F.lit, STATS)))
    cases = read("part").filter("p_size > 0").select("p_partkey", stats.alias("stat"), (F.col("p_size") / 25.0).alias("rate"), (F.col("p_partkey") % 20 + 20.0).alias("age"))
    return rounded(model.intervals(cases, noisy(read), "p_partkey"), 4, "point", "p10", "p25", "p50", "p75", "p90")


def rate_columns(prefix: str) -> str:
    return ", ".join(f"{RATE_SQL['batting'][s]} AS {prefix}{s}" for s in STATS)


PROJECTED = f"""WITH lg AS (SELECT season, {rate_columns('lg_')} FROM {SUMMED}), own AS (SELECT l_suppkey, season, PA, {rate_columns('')} FROM {SEASONS}),
r AS (SELECT l_suppkey, season, PA::DOUBLE AS w, {', '.join(f'CASE WHEN lg_{s} > 0 THEN {s} / lg_{s} END AS {s}' for s in STATS)} FROM own JOIN lg USING (season) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY season DESC) <= 3),
k AS (SELECT l_suppkey, (max(season) + l_suppkey % 17 - 1972)::DOUBLE AS age, {', '.join(f'sum(w * {s}) FILTER ({s} > 0) / sum(w) FILTER ({s} > 0) AS {s}' for s in STATS)} FROM r GROUP BY 1),
c AS ({' UNION ALL '.join(f"SELECT l_suppkey, age, '{s}' AS stat, {s} AS rate, (SELECT arg_max(lg_{s}, season) FROM lg) AS l FROM k WHERE {s} > 0" for s in STATS)}),
d AS (SELECT l_suppkey, stat, any_value(age) AS age, any_value(rate) AS rate, any_value(l) AS l, exp(avg({CENTRE})) AS point, quantile_cont(exp({CENTRE} + noise), 0.1) AS p10, quantile_cont(exp({CENTRE} + noise), 0.9) AS p90 FROM c JOIN {NOISY} USING (stat) GROUP BY 1, 2)"""


@query(f"""{PROJECTED} SELECT l_suppkey, stat, age, round_even(rate, 3) AS kbo_relative, round_even(point, 3) AS proj_mlb_relative, round_even(p10, 3) AS p10_relative, round_even(p90, 3) AS p90_relative,
    round_even(l, 4) AS mlb_league_rate, round_even(point * l, 4) AS proj_mlb_rate, round_even(p10 * l, 4) AS p10_rate, round_even(p90 * l, 4) AS p90_rate FROM d""")
def projection(read: Read) -> DataFrame:
    """Suppliers' last three seasons, weighted by playing time, through fits of other crossings."""
    seasons = season_rows(read)
    league = rates.league_rates(seasons.drop("l_suppkey"), "batting")
    rows = rates.relative_rates(seasons, league, "batting").withColumn("age", (F.col("season") + F.col("l_suppkey") % 17 - 1972).cast("double"))
    return evaluate.project(rows, noisy(read), league, "batting", STATS, "l_suppkey")
