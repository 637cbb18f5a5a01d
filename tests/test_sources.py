import gzip
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from parallax.operators import timeline
from parallax.sources import fetch, html, pagecache, records, tables

TEAM = """
<html><body><table id="team_batting"><thead><tr><th data-stat="player">Player</th></tr></thead><tbody>
<tr><td data-stat="player"><a href="/register/player.fcgi?id=nam---001dae">Dae Sol Nam*</a></td><td data-stat="age">25</td><td data-stat="PA">1,204</td><td data-stat="HR">10</td></tr>
<tr class="thead"><th data-stat="player">Player</th></tr>
<tr><td data-stat="player"></td><td data-stat="PA"></td></tr>
<tr><td data-stat="player"><a href='/register/player.fcgi?id=oh----004gon'>Gon&nbsp;Woo Oh</a></td><td data-stat="PA">inf</td></tr></tbody>
<tfoot><tr><td data-stat="player">Team Totals</td><td data-stat="PA">1619</td></tr></tfoot></table>
<!-- <div><table id="team_pitching"><tbody><tr><td data-stat="player"><a href="player.fcgi?id=baek--002sol">Baek</a></td><td data-stat="IP">96.2</td><td data-stat="batters_faced">415</td></tr></tbody></table></div> -->
<!-- <table id="team_batting"><tbody><tr><td data-stat="player">Copy</td></tr></tbody></table> -->
<!-- <table id="standard_roster"><tbody><tr><td data-stat="player"><a href="player.fcgi?id=nam---001dae">Dae Sol Nam</a></td><td data-stat="date_of_birth">1993-04-11</td><td data-stat="birth_city">Osaka, JP</td></tr></tbody></table> -->
</body></html>"""
INDEX = """<table id="lg_history"><tbody><tr><th data-stat="year_ID"><a href="league.cgi?id=s2024">2024</a></th></tr><tr><th data-stat="year_ID">Totals</th></tr><tr><th data-stat="year_ID"><a href="league.cgi?id=s2010">2010</a></th></tr></tbody></table>"""
SEASON = """<table id="regular_season"><tbody><tr><td data-stat="team_ID"><a href="team.cgi?id=t1">Comets</a></td><td data-stat="W">80</td></tr></tbody></table>
<table id="league_batting"><tbody><tr><td data-stat="team_ID">Comets</td><td data-stat="PA">1</td></tr></tbody><tfoot><tr><td data-stat="team_ID">League Totals</td><td data-stat="PA">48,112</td><td data-stat="HR">977</td></tr></tfoot></table>"""
PLAYER = """<table id="other"><tbody><tr><td data-stat="x">1</td></tr></tbody></table>
<table id="b"><tbody><tr><th data-stat="year_id">2024</th><td data-stat="team_name_abbr">QQA</td><td data-stat="b_pa">231</td><td data-stat="b_ab">200</td><td data-stat="b_hr">5</td></tr>
<tr><th data-stat="year_id">2024</th><td data-stat="team_name_abbr">2TM</td><td data-stat="b_pa">388</td><td data-stat="b_ab">350</td><td data-stat="b_hr">9</td></tr>
<tr><th data-stat="year_id">2023</th><td data-stat="team_name_abbr">Totals</td><td data-stat="b_pa">999</td><td data-stat="b_ab">1</td><td data-stat="b_hr">1</td></tr></tbody>
<tfoot><tr><th data-stat="year_id">Career</th><td data-stat="b_pa">619</td><td data-stat="b_ab">1</td><td data-stat="b_hr">1</td></tr></tfoot></table>"""


def pages(spark, *texts):
    return spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "page string, html string")


def test_tables_of_a_page():
    found = dict(html.tables_of(TEAM))
    assert [r["player"] for r in found["team_batting"]] == ["Dae Sol Nam*", "", "Gon Woo Oh", "Team Totals"]
    assert set(found) == {"team_batting", "team_pitching", "standard_roster"} and html.tables_of("") == [] and html.tables_of(None) == []


def test_team_page(spark):
    rows = records.team_rows(pages(spark, TEAM), "batting")
    got = {r["player_register_id"]: r["is_aggregate"] for r in rows.collect()}
    assert got == {"nam---001dae": False, "oh----004gon": False, None: True}
    typed = {r["player_register_id"]: r for r in records.typed(rows, ["player", "PA", "age"]).collect()}
    assert typed["nam---001dae"]["PA"] == 1204 and typed["oh----004gon"]["PA"] is None and typed["nam---001dae"]["name_clean"] == "Dae Sol Nam"
    ids = records.player_ids(rows.withColumn("o", F.lit(1)), records.team_rows(pages(spark, TEAM), "pitching").withColumn("o", F.lit(1)), records.team_rows(pages(spark, TEAM), "roster").withColumn("o", F.lit(1)), "o")
    assert {r[0] for r in ids.collect()} == {"nam---001dae", "oh----004gon", "baek--002sol"}


def test_crawl(spark):
    index = spark.createDataFrame([("index", INDEX)], "page string, html string")
    seasons = spark.createDataFrame([("s2024", SEASON), ("s2010", SEASON)], "season_id string, html string")
    teams = spark.createDataFrame([("t1", TEAM), ("t2", TEAM)], "team_bref_id string, html string")
    found = records.crawl(index, seasons, teams, 2020, 2026)
    assert [(r["season"], r["team_name"], r["PA"]) for r in found.batting.filter("PA IS NOT NULL").collect()] == [(2024, "Comets", 1204.0)]
    assert found.batting.count() == 2 and found.pitching.first()["IP"] == 96.2
    assert str(found.roster.first()["date_of_birth"]) == "1993-04-11"
    assert [(r["season"], r["side"], r["PA"]) for r in found.league_totals.collect()] == [(2024, "batting", 48112.0)]


def test_player_pages(spark):
    found = records.page_seasons(pages(spark, PLAYER, "<p>none</p>", None), "batting")
    assert [(r["page"], r["season"], r["team"], r["PA"]) for r in found.collect()] == [("p0", 2024, "2TM", 388.0)]
    assert {(r["page"], r["error"]) for r in records.failed_pages(pages(spark, PLAYER, "<p>none</p>", None), found).collect()} == {("p1", "no season table"), ("p2", "no page")}


def test_json_splits(spark):
    def doc(*splits):
        return json.dumps({"stats": [{"splits": list(splits)}]})

    stat = {"plateAppearances": 100, "atBats": 90, "age": 25}
    docs = spark.createDataFrame(
        [
            (1, doc({"season": "2020", "stat": stat, "sport": {"id": 1}, "gameType": "R", "team": {"name": "A"}}, {"season": "2020", "stat": {**stat, "age": 26}, "team": {"name": "B"}})),
            (2, doc({"season": "2020", "stat": stat, "sport": {"id": 11}}, {"season": "2020", "stat": stat, "gameType": "S"}, {"season": "2020", "stat": {}})),
            (3, "no json"),
            (4, None),
        ],
        "key_mlbam long, body string",
    )
    assert records.json_splits(docs, "batting").count() == 2
    assert [(r["key_mlbam"], r["season"], r["PA"], r["age"]) for r in records.player_seasons(docs, "batting").collect()] == [(1, 2020, 200.0, 26.0)]
    pitched = spark.createDataFrame([(1, doc({"season": "2020", "stat": {"inningsPitched": "5.2"}}, {"season": "2020", "stat": {"inningsPitched": "3.2"}}))], "key_mlbam long, body string")
    assert records.player_seasons(pitched, "pitching").first()["IP"] == pytest.approx(9.1)
    assert records.json_league_totals(docs, "batting").first()["PA"] == 200


def test_guard(spark):
    many = pages(spark, *["x"] * 12)
    with pytest.raises(records.SourceDown):
        records.guard_source(many, many)
    records.guard_source(many, many.limit(3))


def test_register(spark):
    people = spark.createDataFrame([("Sol", "Baek", "1991", "6", "5"), (None, "Baek", "1991", "2", "30"), ("A", None, None, None, None)], "name_first string, name_last string, birth_year string, birth_month string, birth_day string")
    assert [(r["name"], str(r["date_of_birth"])) for r in records.people(people).collect()] == [("Sol Baek", "1991-06-05"), ("Baek", "None"), ("A", "None")]


def test_csv_scans(spark, tmp_path):
    schema = "id string, n int, extra double"
    assert tables.read_csv(spark, f"{tmp_path}/none.csv", schema).count() == 0
    with pytest.raises(tables.MissingInput):
        tables.read_csv(spark, f"{tmp_path}/none.csv", schema, required=True)
    for i in range(2):
        (tmp_path / f"part{i}.csv").write_text(f"n,id,other\n{i},a,z\nbad,b,z\n")
    got = tables.read_csv(spark, [f"{tmp_path}/part{i}.csv" for i in range(3)], schema).collect()
    assert sorted((r["id"], r["n"]) for r in got if r["n"] is not None) == [("a", 0), ("a", 1)] and len(got) == 4
    tables.write_csv(spark.createDataFrame([("x", 1, None)], schema), f"{tmp_path}/out.csv")
    assert tables.read_csv(spark, f"{tmp_path}/out.csv", schema, required=True).first()["n"] == 1
    gz = tmp_path / "z.csv.gz"
    gz.write_bytes(gzip.compress(b"\xef\xbb\xbfid,n\nq,5\n"))
    assert [tuple(r) for r in tables.read_csv(spark, str(gz), "id string, n int").collect()] == [("q", 5)]
    assert tables.ensure_columns(spark.range(1), {"PA": 0.0, "id": 9}).first().asDict() == {"id": 0, "PA": 0.0}


def test_shards_are_read_by_one_scan_for_each_header(spark, tmp_path):
    for i in range(9):
        (tmp_path / f"s{i}.csv").write_text(f"id,n\na{i},{i}\n" if i % 3 else f"n,id\n{i},a{i}\n")
    df = tables.read_csv(spark, [f"{tmp_path}/s{i}.csv" for i in range(9)], "id string, n int")
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    assert sorted(map(tuple, df.collect())) == [(f"a{i}", i) for i in range(9)]


def test_malformed_records_are_set_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\nx,1\ny,2,3\nz\nw,bad\n")
    rows, bad = tables.read_csv_apart(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/none.csv"], "id string, n int, more string")
    assert sorted(map(tuple, rows.collect())) == [("w", None, None), ("x", 1, None)] and rows.count() == 2
    assert sorted(map(tuple, bad.collect())) == [("a.csv", "y,2,3", 2), ("a.csv", "z", 2)] and bad.count() == 2
    rows, bad = tables.read_csv_apart(spark, f"{tmp_path}/none.csv", "id string")
    assert rows.count() == 0 == bad.count()


def test_last_row_does_not_depend_on_splits(spark, tmp_path):
    for part in "ab":
        (tmp_path / f"{part}.csv").write_text("player_register_id,season,rel_k_pct\n" + "".join(f"p{i % 7},{2000 + i % 3},{part}{i}.5\n".replace(part, "1" if part == "a" else "2") for i in range(400)))
    found = []
    for size in ("64m", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = tables.read_csv(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], "player_register_id string, season int, rel_k_pct double", place="ordinal")
        found.append((df.rdd.getNumPartitions(), sorted((r["k"], r["rel_k_pct"]) for r in timeline.latest(df.withColumn("k", F.concat_ws(":", "player_register_id", "season")), "k", F.desc("ordinal")).collect())))
        away = spark.createDataFrame([(f"p{i}", 2003, 1.0) for i in range(7)], "player_register_id string, season int, rel_k_pct double")
        found[-1] += (sorted(map(str, timeline.build_pairs(df, away).collect())),)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found[0][0] < found[1][0] and found[0][1:] == found[1][1:] and found[0][1][-1][1] > 2000


def test_only_the_wanted_table_is_built(spark):
    assert [len(rows) for _, rows in html.tables_of(TEAM, "team_pitching")] == [0, 1, 0]
    rows = html.page_rows(pages(spark, TEAM, None, "<p>none</p>"), "team_pitching")
    assert [(r["page"], r["table_id"], r["error"]) for r in rows.orderBy("page").collect()] == [("p0", "team_pitching", None), ("p1", None, "no page")]
    assert "ArrowEvalPython" not in rows._jdf.queryExecution().executedPlan().toString() and "PythonUDTF" in rows._jdf.queryExecution().executedPlan().toString()
    clash = pages(spark, TEAM).withColumns({"cells": F.lit(1), "Error": F.lit(2), "table_at": F.lit(3)})
    assert html.rows(clash, "team_batting").count() == 4 and html.rows(pages(spark).limit(0)).count() == 0


def test_json_failures(spark):
    docs = spark.createDataFrame([(1, "{"), (2, None), (3, '{"stats": [{"splits": []}]}'), (4, '{"stats": null}'), (5, '{"stats": [{"splits": [{"season": "2020", "stat": {"atBats": "1"}}]}]}')], "k long, body string")
    assert sorted(map(tuple, records.json_failures(docs).collect())) == [(1, "no json"), (2, "no document"), (3, "no splits"), (4, "no splits")]


def download(url):
    """What tests fetch pages with, by name."""
    return (404, "") if url.endswith("gone") else (200, f"<p>{url}</p>")


def test_cache_source_opens_only_what_the_filter_names(spark, tmp_path):
    folder = str(tmp_path / "cache")
    urls = [f"http://x/{i}" for i in range(60)]
    pagecache.write_cache(spark.createDataFrame([(u, f"<b>{u}</b>") for u in urls] + [("http://x/null", None)], "url string, html string"), folder)
    names = {u: fetch.page_name(u) for u in urls}
    everything = pagecache.read_cache(spark, folder)
    assert {(r["page"], r["html"]) for r in everything.collect()} == {(names[u], f"<b>{u}</b>") for u in urls}
    wanted = [names[u] for u in urls[:5]]
    for u in urls[5:]:
        (tmp_path / "cache" / names[u][:2] / names[u]).write_bytes(b"never read")
        (tmp_path / "cache" / names[u][:2] / names[u]).chmod(0)
    some = everything.filter(F.col("page").isin(*wanted))
    assert {r["html"] for r in some.collect()} == {f"<b>{u}</b>" for u in urls[:5]}
    reader = pagecache.PageCacheReader({"path": folder})
    assert not list(reader.pushFilters([In(("page",), tuple(wanted))])) and sum(len(s.named) for s in reader.partitions()) == 5 and not any(s.prefixes for s in reader.partitions())
    other = [EqualTo(("html",), "x")]
    assert list(pagecache.PageCacheReader({"path": folder}).pushFilters(other)) == other


def test_cache_source_fetches_absent_pages(spark, tmp_path):
    folder = str(tmp_path / "cache")
    wanted = ["http://x/1", "http://x/gone"]
    offline = pagecache.read_cache(spark, folder).filter(F.col("url").isin(*wanted))
    assert {(r["url"], r["error"]) for r in offline.collect()} == {(u, "not in the cache, and offline") for u in wanted}
    online = pagecache.read_cache(spark, folder, download="tests.test_sources:download", gap=0.0, per_minute=1000).filter(F.col("url").isin(*wanted))
    assert {(r["url"], r["html"], r["error"]) for r in online.collect()} == {("http://x/1", "<p>http://x/1</p>", None), ("http://x/gone", None, "status 404")}
    assert [r["html"] for r in pagecache.read_cache(spark, folder).filter(F.col("page") == fetch.page_name("http://x/1")).collect()] == ["<p>http://x/1</p>"]
    assert pagecache.read_cache(spark, folder).filter(F.col("page") == "none.html").first()["error"] == "not in the cache"


def test_page_cache(tmp_path, spark):
    calls, waits, now = [], [], [0.0]

    def download(url):
        calls.append(url)
        return (429, "") if len(calls) == 1 else (200, "<p>ok</p>")

    def sleep(s):
        waits.append(s)
        now[0] += s

    limiter = fetch.RateLimiter(3.5, 2, lambda: now[0], sleep)
    cache = fetch.PageCache(str(tmp_path), download, limiter, sleep=sleep)
    assert cache.get("http://x/1") == "<p>ok</p>" and cache.get("http://x/1") == "<p>ok</p>" and len(calls) == 2 and 60 in waits
    with pytest.raises(fetch.FetchError):
        fetch.PageCache(str(tmp_path)).get("http://x/2")
    with pytest.raises(fetch.FetchError) as e:
        fetch.PageCache(str(tmp_path), lambda u: (404, ""), limiter, sleep=sleep).get("http://x/3")
    assert e.value.status == 404
    assert tables.read_pages(spark, str(tmp_path)).first()["html"] == "<p>ok</p>"
    assert spark.createDataFrame([("http://x/1",)], "u string").select(tables.page_key(F.col("u"))).first()[0] == cache.file("http://x/1").name


def test_rate_limiter_keeps_to_the_minute():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = fetch.RateLimiter(1.0, 3, lambda: now[0], sleep)
    for _ in range(4):
        limiter.wait()
    assert now[0] == 60.0


def test_plain_markup_reads_as_the_parser_reads_it(monkeypatch):
    """Random pieces of markup, well formed or not, through both ways."""
    pieces = ["<table>", '<table id="t">', '<table class="x" id="u">', "</table>", "<thead>", "</thead>", "<tbody>", "<tfoot>", "</tfoot>", "<tr>", '<tr class="thead">', "</tr>", "<td>", '<td data-stat="a">', '<th data-stat="b">', "</td>", "</th>",
              '<td data-stat="c">1,0</td>', '<td data-stat=""> x </td>', '<td data-stat="d"><a href="/p?id=1">\xa0N </a></td>', '<th data-stat="e"><a href="">M</th>', '<td data-stat="f">g</a></td>', '<a href="/q">', "</a>", " text ", "\xa0", "a > b",
              "<!-- <table id=\"c\"><tr><td data-stat=\"a\">1</td></tr></table> -->", "<!-- - -->", "<!---->", "<!-->", "--", "&amp;", "&nbsp", "<br/>", "<TD>", "<script>", "</script>", "<p class='y'>", "<title>", "</div id=\"x\">", "<", "<td data-stat=\"h\" csk=\"2\">", "<div>"]
    rng, plain = random.Random(3), 0
    for i in range(6000):
        kinds = pieces if i % 3 == 0 else [p for p in pieces if html.PLAIN.fullmatch(p)]
        text = '<table id="t"><tr>' * (i % 2) + "".join(rng.choices(kinds, k=rng.randrange(1, 14)))
        plain += html._Tables().read_plain(text)
        got = html.tables_of(text), html.tables_of(text, "t")
        with monkeypatch.context() as m:
            m.setattr(html._Tables, "read_plain", lambda self, text: False)
            assert got == (html.tables_of(text), html.tables_of(text, "t")), text
    assert plain > 3000


def test_pages_of_queries_are_plain(spark):
    page = '<table id="s"><thead><tr><th data-stat="player">Player</th></tr></thead><tbody>' + '<tr><td data-stat="PA">1,000</td></tr>' * 3 + "</tbody></table>"
    assert html._Tables().read_plain(page) and html._Tables().read_plain(f"<!-- <div>{page}</div> -->") and len(html.tables_of(page)[0][1]) == 3
