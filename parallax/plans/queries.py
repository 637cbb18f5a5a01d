"""Registered queries over the driver's tables, each with the SQL that must give the same rows.

``QUERIES[name](spark, sf_dir)`` is a lazy DataFrame made of parallax operators; ``ORACLES[name]`` is SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.functions import expr, names
from parallax.operators import evaluate, model, orderstat, quality, rates, resolve, screen, timeline
from parallax.session import workers_see_package
from parallax.sources.stored import stored
from parallax.sources.tables import page_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Read = Callable[[str], DataFrame]


def query(sql: str):
    """Register a function of a table reader under its name, with its SQL."""

    def register(f: Callable[[Read], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_see_package(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__], ORACLES[f.__name__] = run, sql
        return f

    return register


def long(c: Column) -> Column:
    return c.cast("long")


def n_rows() -> Column:
    return F.count(F.lit(1))


# Scans, ratios, joins


@query("SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 45 AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01'")
def scan_project_filter(read: Read) -> DataFrame:
    in_range = (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1997-04-01").cast("timestamp_ntz"))
    return rates.at_least(read("lineitem"), "l_quantity", 45).filter(in_range).select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


@query("""
SELECT l_partkey, CASE WHEN sum(d) > 0 THEN round(sum(n) / sum(d), 6) END AS ratio FROM (
    SELECT l_partkey, l_extendedprice * l_discount AS n, CASE WHEN l_partkey % 5 = 0 THEN 0.0 ELSE l_extendedprice END AS d FROM lineitem) GROUP BY 1
""")
def safe_ratio(read: Read) -> DataFrame:
    price = F.col("l_extendedprice")
    den = F.when(F.col("l_partkey") % 5 == 0, 0.0).otherwise(price)
    out = rates.ratio_of_sums(read("lineitem"), ["l_partkey"], {"ratio": (price * F.col("l_discount"), den)})
    return out.withColumn("ratio", F.round("ratio", 6))


def line_rates() -> dict[str, tuple[Column, Column]]:
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    returned = F.when(F.col("l_returnflag") == "R", quantity).otherwise(0.0)
    return {"disc_rate": (price * F.col("l_discount"), price), "return_rate": (returned, quantity), "tax_rate": (price * F.col("l_tax"), price)}


YEARLY = """SELECT year(l_shipdate)::BIGINT AS yr, sum(l_extendedprice * l_discount) / sum(l_extendedprice) AS disc_rate,
    sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS return_rate, sum(l_extendedprice * l_tax) / sum(l_extendedprice) AS tax_rate FROM lineitem GROUP BY 1"""


@query(f"SELECT yr, round(disc_rate, 6) AS lg_disc_rate, round(return_rate, 6) AS lg_return_rate, round(tax_rate, 6) AS lg_tax_rate FROM ({YEARLY})")
def league_rates(read: Read) -> DataFrame:
    lines = read("lineitem").withColumn("yr", long(F.year("l_shipdate")))
    out = rates.ratio_of_sums(lines, ["yr"], line_rates(), "lg_")
    return out.select("yr", *[F.round(f"lg_{r}", 6).alias(f"lg_{r}") for r in line_rates()])


@query(f"""
WITH lg AS ({YEARLY}), g AS (
    SELECT l_suppkey, year(l_shipdate)::BIGINT AS yr, count(*) AS n, sum(l_extendedprice * l_discount) / sum(l_extendedprice) AS disc_rate,
        sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS return_rate FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, yr, n, round(g.disc_rate / lg.disc_rate, 6) AS rel_disc_rate, round(g.return_rate / lg.return_rate, 6) AS rel_return_rate FROM g JOIN lg USING (yr) WHERE n >= 50
""")
def relative_rates(read: Read) -> DataFrame:
    """One pass over the lines: the years' sums are sums of the suppliers' sums."""
    chosen = {k: v for k, v in line_rates().items() if k != "tax_rate"}
    sums = [F.sum(c).alias(f"{k}_{part}") for k, pair in chosen.items() for part, c in zip("nd", pair, strict=True)]
    groups = read("lineitem").groupBy("l_suppkey", long(F.year("l_shipdate")).alias("yr")).agg(n_rows().alias("n"), *sums)
    lg = rates.ratio_of_sums(groups, ["yr"], {k: (F.col(f"{k}_n"), F.col(f"{k}_d")) for k in chosen}, "lg_")
    own = rates.at_least(groups, "n", 50).join(lg, "yr", "left")
    rel = {f"rel_{k}": F.round(expr.safe_ratio(expr.safe_ratio(F.col(f"{k}_n"), F.col(f"{k}_d")), F.col(f"lg_{k}")), 6) for k in chosen}
    return own.select("l_suppkey", "yr", "n", *[v.alias(k) for k, v in rel.items()])


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def id_bridge_join(read: Read) -> DataFrame:
    bridge = read("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    named = read("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = resolve.bridged(read("customer").join(named, "c_nationkey"), bridge.union(bridge), read("region"), "c_nationkey", "r_regionkey")
    return out.select("c_custkey", "n_name", "r_name")


@query("""
WITH k AS (SELECT c_custkey, nullif(c_custkey % 50, 0) AS k FROM customer), s AS (SELECT s_suppkey, nullif(s_suppkey % 50, 0) AS k FROM supplier)
SELECT k, count(*) AS n, sum(c_custkey)::BIGINT AS customers, sum(s_suppkey)::BIGINT AS suppliers FROM k JOIN s USING (k) GROUP BY k
""")
def null_key_join(read: Read) -> DataFrame:
    customers = read("customer").select("c_custkey", F.nullif(F.col("c_custkey") % 50, F.lit(0)).alias("k"))
    suppliers = read("supplier").select("s_suppkey", F.nullif(F.col("s_suppkey") % 50, F.lit(0)).alias("k"))
    out = customers.join(suppliers, "k").groupBy("k")
    return out.agg(n_rows().alias("n"), F.sum("c_custkey").alias("customers"), F.sum("s_suppkey").alias("suppliers"))


def sides(read: Read) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers with keys of three widths of their balances."""

    def keyed(df: DataFrame, p: str) -> DataFrame:
        return df.select(f"{p}key" if p != "c_" else "c_custkey", F.col(f"{p}nationkey").alias("nation"), *[long(F.floor(F.col(f"{p}acctbal") / w)).alias(f"k{w}") for w in (10, 100, 1000)])

    return keyed(read("customer"), "c_"), keyed(read("supplier").withColumnRenamed("s_suppkey", "s_key"), "s_").withColumnRenamed("s_key", "s_suppkey")


SIDES = """c AS (SELECT c_custkey, c_nationkey AS nation, floor(c_acctbal / 10)::BIGINT AS k10, floor(c_acctbal / 100)::BIGINT AS k100, floor(c_acctbal / 1000)::BIGINT AS k1000 FROM customer),
s AS (SELECT s_suppkey, s_nationkey AS nation, floor(s_acctbal / 10)::BIGINT AS k10, floor(s_acctbal / 100)::BIGINT AS k100, floor(s_acctbal / 1000)::BIGINT AS k1000 FROM supplier)"""


def one(table: str, key: str) -> str:
    return f"(SELECT * FROM {table} QUALIFY count(*) OVER (PARTITION BY nation, {key}) = 1)"


TIERED = f"""WITH {SIDES},
m1 AS (SELECT c_custkey, s_suppkey, 'name_dob' AS match_tier, 0.95::DOUBLE AS match_confidence FROM {one("c", "k10")} a JOIN {one("s", "k10")} b USING (nation, k10)),
c2 AS (SELECT * FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM m1)),
m2 AS (SELECT c_custkey, s_suppkey, 'phonetic_dob' AS match_tier, 0.90::DOUBLE AS match_confidence FROM {one("c2", "k100")} a JOIN {one("s", "k100")} b USING (nation, k100)),
c3 AS (SELECT * FROM c2 WHERE c_custkey NOT IN (SELECT c_custkey FROM m2)),
p AS (SELECT c_custkey, s_suppkey, 'phonetic_year' AS match_tier, 0.60::DOUBLE AS match_confidence FROM {one("c3", "k1000")} a JOIN {one("s", "k1000")} b USING (nation, k1000)),
m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2)"""
WIDTHS = ((["nation", "k10"], "name_dob"), (["nation", "k100"], "phonetic_dob"), (["nation", "k1000"], "phonetic_year"))


def linked(read: Read) -> tuple[DataFrame, DataFrame, DataFrame]:
    left, right = sides(read)
    return left, *resolve.tiered(left, right, "c_custkey", "s_suppkey", WIDTHS)


@query(f"WITH {SIDES} SELECT c_custkey, s_suppkey FROM {one('c', 'k100')} a JOIN {one('s', 'k100')} b USING (nation, k100)")
def one_to_one_join(read: Read) -> DataFrame:
    return resolve.one_to_one(*sides(read), ["nation", "k100"]).select("c_custkey", "s_suppkey")


@query(f"{TIERED} SELECT * FROM m UNION ALL SELECT * FROM p")
def tiered_crosswalk(read: Read) -> DataFrame:
    _, matches, proposals = linked(read)
    return matches.unionByName(proposals)


QUEUE = "SELECT c_custkey, NULL::BIGINT AS s_suppkey, 'no_match' AS review_reason FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM m) UNION ALL SELECT c_custkey, s_suppkey, 'low_confidence_proposal' FROM p"


@query(f"{TIERED} SELECT c_custkey, coalesce(s_suppkey, -1) AS s_suppkey, review_reason FROM ({QUEUE})")
def review_queue(read: Read) -> DataFrame:
    left, matches, proposals = linked(read)
    return resolve.review_queue(left.select("c_custkey"), matches, proposals, "c_custkey").select("c_custkey", F.coalesce("s_suppkey", F.lit(-1)).alias("s_suppkey"), "review_reason")


@query(f"""{TIERED}, d AS (SELECT c_custkey, c_custkey % 7 AS s_suppkey, CASE WHEN c_custkey % 10 = 0 THEN 'accept' ELSE 'reject' END AS decision FROM customer WHERE c_custkey % 10 IN (0, 1))
SELECT 'match' AS part, c_custkey, s_suppkey, match_tier AS said FROM m UNION ALL SELECT 'match', c_custkey, s_suppkey, 'manual' FROM d WHERE decision = 'accept'
UNION ALL SELECT 'queue', c_custkey, coalesce(s_suppkey, -1), review_reason FROM ({QUEUE}) WHERE c_custkey NOT IN (SELECT c_custkey FROM d)""")
def manual_overrides(read: Read) -> DataFrame:
    left, matches, proposals = linked(read)
    queue = resolve.review_queue(left.select("c_custkey"), matches, proposals, "c_custkey")
    decided = read("customer").filter((F.col("c_custkey") % 10).isin(0, 1)).select("c_custkey", (F.col("c_custkey") % 7).alias("s_suppkey"), F.when(F.col("c_custkey") % 10 == 0, "accept").otherwise("reject").alias("decision"))
    found = resolve.with_overrides(resolve.Crosswalk(matches, queue, None), decided, "c_custkey", "s_suppkey")
    return found.matches.select(F.lit("match").alias("part"), "c_custkey", "s_suppkey", F.col("match_tier").alias("said")).union(found.review_queue.select(F.lit("queue"), "c_custkey", F.coalesce("s_suppkey", F.lit(-1)), "review_reason"))


IN_1997 = "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1997"


def failed_1997(read: Read) -> DataFrame:
    return read("orders").filter((F.col("o_orderstatus") == "F") & (F.year("o_orderdate") == 1997)).select(F.col("o_custkey").alias("c_custkey"))


@query(f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN ({IN_1997})")
def semi_join(read: Read) -> DataFrame:
    return read("customer").join(failed_1997(read), "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query(f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN ({IN_1997})")
def anti_join(read: Read) -> DataFrame:
    return read("customer").join(failed_1997(read), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


# Sequences


SPANS = """SELECT coalesce(f.k, o.k) AS o_custkey, first_kbo, last_kbo, n_kbo, first_mlb, last_mlb, n_mlb,
    CASE WHEN first_kbo < first_mlb THEN 'posted_from_kbo' WHEN first_mlb < first_kbo THEN 'import_returnee' ELSE 'unknown' END AS cohort
FROM (SELECT o_custkey AS k, min(year(o_orderdate))::BIGINT AS first_kbo, max(year(o_orderdate))::BIGINT AS last_kbo, count(DISTINCT year(o_orderdate)) AS n_kbo FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f
FULL JOIN (SELECT o_custkey AS k, min(year(o_orderdate))::BIGINT AS first_mlb, max(year(o_orderdate))::BIGINT AS last_mlb, count(DISTINCT year(o_orderdate)) AS n_mlb FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) o ON f.k = o.k"""


SPAN_COLUMNS = [f"{part}_{league}" for league in timeline.LEAGUES for part in ("first", "last", "n")]


def cohorts(read: Read) -> DataFrame:
    orders = read("orders").select("o_custkey", "o_orderstatus", long(F.year("o_orderdate")).alias("season"))
    return timeline.classify(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'"), "o_custkey")


@query("SELECT o_custkey, cohort, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in SPAN_COLUMNS) + f" FROM ({SPANS})")
def span_classify(read: Read) -> DataFrame:
    return cohorts(read).select("o_custkey", "cohort", *[F.coalesce(c, F.lit(0)).alias(c) for c in SPAN_COLUMNS])


@query(f"SELECT cohort, count(*) AS n FROM ({SPANS}) GROUP BY 1 ORDER BY n DESC, cohort")
def cohort_counts(read: Read) -> DataFrame:
    return timeline.value_counts(cohorts(read), "cohort")


@query("""
WITH e AS (SELECT user_id, event_type, event_id, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS day FROM events WHERE event_type IN ('view', 'purchase')),
d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, day, event_type ORDER BY event_id DESC) = 1),
w AS (SELECT user_id, event_type AS from_type, day AS from_day, event_id AS from_event, lead(event_type) OVER o AS to_type, lead(day) OVER o AS to_day, lead(event_id) OVER o AS to_event
    FROM d WINDOW o AS (PARTITION BY user_id ORDER BY day, event_type))
SELECT user_id, from_type, to_type, from_event, to_event, to_day - from_day AS gap FROM w WHERE to_type <> from_type AND to_day - from_day BETWEEN 0 AND 2
""")
def crossings(read: Read) -> DataFrame:
    events = read("events").filter(F.col("event_type").isin("view", "purchase")).select("user_id", "event_type", "event_id", long(F.unix_date(F.col("ts").cast("date"))).alias("day"))
    found = timeline.switches(events, "user_id", "day", "event_type", F.col("event_id"), None, 2)
    return found.select("user_id", F.col("before.event_type").alias("from_type"), F.col("after.event_type").alias("to_type"), F.col("before.event_id").alias("from_event"), F.col("after.event_id").alias("to_event"), "gap")


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_partkey) > 1")
def duplicates_all(read: Read) -> DataFrame:
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return timeline.duplicates(lines, ["l_orderkey", "l_partkey"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(read: Read) -> DataFrame:
    return timeline.latest(read("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).drop("o_orderdate")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_record(read: Read) -> DataFrame:
    return resolve.best_record(read("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), "o_custkey", [F.asc_nulls_last("o_orderdate"), F.asc("o_orderkey")]).drop("o_orderdate")


RECENT = """SELECT o.o_custkey, o.o_orderkey, o.o_totalprice, p.cut, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS recency
FROM orders o JOIN (SELECT o_custkey, min(o_orderdate) AS cut FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) p ON o.o_custkey = p.o_custkey AND o.o_orderdate < p.cut"""


def before_pivot(read: Read) -> DataFrame:
    orders = read("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    pivots = orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("pivot"))
    return timeline.recent_before(orders, pivots, "o_custkey", "o_orderdate", 2, ties=("o_orderkey",))


@query(f"SELECT o_custkey, o_orderkey, o_totalprice, recency FROM ({RECENT}) WHERE recency <= 2")
def recent_before(read: Read) -> DataFrame:
    return before_pivot(read).select("o_custkey", "o_orderkey", "o_totalprice", long(F.col("recency")).alias("recency"))


@query("SELECT user_id, count(DISTINCT ts::DATE) AS seasons FROM events GROUP BY 1")
def service_seasons(read: Read) -> DataFrame:
    return timeline.seasons_by_player(read("events").withColumn("day", F.col("ts").cast("date")), "user_id", "day")


@query("""
SELECT s_suppkey, s_nationkey, bucket, CASE WHEN s_nationkey IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY s_nationkey, bucket) END AS club_eligible_that_year,
    count(*) OVER (PARTITION BY s_nationkey, bucket) > 1 AS posting_likely_delayed FROM (SELECT s_suppkey, s_nationkey, floor(s_acctbal / 2000)::BIGINT AS bucket FROM supplier)
""")
def congestion(read: Read) -> DataFrame:
    rows = read("supplier").select("s_suppkey", "s_nationkey", long(F.floor(F.col("s_acctbal") / 2000)).alias("bucket"))
    return timeline.congestion(rows, "s_nationkey", "bucket")


# Scores and screens


SCORES = "SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount) * l_quantity) / sum(l_extendedprice * l_quantity) AS score FROM lineitem GROUP BY 1"


def supplier_scores(read: Read) -> DataFrame:
    price = F.col("l_extendedprice")
    score = screen.ratio_of_weighted(price * (1 - F.col("l_discount")), price, F.col("l_quantity"))
    return read("lineitem").groupBy("l_suppkey").agg(score.alias("score"))


@query(f"SELECT l_suppkey, round(score, 6) AS score FROM ({SCORES})")
def weighted_score(read: Read) -> DataFrame:
    return supplier_scores(read).select("l_suppkey", F.round("score", 6).alias("score"))


COHORT = f"SELECT l_suppkey, round(score, 6) AS score FROM ({SCORES}) WHERE l_suppkey % 4 = 0"


def cohort(read: Read) -> DataFrame:
    return weighted_score(read).filter(F.col("l_suppkey") % 4 == 0)


@query(f"SELECT round(quantile_cont(score, 0.0), 6) AS permissive, round(quantile_cont(score, 0.25), 6) AS balanced, round(quantile_cont(score, 0.5), 6) AS strict FROM (SELECT round(score, 6) AS score FROM ({SCORES}))")
def quantile_bar(read: Read) -> DataFrame:
    out = orderstat.quantiles(weighted_score(read), "score", [*screen.STRICTNESS.values()])
    return out.select(*[F.round(F.get("q", F.lit(i)), 6).alias(name) for i, name in enumerate(screen.STRICTNESS)])


@query(f"""
WITH h AS ({COHORT}), t AS (SELECT quantile_cont(score, 0.25) AS bar FROM h), c AS (SELECT l_suppkey, round(score, 6) AS score FROM ({SCORES}) WHERE l_suppkey % 4 <> 0)
SELECT (SELECT count(*) FROM c, t WHERE score >= bar) AS admitted, (SELECT count(*) FROM c) AS of_total, (SELECT count(*) FROM h, t WHERE score >= bar) AS historical_caught, (SELECT count(*) FROM h) AS historical_total,
    (SELECT count(*) FROM h, t WHERE score < bar) AS historical_missed
""")
def screen_counts(read: Read) -> DataFrame:
    scored = weighted_score(read)
    named = cohort(read).withColumn("player", F.col("l_suppkey").cast("string"))
    return screen.screen_counts(scored.filter(F.col("l_suppkey") % 4 != 0), named).drop("threshold")


@query(f"WITH h AS ({COHORT}) SELECT l_suppkey, score FROM h WHERE score < (SELECT quantile_cont(score, 0.25) FROM h)")
def screen_missed(read: Read) -> DataFrame:
    return screen.missed(cohort(read))


@query(f"""
SELECT o_custkey, c_name AS player, year(cut)::BIGINT AS first_mlb, round(sum(o_totalprice) / sum(lg), 4) AS score
FROM ({RECENT}) r JOIN customer ON c_custkey = o_custkey CROSS JOIN (SELECT avg(o_totalprice) AS lg FROM orders) WHERE recency <= 2 AND c_mktsegment = 'BUILDING' GROUP BY 1, 2, 3
""")
def historical_profile(read: Read) -> DataFrame:
    league = read("orders").agg(F.avg("o_totalprice").alias("lg"))
    customers = read("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("player"))
    rows = before_pivot(read).join(customers, "o_custkey").crossJoin(F.broadcast(league))  # one row
    out = rows.groupBy("o_custkey", "player", long(F.year("pivot")).alias("first_mlb"))
    return out.agg(F.round(screen.ratio_of_weighted(F.col("o_totalprice"), F.col("lg"), F.lit(1.0)), 4).alias("score"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(read: Read) -> DataFrame:
    return read("orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("""
SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'Now' WHEN '2-HIGH' THEN 'Soon' WHEN '5-LOW' THEN 'Some day' ELSE o_orderpriority END AS label,
    CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 99 END::BIGINT AS place, o_orderpriority IN ('5-LOW') AS lower_is_better, count(*) AS n
FROM orders GROUP BY 1 ORDER BY place, o_orderpriority
""")
def custom_order(read: Read) -> DataFrame:
    key = F.col("o_orderpriority")
    label = F.coalesce(expr.lookup({"1-URGENT": "Now", "2-HIGH": "Soon", "5-LOW": "Some day"}, key), key)
    place = long(expr.display_rank(key, ("5-LOW", "1-URGENT", "2-HIGH")))
    out = read("orders").groupBy(key).agg(n_rows().alias("n"))
    return out.select(key, label.alias("label"), place.alias("place"), key.isin("5-LOW").alias("lower_is_better"), "n").orderBy("place", key)


@query("""SELECT event_id, user_id, value, NULL AS props FROM events WHERE event_type = 'purchase'
UNION ALL SELECT event_id, user_id, NULL, props FROM events WHERE event_type = 'error'""")
def union_by_name(read: Read) -> DataFrame:
    events = read("events")
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "value")
    return bought.unionByName(events.filter("event_type = 'error'").select("event_id", "user_id", "props"), allowMissingColumns=True)


@query("SELECT y AS season FROM (SELECT unnest(generate_series(1990, 2005))::INTEGER AS y) WHERE y NOT IN (SELECT year(o_orderdate) FROM orders)")
def set_difference(read: Read) -> DataFrame:
    return quality.missing_seasons(read("orders").select(F.year("o_orderdate").alias("season")), 1990, 2005)


@query("SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def set_intersect(read: Read) -> DataFrame:
    rich = read("supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey"))
    return read("customer").select("c_nationkey").intersect(rich)


# Data quality


@query("""
SELECT yr, round(scraped, 2) AS scraped, round(published, 2) AS published, round((scraped - published) / published, 6) AS pct_diff, CASE WHEN scraped > published * 1.02 THEN 'over' WHEN scraped < published * 0.98 THEN 'under' ELSE 'agree' END AS direction
FROM (SELECT year(l_shipdate)::BIGINT AS yr, sum(l_extendedprice) AS scraped FROM lineitem GROUP BY 1) JOIN (SELECT year(o_orderdate)::BIGINT AS yr, sum(o_totalprice) AS published FROM orders GROUP BY 1) USING (yr)
""")
def reconcile_totals(read: Read) -> DataFrame:
    lines = read("lineitem").select(long(F.year("l_shipdate")).alias("yr"), "l_extendedprice")
    orders = read("orders").select(long(F.year("o_orderdate")).alias("yr"), "o_totalprice")
    both = quality.reconciled(lines, orders, "l_extendedprice", "yr", "o_totalprice")
    direction = F.when(F.col("scraped") > F.col("published") * 1.02, "over").when(F.col("scraped") < F.col("published") * 0.98, "under").otherwise("agree")
    return both.select("yr", *[F.round(c, 2).alias(c) for c in ("scraped", "published")], F.round("pct_diff", 6).alias("pct_diff"), direction.alias("direction"))


@query("""
WITH a AS (SELECT year(l_shipdate)::BIGINT AS yr, avg(l_discount) AS x FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), b AS (SELECT year(l_shipdate)::BIGINT AS yr, avg(l_discount) AS x FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1)
SELECT yr, round(abs(a.x - b.x), 8) AS diff, abs(a.x - b.x) <= 0.005 AS agree FROM a JOIN b USING (yr)
""")
def sides_agree(read: Read) -> DataFrame:
    odd = F.col("l_linenumber") % 2 == 1
    years = read("lineitem").groupBy(long(F.year("l_shipdate")).alias("yr")).agg(F.avg(F.when(~odd, F.col("l_discount"))).alias("a"), F.avg(F.when(odd, F.col("l_discount"))).alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    return years.filter(gap.isNotNull()).select("yr", F.round(gap, 8).alias("diff"), (gap <= 0.005).alias("agree"))


def check(name: str, bad: str, table: str, good: str, what: str, severity: str = "error") -> str:
    return f"SELECT '{name}' AS name, n = 0 AS passed, '{severity}' AS severity, n AS n_bad, CASE WHEN n = 0 THEN '{good}' ELSE n || ' {what}' END AS message FROM (SELECT count(*) FILTER ({bad}) AS n FROM {table})"


RANGES = {"l_quantity": (1, 49), "l_discount": (0, 0.1), "l_tax": (0, 0.05)}
RANGES_SQL = " UNION ALL ".join(check(f"line.range.{c}", f"{c} NOT BETWEEN {a} AND {b}", "lineitem", f"{c} within [{a}, {b}]", f"rows where {c} is outside [{a}, {b}]") for c, (a, b) in RANGES.items())
NEGATIVE_SQL = check("customer.negative_counts", "c_acctbal < 0 OR c_custkey < 0", "customer", "no negative counts", "rows with a negative count")
IDENTITY_SQL = check("batting.pa_ge_ab", "l_extendedprice * l_discount > 4000", "lineitem", "PA >= AB holds", "rows where AB exceeds PA")
MISSING_SQL = check("documents.missing_ids", "lang IS NULL OR trim(lang) = ''", "documents", "every row has an id", "rows without an id")
UNIQUE_SQL = """SELECT 'line.duplicates' AS name, n = 0 AS passed, 'error' AS severity, n AS n_bad, CASE WHEN n = 0 THEN 'no duplicates' ELSE n || ' duplicated rows' END AS message
FROM (SELECT coalesce(sum(k), 0)::BIGINT AS n FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1))"""
COVERAGE_SQL = """SELECT 'labels.coverage' AS name, n < 0.10 * a AS passed, 'warning' AS severity, n AS n_bad, n || ' of ' || a || ' rows lack quality' AS message
FROM (SELECT count(*) FILTER (quality IS NULL) AS n, count(*) AS a FROM documents LEFT JOIN labels USING (doc_id))"""


@query(RANGES_SQL)
def value_ranges(read: Read) -> DataFrame:
    return quality.value_ranges(read("lineitem"), "line", RANGES)


@query(NEGATIVE_SQL)
def negative_counts(read: Read) -> DataFrame:
    return quality.negative_counts(read("customer"), "customer", ("c_acctbal", "c_custkey"))


@query(IDENTITY_SQL)
def identities(read: Read) -> DataFrame:
    return quality.batting_identities(read("lineitem"), columns={"PA": F.lit(4000.0), "AB": F.col("l_extendedprice") * F.col("l_discount")})


@query(MISSING_SQL)
def missing_ids(read: Read) -> DataFrame:
    return quality.missing_ids(read("documents"), "lang", "documents.missing_ids")


@query(UNIQUE_SQL)
def uniqueness(read: Read) -> DataFrame:
    return quality.uniqueness(read("lineitem"), ["l_orderkey", "l_partkey"], "line.duplicates")


@query(COVERAGE_SQL)
def dob_coverage(read: Read) -> DataFrame:
    return quality.null_share(read("documents").select("doc_id").join(read("labels"), "doc_id", "left"), "quality", "labels.coverage")


@query(" UNION ALL ".join([RANGES_SQL, NEGATIVE_SQL, IDENTITY_SQL, MISSING_SQL, UNIQUE_SQL, COVERAGE_SQL]))
def audit_summary(read: Read) -> DataFrame:
    """One pass a table: documents with their labels, lines by their keys, customers."""
    labelled = read("documents").select("doc_id", "lang").join(read("labels"), "doc_id", "left")
    documents = [quality.missing_ids(labelled, "lang", "documents.missing_ids"), quality.null_share(labelled, "quality", "labels.coverage")]
    return quality.audit([*[f(read) for f in (value_ranges, negative_counts, identities, uniqueness)], *documents])


# Models


#: Crossings made of orders: a customer's average order before 1998 and after, relative to all, is a strikeout rate, his
#: number of orders a walk rate. One region is the posted cohort.
PAIRS = """(SELECT o_custkey::VARCHAR AS key, CASE WHEN o_custkey % 3 = 0 THEN 'mlb_to_kbo' ELSE 'kbo_to_mlb' END AS direction, CASE WHEN r_name = 'ASIA' THEN 'posted_from_kbo' ELSE 'import_returnee' END AS cohort,
    (o_custkey % 17 + 18)::DOUBLE AS age, na, nb, xa / la AS k1, xb / lb AS k2, na / (SELECT count(*) / count(DISTINCT o_custkey) FROM orders WHERE year(o_orderdate) < 1998) AS b1, nb / (SELECT count(*) / count(DISTINCT o_custkey) FROM orders WHERE year(o_orderdate) >= 1998) AS b2
    FROM (SELECT o_custkey, count(*) FILTER (year(o_orderdate) < 1998)::DOUBLE AS na, count(*) FILTER (year(o_orderdate) >= 1998)::DOUBLE AS nb, avg(o_totalprice) FILTER (year(o_orderdate) < 1998) AS xa, avg(o_totalprice) FILTER (year(o_orderdate) >= 1998) AS xb FROM orders GROUP BY 1),
        (SELECT avg(o_totalprice) FILTER (year(o_orderdate) < 1998) AS la, avg(o_totalprice) FILTER (year(o_orderdate) >= 1998) AS lb FROM orders)
    JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE na > 0 AND nb > 0)"""
DESIGN = f"""(SELECT stat, key, cohort, direction, age, u, v, 1.0 AS x0, ln(u) AS x1, (age - 27) / 10 AS x2, CASE WHEN direction = 'kbo_to_mlb' THEN 1.0 ELSE 0.0 END AS x3, ln(v) AS y, sqrt(greatest(1.0, least(na, nb))) AS w, 1.0 AS k
    FROM (SELECT *, 'k_pct' AS stat, k1 AS u, k2 AS v FROM {PAIRS} UNION ALL SELECT *, 'bb_pct' AS stat, b1 AS u, b2 AS v FROM {PAIRS}))"""


def fit_sql(source: str, by: str = "stat", terms: int = 4) -> str:
    """Weighted least squares with up to four terms, by making each term orthogonal to those before: (by, n, players, b0.., sd, r2).

    ``source`` has x0.., y, weights w, and k, how often a row counts.
    """
    steps = [f"q0 AS (SELECT *, k * w AS kw, x0 AS z0, y AS e0 FROM {source})"]
    for j in range(1, terms):
        dots = ", ".join(f"sum(kw * x{j} * z{i}) / sum(kw * z{i} * z{i}) AS c{j}{i}" for i in range(j))
        left = " - ".join([f"x{j}", *(f"c{j}{i} * z{i}" for i in range(j))])
        steps.append(f"q{j} AS (SELECT q.*, {', '.join(f'c{j}{i}' for i in range(j))}, {left} AS z{j} FROM q{j - 1} q JOIN (SELECT {by}, {dots} FROM q{j - 1} GROUP BY {by}) USING ({by}))")
    gs = ", ".join(f"sum(kw * y * z{i}) / sum(kw * z{i} * z{i}) AS g{i}" for i in range(terms))
    cs = ", ".join(f"any_value(c{j}{i}) AS c{j}{i}" for j in range(1, terms) for i in range(j))
    back = "g"
    for i in reversed(range(terms)):
        back = f"(SELECT *, {' - '.join([f'g{i}', *(f'c{j}{i} * b{j}' for j in range(i + 1, terms))])} AS b{i} FROM {back})"
    steps.append(f"g AS (SELECT {by}, sum(k) AS n, count(DISTINCT key) AS players, {gs}, {cs} FROM q{terms - 1} GROUP BY {by})")
    steps.append(f"b AS {back}")
    rest = " - ".join(["q.y", "b0", *(f"b{i} * q.x{i}" for i in range(1, terms))])
    steps.append(f"r AS (SELECT {by}, sum(kw * ({rest}) ^ 2) AS rss, sum(kw * q.y * q.y) - sum(kw * q.y) ^ 2 / sum(kw) AS tss FROM q0 q JOIN b USING ({by}) GROUP BY {by})")
    return f"(WITH {', '.join(steps)} SELECT {by}, n, players, {', '.join(f'b{i}' for i in range(terms))}, sqrt(rss / greatest(n - 4, 1)) AS sd, 1 - rss / tss AS r2 FROM b JOIN r USING ({by}))"


FITS = fit_sql(DESIGN)
TRAINED = fit_sql(f"(SELECT * FROM {DESIGN} WHERE cohort <> 'posted_from_kbo')")
STATS = ["k_pct", "bb_pct"]


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def crossings(read: Read) -> DataFrame:
    early, price = F.year("o_orderdate") < 1998, F.col("o_totalprice")
    orders = read("orders")
    each = {"na": F.count_if(early).cast("double"), "nb": F.count_if(~early).cast("double"), "xa": F.avg(F.when(early, price)), "xb": F.avg(F.when(~early, price))}
    own = orders.groupBy("o_custkey").agg(*[c.alias(n) for n, c in each.items()])
    league = own.agg(F.avg(F.when(F.col("na") > 0, F.col("na"))).alias("ma"), F.avg(F.when(F.col("nb") > 0, F.col("nb"))).alias("mb"), (F.sum(F.col("xa") * F.col("na")) / F.sum(F.when(F.col("xa").isNotNull(), F.col("na")))).alias("la"), (F.sum(F.col("xb") * F.col("nb")) / F.sum(F.when(F.col("xb").isNotNull(), F.col("nb")))).alias("lb"))
    where = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    people = read("customer").join(where, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "c_name", "r_name")
    rows = own.filter("na > 0 AND nb > 0").join(people, "o_custkey").crossJoin(F.broadcast(league))  # one row
    return rows.select(
        F.col("o_custkey").cast("string").alias("player_register_id"), F.col("c_name").alias("player"), F.when(F.col("o_custkey") % 3 == 0, "mlb_to_kbo").otherwise("kbo_to_mlb").alias("direction"),
        F.when(F.col("r_name") == "ASIA", "posted_from_kbo").otherwise("import_returnee").alias("cohort"), F.lit(1997).alias("kbo_season"), F.lit(1998).alias("mlb_season"),
        (F.col("o_custkey") % 17 + 18).cast("double").alias("kbo_age"), F.col("na").alias("kbo_PA"), F.col("nb").alias("mlb_PA"),
        (F.col("xa") / F.col("la")).alias("kbo_rel_k_pct"), (F.col("xb") / F.col("lb")).alias("mlb_rel_k_pct"), (F.col("na") / F.col("ma")).alias("kbo_rel_bb_pct"), (F.col("nb") / F.col("mb")).alias("mlb_rel_bb_pct"),
    )


@query(f"SELECT stat, round(b1, 5) AS retention_slope, round(b0, 5) AS intercept, round(exp(b0), 5) AS level_ratio, round(b2, 5) AS age_coef, round(b3, 5) AS direction_coef, n::BIGINT AS n_pairs, players AS n_players, round(sd, 5) AS residual_sd, round(r2, 5) AS r_squared FROM {FITS}")
def wls_fit(read: Read) -> DataFrame:
    fits = model.fit(model.design(crossings(read), STATS))
    return rounded(fits, 5, *[c for c, kind in fits.dtypes if kind == "double"])


@query(f"SELECT p_partkey, stat, round(exp(b0 + b1 * ln(p_size / 25.0) + b2 * (p_partkey % 20 - 7) / 10 + b3), 4) AS predicted FROM part CROSS JOIN {FITS} WHERE p_size > 0")
def predict(read: Read) -> DataFrame:
    """Cases times fits, as an array of the few fits beside each case."""
    fits = model.fit(model.design(crossings(read), STATS))
    beside = fits.agg(F.collect_list(F.struct("stat", "intercept", "retention_slope", "age_coef", "direction_coef")).alias("fits"))
    cases = read("part").filter("p_size > 0").select("p_partkey", "p_size").crossJoin(F.broadcast(beside)).select("p_partkey", "p_size", F.explode("fits").alias("f")).select("p_partkey", "p_size", "f.*")
    return cases.select("p_partkey", "stat", F.round(model.predicted(F.col("p_size") / 25.0, F.col("p_partkey") % 20 + 20.0), 4).alias("predicted"))


@query("""
SELECT stat, n, round(r * r, 6) AS r_squared, round(a, 6) AS slope_mlb_on_kbo, round(b, 6) AS slope_kbo_on_mlb, round(1 / b, 4) AS naive_inverted_slope, round(a * b, 6) AS slope_product_equals_r2 FROM (
    SELECT l_returnflag AS stat, count(*) AS n, corr(ln(l_quantity), ln(l_extendedprice)) AS r, regr_slope(ln(l_extendedprice), ln(l_quantity)) AS a, regr_slope(ln(l_quantity), ln(l_extendedprice)) AS b FROM lineitem GROUP BY 1)
""")
def inversion_diagnostic(read: Read) -> DataFrame:
    rows = read("lineitem").select(F.col("l_returnflag").alias("stat"), F.log("l_quantity").alias("x1"), F.log("l_extendedprice").alias("y"))
    return rounded(rounded(model.inversion(rows), 6, "r_squared", "slope_mlb_on_kbo", "slope_kbo_on_mlb", "slope_product_equals_r2"), 4, "naive_inverted_slope")


@query(f"""
WITH p AS (SELECT stat, u, v, round_even(u, 3) AS ur, round_even(v, 3) AS vr, round_even(exp(b0 + b1 * x1 + b2 * x2 + b3), 3) AS predicted FROM {DESIGN} d JOIN {TRAINED} f USING (stat) WHERE cohort = 'posted_from_kbo' AND direction = 'kbo_to_mlb')
SELECT stat, count(*) AS n, round(avg(abs(predicted - vr)), 3) AS mae_model, round(avg(abs(1 - vr)), 3) AS mae_league_average, round(avg(abs(ur - vr)), 3) AS mae_carry_over,
    avg(abs(predicted - vr)) < avg(abs(1 - vr)) AS beats_league_average, avg(abs(predicted - vr)) < avg(abs(ur - vr)) AS beats_carry_over FROM p GROUP BY 1
""")
def holdout_scorecard(read: Read) -> DataFrame:
    """Intervals need random draws, so their coverage has no SQL."""
    cases = evaluate.holdout(crossings(read), "batting", stats=STATS, draws=10)
    return evaluate.scorecard(cases).drop("interval_coverage")


DRAWS = 12
DRAWN = f"""(SELECT stat, draw, (draw * 1103515245 + slot * 12345 + draw * slot * 7919) % players AS code, count(*)::DOUBLE AS k
    FROM (SELECT stat, count(DISTINCT key) AS players FROM {DESIGN} GROUP BY 1), (SELECT unnest(generate_series(0, {DRAWS - 1}))::BIGINT AS draw), (SELECT unnest(generate_series(0, (SELECT count(*) - 1 FROM customer)))::BIGINT AS slot) WHERE slot < players GROUP BY ALL)"""
RESAMPLED = f"""(SELECT d.stat || ':' || m.draw AS which, d.stat, m.draw, d.key, x0, x1, x2, x3, y, w, m.k FROM (SELECT *, dense_rank() OVER (PARTITION BY stat ORDER BY key) - 1 AS code FROM {DESIGN}) d JOIN {DRAWN} m USING (stat, code))"""


def draws_by_congruence(rows: DataFrame) -> DataFrame:
    """Players that a congruence draws with replacement, in place of random numbers: (stat, draw, code, k)."""
    sizes = rows.groupBy("stat").agg(F.countDistinct("key").alias("players"))
    draws = F.sequence(F.lit(0).cast("long"), F.lit(DRAWS - 1).cast("long"))
    blocks = sizes.withColumn("draw", F.explode(draws)).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("players") - 1, F.lit(model.BLOCK).cast("long"))))
    own = F.sequence("first", F.least(F.col("first") + model.BLOCK, F.col("players")) - 1)
    slots = model.dealt(blocks, "stat", "draw", "first").withColumn("slot", F.explode(own))
    picks = slots.select("stat", F.col("draw").cast("int").alias("draw"), F.expr("(draw * 1103515245 + slot * 12345 + draw * slot * 7919) % players").alias("code"))
    return picks.repartition("stat", "code").groupBy("stat", "draw", "code").agg(F.count(F.lit(1)).cast("double").alias("k"))


@query(f"SELECT split_part(which, ':', 1) AS stat, split_part(which, ':', 2)::INT AS draw, round(b0, 5) AS b0, round(b1, 5) AS b1, round(b2, 5) AS b2, round(b3, 5) AS b3, round(sd, 5) AS sd FROM {fit_sql(RESAMPLED, 'which')}")
def bootstrap_refits(read: Read) -> DataFrame:
    rows = stored(model.design(crossings(read), STATS), "design")
    return rounded(model.bootstrap(rows, DRAWS, drawn=draws_by_congruence(rows)).drop("at"), 5, "b0", "b1", "b2", "b3", "sd")


#: The operator's own draws: picks are hashed from the name of a block, of which so few players have one, and a counter.
def mix_sql(x: str) -> str:
    for multiplier, shift in ((2246822507, 16), (3266489909, 13)):
        x = f"(xor({x}, {x} >> {shift}) * {multiplier}::UBIGINT % 4294967296::UBIGINT)"
    return x


HASHED = f"""(WITH j AS (SELECT unnest(generate_series(0, (SELECT count(*) - 1 FROM customer)))::UBIGINT AS j), d AS (SELECT stat, players, draw, ('0x' || md5('0:' || stat || ':' || draw || ':0')[1:8])::UBIGINT AS key
    FROM (SELECT stat, count(DISTINCT key)::UBIGINT AS players FROM {DESIGN} GROUP BY 1), (SELECT unnest(generate_series(0, {DRAWS - 1}))::INT AS draw)),
m1 AS (SELECT j, {mix_sql('j')} AS x FROM j), m2 AS (SELECT j, xor(x, x >> 16) AS x FROM m1), m3 AS (SELECT stat, players, draw, xor(key, x) AS x FROM d JOIN m2 ON j < players), m4 AS (SELECT stat, players, draw, {mix_sql('x')} AS x FROM m3)
SELECT stat, draw, ((xor(x, x >> 16) * players) >> 32)::BIGINT AS code, count(*)::DOUBLE AS k FROM m4 GROUP BY ALL)"""


def uniform_sql(name: str) -> str:
    return f"((('0x' || md5({name})[1:8])::BIGINT + 0.5) / 4294967296)"


NOISE = f"sd * sqrt(-2 * ln({uniform_sql("'0:' || draw || ':size'")})) * cos(2 * pi() * {uniform_sql("'0:' || draw || ':angle'")})"


@query(HASHED[1:-1])
def resampled_counts(read: Read) -> DataFrame:
    rows = model.design(crossings(read), STATS)
    return model.multiplicities(rows.groupBy("stat").agg(F.countDistinct("key").alias("players")), DRAWS, 0)


HASH_RESAMPLED = RESAMPLED.replace(DRAWN, HASHED)


@query(f"""SELECT split_part(which, ':', 1) AS stat, split_part(which, ':', 2)::INT AS draw, round(b0, 5) AS b0, round(b1, 5) AS b1, round(b2, 5) AS b2, round(b3, 5) AS b3, round(sd, 5) AS sd, round({NOISE}, 5) AS noise
FROM (SELECT *, split_part(which, ':', 2) AS draw FROM {fit_sql(HASH_RESAMPLED, 'which')})""")
def resampled_refits(read: Read) -> DataFrame:
    drawn = model.with_noise(model.bootstrap(stored(model.design(crossings(read), STATS), "design"), DRAWS))
    return rounded(drawn.drop("at"), 5, "b0", "b1", "b2", "b3", "sd", "noise")


FORWARD = f"(SELECT * FROM {DESIGN} WHERE direction = 'kbo_to_mlb')"


@query(f"SELECT stat, round(b1, 5) AS retention_slope, round(b0 / 2, 5) AS intercept, round(exp(b0 / 2), 5) AS level_ratio, round(b2, 5) AS age_coef, round(b0 / 2, 5) AS direction_coef, n::BIGINT AS n_pairs, players AS n_players, round(sd, 5) AS residual_sd, round(r2, 5) AS r_squared FROM {fit_sql(FORWARD, terms=3)}")
def deficient_fit(read: Read) -> DataFrame:
    """One direction alone: its term is the constant again, and the shortest solution splits the intercept in two."""
    fits = model.fit(model.design(crossings(read).filter("direction = 'kbo_to_mlb'"), STATS))
    return rounded(fits, 5, *[c for c, kind in fits.dtypes if kind == "double"])


#: The held-out cohort through draws of the others, by the operator's own generator and noise.
TRAIN = f"(SELECT * FROM {DESIGN} WHERE cohort <> 'posted_from_kbo')"
TRAINED_DRAWS = fit_sql(HASH_RESAMPLED.replace(DESIGN, TRAIN), "which")


@query(f"""WITH n AS (SELECT stat, draw, b0, b1, b2, b3, {NOISE} AS noise FROM (SELECT *, split_part(which, ':', 1) AS stat, split_part(which, ':', 2) AS draw FROM {TRAINED_DRAWS})),
c AS (SELECT key, stat, age, u, v FROM {DESIGN} WHERE cohort = 'posted_from_kbo' AND direction = 'kbo_to_mlb'),
i AS (SELECT key, stat, any_value(v) AS v, quantile_cont(exp(b0 + b1 * ln(u) + b2 * (age - 27) / 10 + b3 + noise), 0.1) AS p10, quantile_cont(exp(b0 + b1 * ln(u) + b2 * (age - 27) / 10 + b3 + noise), 0.9) AS p90 FROM c JOIN n USING (stat) GROUP BY 1, 2)
SELECT key AS player_register_id, stat, round_even(p10, 3) AS p10, round_even(p90, 3) AS p90, v BETWEEN p10 AND p90 AS in_interval FROM i""")
def holdout_intervals(read: Read) -> DataFrame:
    cases = evaluate.holdout(crossings(read), "batting", stats=STATS, draws=DRAWS)
    return cases.select("player_register_id", "stat", "p10", "p90", "in_interval")


# Rules and labels


@query("""
WITH b AS (SELECT o_custkey, count(*)::BIGINT AS s, (min(o_custkey) % 20 + 18)::DOUBLE AS a, 2026::BIGINT AS y FROM orders GROUP BY 1), w AS (SELECT *, greatest(0, 7 - s) AS go FROM b),
e AS (SELECT *, y + go AS posting, (a + go >= 25 AND s + go >= 6) AS exempt, y + greatest(0, 9 - s) AS fa, y + greatest(0, 8 - s) AS overseas FROM w)
SELECT o_custkey, s AS seasons_played, go AS seasons_until_posting_eligible, posting AS earliest_posting_season, round(a + go, 1) AS age_at_earliest_posting, exempt AS bonus_pool_exempt_if_posted_then,
    CASE WHEN exempt THEN 0.0 ELSE round(greatest(0.0, 25 - (a + go)), 1) END::DOUBLE AS extra_years_for_pool_exemption, CASE WHEN exempt THEN 'market contract' ELSE 'pool-capped: bonus slot only' END AS note,
    fa AS domestic_fa_season, overseas AS overseas_fa_season, overseas AS needs_club_consent_until, s >= 9 AS past_first_fa, CASE WHEN s >= 9 THEN 0 ELSE greatest(0, fa - greatest(y, posting)) END AS acquisition_window_seasons,
    CASE WHEN s < 9 AND fa - greatest(y, posting) > 0 THEN greatest(y, posting) || '-' || (fa - 1) ELSE 'closed' END AS "window" FROM e
""")
def eligibility_rules(read: Read) -> DataFrame:
    people = read("orders").groupBy("o_custkey").agg(n_rows().alias("s"))
    rules = expr.eligibility(F.col("s"), (F.col("o_custkey") % 20 + 18).cast("double"), F.lit(2026).cast("long"))
    return people.select("o_custkey", *[c.alias(name) for name, c in rules.items()])


@query("""
SELECT p_partkey, lo > 0 AND hi / lo < 3 AS informative, CASE WHEN lo > 0 AND hi / lo < 3 AND r2 >= 0.10 THEN 'usable' WHEN NOT (lo > 0 AND hi / lo < 3) THEN 'too wide' ELSE 'league average regardless' END AS trust,
    CASE WHEN r2 >= 0.25 AND slope >= 0.3 THEN CASE WHEN exp(2 * 1.2816 * sd) > 3 THEN 'real pattern, too wide for one player' ELSE 'usable signal' END WHEN r2 >= 0.10 THEN 'weak signal' ELSE 'no usable signal' END AS verdict,
    round(exp(2 * 1.2816 * sd), 4) AS range_factor
FROM (SELECT p_partkey, (p_partkey % 5 + 1)::DOUBLE AS lo, (p_partkey % 11 + 1)::DOUBLE AS hi, (p_partkey % 50) / 100.0::DOUBLE AS r2, (p_partkey % 7) / 10.0::DOUBLE AS slope, (p_size % 10) / 10.0::DOUBLE AS sd FROM part)
""")
def trust_labels(read: Read) -> DataFrame:
    part = read("part").select("p_partkey", *[c.cast("double").alias(n) for n, c in {"lo": F.col("p_partkey") % 5 + 1, "hi": F.col("p_partkey") % 11 + 1, "r2": F.col("p_partkey") % 50 / 100.0, "slope": F.col("p_partkey") % 7 / 10.0, "sd": F.col("p_size") % 10 / 10.0}.items()])
    narrow = expr.informative(F.col("lo"), F.col("hi"))
    return part.select("p_partkey", narrow.alias("informative"), expr.trust(narrow, F.col("r2")).alias("trust"), expr.verdict(F.col("r2"), F.col("slope"), F.col("sd")).alias("verdict"), F.round(expr.range_factor(F.col("sd")), 4).alias("range_factor"))


OUTS = "CASE WHEN f IN (0, 1, 2) THEN w * 3 + f ELSE round(ip * 3, 2) END"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, ip, {OUTS} AS outs, floor({OUTS} / 3) + ({OUTS} % 3) / 10 AS innings FROM (SELECT *, floor(ip) AS w, round((ip - floor(ip)) * 10) AS f FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 10 AS ip FROM lineitem))")
def innings_outs(read: Read) -> DataFrame:
    ip = F.col("l_quantity") / 10
    return read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ip.alias("ip"), expr.outs(ip, 2).alias("outs"), expr.innings(expr.outs(ip, 2)).alias("innings"))


@query("""
SELECT count(DISTINCT l_suppkey) AS players, count(DISTINCT CASE WHEN n >= 100 THEN l_suppkey END) AS qualified, count(*) AS player_seasons, count(*) FILTER (n >= 100) AS qualified_seasons
FROM (SELECT l_suppkey, year(l_shipdate) AS yr, count(*) AS n FROM lineitem GROUP BY 1, 2)
""")
def sample_sizes(read: Read) -> DataFrame:
    seasons = read("lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("yr")).agg(n_rows().alias("n"))
    return timeline.sample_sizes(seasons, "l_suppkey", "n", 100)


# Rates of both sides, of line items as season rows


SEASONS = """(SELECT l_suppkey, year(l_shipdate) AS season, sum(l_quantity)::BIGINT AS PA, floor(sum(l_quantity) * 0.9)::BIGINT AS AB, count(*) AS H, count(*) FILTER (l_returnflag = 'R') AS SO, count(*) FILTER (l_returnflag = 'A') AS BB,
    count(*) FILTER (l_linestatus = 'O' AND l_quantity > 40) AS HR, count(*) FILTER (l_linenumber > 5) AS HBP, count(*) FILTER (l_discount > 0.09) AS SF, sum(l_linenumber)::BIGINT AS TB, count(*) FILTER (l_tax > 0.05) AS ER FROM lineitem GROUP BY 1, 2)"""


def ratio_sql(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN ({num}) / ({den})::DOUBLE END"


RATE_SQL = {
    "batting": {
        "k_pct": ratio_sql("SO", "PA"), "bb_pct": ratio_sql("BB", "PA"), "hr_pct": ratio_sql("HR", "PA"), "avg": ratio_sql("H", "AB"), "obp": ratio_sql("H + BB + HBP", "(AB + BB + HBP + SF)"),
        "slg": ratio_sql("TB", "AB"), "iso": ratio_sql("TB", "AB") + " - " + ratio_sql("H", "AB"), "babip": ratio_sql("H - HR", "(AB - SO - HR + SF)"),
    },
    "pitching": {"k_pct": ratio_sql("SO", "PA"), "bb_pct": ratio_sql("BB", "PA"), "hr_pct": ratio_sql("HR", "PA"), "h_pct": ratio_sql("H", "PA"), "era": ratio_sql("ER * 27", "(PA // 3 * 3 + PA % 3)")},
}
SUMMED = "(SELECT season, " + ", ".join(f"sum({c}) AS {c}" for c in ("PA", "AB", "H", "SO", "BB", "HR", "HBP", "SF", "TB", "ER")) + f" FROM {SEASONS} GROUP BY 1)"


def season_rows(read: Read) -> DataFrame:
    when = {"SO": F.col("l_returnflag") == "R", "BB": F.col("l_returnflag") == "A", "HR": (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40), "HBP": F.col("l_linenumber") > 5, "SF": F.col("l_discount") > 0.09, "ER": F.col("l_tax") > 0.05}
    sums = {"PA": long(F.sum("l_quantity")), "AB": long(F.floor(F.sum("l_quantity") * 0.9)), "H": n_rows(), "TB": F.sum("l_linenumber").cast("long"), **{c: F.count_if(x) for c, x in when.items()}}
    rows = read("lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("season")).agg(*[x.alias(c) for c, x in sums.items()])
    return rows.withColumns({"batters_faced": F.col("PA"), "IP": expr.innings(F.col("PA").cast("double"))})


def relative_sql(side: str) -> str:
    own, league = (", ".join(f"{x} AS {p}{r}" for r, x in RATE_SQL[side].items()) for p in ("", "lg_"))
    said = ", ".join(f"round({c}, 6) AS {c}" for r in RATE_SQL[side] for c in (r, f"lg_{r}")) + ", " + ", ".join(f"round(CASE WHEN lg_{r} > 0 THEN {r} / lg_{r} END, 6) AS rel_{r}" for r in RATE_SQL[side])
    return f"SELECT l_suppkey, season, {said} FROM (SELECT l_suppkey, season, {own} FROM {SEASONS} WHERE PA >= 100) JOIN (SELECT season, {league} FROM {SUMMED}) USING (season)"


def sided_rates(read: Read, side: str) -> DataFrame:
    rows = season_rows(read)
    out = rates.relative_rates(rows, rates.league_rates(rows.drop("l_suppkey"), side), side, 100)
    names_of = [p + r for p in ("", "lg_", "rel_") for r in expr.RATE_SETS[side]]
    return rounded(out, 6, *names_of).select("l_suppkey", F.col("season").cast("long").alias("season"), *names_of)


@query(relative_sql("batting"))
def batting_rates(read: Read) -> DataFrame:
    return sided_rates(read, "batting")


@query(relative_sql("pitching"))
def pitching_rates(read: Read) -> DataFrame:
    return sided_rates(read, "pitching")


# Names, text, pages


SURNAME_SQL = "CASE " + " ".join(f"WHEN t IN ({', '.join(repr(s) for s in spellings)}) THEN '{tag}'" for tag, spellings in names.SURNAMES.items()) + " END"
PARTS_SQL = "SELECT p_partkey, p_name, lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', 2)) AS b FROM part"


def loose_sql(token: str) -> str:
    for a, b in names.LOOSE_STEPS:
        token = f"replace({token}, '{a}', '{b}')"
    token = f"regexp_replace({token}, 'h$', '')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        token = f"regexp_replace({token}, '{c}{c}+', '{c}', 'g')"
    return f"replace({token}, 'u', 'o')"


@query(f"SELECT p_partkey, '|' || least(a, b) || greatest(a, b) AS strict_key FROM ({PARTS_SQL})")
def strict_key(read: Read) -> DataFrame:
    """Part names have no surname of the table, so their keys are their sorted words."""
    return read("part").select("p_partkey", names.keys("p_name", "strict")["strict"].alias("strict_key"))


@query(f"SELECT p_partkey, '|' || least(x, y) || greatest(x, y) AS loose_key, x AS first_token FROM (SELECT p_partkey, {loose_sql('a')} AS x, {loose_sql('b')} AS y FROM ({PARTS_SQL}))")
def loose_key(read: Read) -> DataFrame:
    native = names.loose_token(F.split_part("p_name", F.lit(" "), F.lit(1)))
    return read("part").select("p_partkey", names.keys("p_name", "loose")["loose"].alias("loose_key"), native.alias("first_token"))


@query(f"SELECT c_custkey, {SURNAME_SQL} AS surname_class FROM (SELECT c_custkey, ['lee', 'yi', 'gim', 'kwon', 'yuh', 'smith', 'chon', 'paik'][c_custkey % 8 + 1] AS t FROM customer)")
def surname_class(read: Read) -> DataFrame:
    spelling = F.get(F.array(*map(F.lit, ("lee", "yi", "gim", "kwon", "yuh", "smith", "chon", "paik"))), (F.col("c_custkey") % 8).cast("int"))
    return read("customer").select("c_custkey", expr.lookup(names.CLASS_OF, spelling).alias("surname_class"))


@query(r"SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(c_name || ' (note)*#', '\([^)]*\)', ' ', 'g'), '[*#+]', ' ', 'g'), '\s+', ' ', 'g'), ' ,.') AS clean FROM customer")
def name_clean(read: Read) -> DataFrame:
    return read("customer").select("c_custkey", names.clean(F.concat("c_name", F.lit(" (note)*#"))).alias("clean"))


HANGUL = (("이정후", "i jeong hu"), ("류현진", "ryu hyeon jin"), ("김하성", "gim ha seong"), ("추신수", "chu sin su"), ("강정호", "gang jeong ho"), ("박병호", "bak byeong ho"), ("Lee", "Lee"))


@query(f"SELECT c_custkey % 7 AS k, count(*) AS n, ['" + "', '".join(h for h, _ in HANGUL) + "'][c_custkey % 7 + 1] AS said, ['" + "', '".join(r for _, r in HANGUL) + "'][c_custkey % 7 + 1] AS roman, c_custkey % 7 < 6 AS is_hangul FROM customer GROUP BY ALL")
def hangul_romanize(read: Read) -> DataFrame:
    said = F.get(F.array(*[F.lit(h) for h, _ in HANGUL]), F.col("k").cast("int"))
    rows = read("customer").groupBy((F.col("c_custkey") % 7).alias("k")).agg(n_rows().alias("n")).withColumn("said", said)
    return rows.select("k", "n", "said", names.romanized(F.col("said")).alias("roman"), names.has_hangul(F.col("said")).alias("is_hangul"))


@query("SELECT doc_id, sha256(strip_accents(text)) AS plain_sha256 FROM documents")
def accent_strip(read: Read) -> DataFrame:
    return read("documents").select("doc_id", F.sha2(names.plain(F.col("text")), 256).alias("plain_sha256"))


@query(r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href="[^"]*"'))::BIGINT AS n_links, coalesce(regexp_extract_all(html, 'href="([^"]*)"', 1)[1], '') AS first_link,
    len(regexp_extract_all(html, '(?s)<!--.*?-->'))::BIGINT AS n_comments, substr(sha256(url), 1, 20) || '.html' AS page FROM pages
""")
def html_fields(read: Read) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return read("pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), long(F.size(links)).alias("n_links"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"),
        long(F.size(F.regexp_extract_all("html", F.lit("(?s)<!--.*?-->"), F.lit(0)))).alias("n_comments"), page_key(F.col("url")).alias("page"),
    )


@query("SELECT event_id, event_type, (props->>'$.k')::BIGINT AS k FROM events WHERE coalesce((props->>'$.k')::BIGINT, 0) >= 10")
def json_flatten(read: Read) -> DataFrame:
    parsed = F.from_json("props", "k long", {"mode": "PERMISSIVE"})
    return read("events").select("event_id", "event_type", parsed["k"].alias("k")).filter(F.coalesce("k", F.lit(0)) >= 10)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(min(l_extendedprice), 2) AS low, round(max(l_extendedprice), 2) AS high, round(stddev_samp(l_quantity), 6) AS spread FROM lineitem GROUP BY 1, 2")
def grouped_summary(read: Read) -> DataFrame:
    return read("lineitem").groupBy("l_returnflag", "l_linestatus").agg(n_rows().alias("n"), F.round(F.min("l_extendedprice"), 2).alias("low"), F.round(F.max("l_extendedprice"), 2).alias("high"), F.round(F.stddev_samp("l_quantity"), 6).alias("spread"))


@query("SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
def multi_percentile(read: Read) -> DataFrame:
    out = orderstat.quantiles(read("lineitem"), "l_extendedprice", model.LEVELS, ["l_suppkey"])
    return out.select("l_suppkey", *[F.round(F.get("q", F.lit(i)), 4).alias(f"p{round(q * 100)}") for i, q in enumerate(model.LEVELS)])
