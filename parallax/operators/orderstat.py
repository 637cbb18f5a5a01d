"""Exact order statistics of groups of any size: no task holds the values of a group.

A span is an open interval of a group's values in which wanted ranks lie; at first it is the whole group. Of
a span with many rows a sketch of bounded size gives splitters, rows are counted by the range between two splitters or
by the splitter they equal, and the wanted ranks are looked up in the running counts. A rank that falls on
a splitter is found, however many rows tie there; the others lie in narrower spans, until these are few
enough to be numbered in order. Each pass makes a span some 256 times smaller, and reads its rows alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax.sources.stored import stored

#: Rows of a span that one task may sort; splitters of a span (a power of two, less one) and how exact their sketch is.
FEW = 1 << 16
#: Rows that a task sorts to number them.
TASK_ROWS = 500_000
SPLITTERS, ACCURACY = 255, 2048
#: Rows of spans that are broadcast to the values, of at most 100 bytes each, and what their rows are repeated by beyond.
BROADCAST_ROWS, SALTS = 50_000, 32


def with_spans(values: DataFrame, spans: DataFrame, n: int) -> DataFrame:
    """Values in the spans of their group; a group's values are dealt by what they are, never all one task's."""
    if n <= BROADCAST_ROWS:
        found = values.join(F.broadcast(spans), "g")
    else:
        salted = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = values.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["g", "salt"]).drop("salt")
    return found.filter((F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high"))))


def narrowed(values: DataFrame, spans: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Where the wanted ranks of large spans lie: (g, rank, value) or, without value, (g, low, high, first, n) of a narrower span."""
    own = ["g", "low", "high", "first"]
    within = with_spans(values, spans.select(*own), n)
    levels = F.array(*[F.lit((i + 1) / (SPLITTERS + 1)) for i in range(SPLITTERS)])
    sketches = within.groupBy(*own).agg(F.percentile_approx("v", levels, ACCURACY).alias("s"))
    placed = with_spans(values, sketches, n).withColumn("i", F.lit(0))
    step = (SPLITTERS + 1) // 2
    while step:  # a binary search for the number of splitters below a value
        placed = placed.withColumn("i", F.col("i") + F.when(F.element_at("s", F.col("i") + step) < F.col("v"), step).otherwise(0))
        step //= 2
    at, below = F.get("s", F.col("i")), F.get("s", F.col("i") - 1)
    same = F.coalesce(at == F.col("v"), F.lit(False))
    counts = placed.groupBy(*own, "i", same.alias("same"), F.when(same, at).otherwise(F.coalesce(below, "low")).alias("a"), F.when(same, at).otherwise(F.coalesce(at, "high")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*own).orderBy("i", "same").rowsBetween(Window.unboundedPreceding, 0))  # an order of 511 rows at most
    bins = counts.withColumn("start", F.col("first") + upto - F.col("n"))
    hit = wanted.join(bins, "g").filter((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("n")))
    return hit.select("g", "rank", F.when(F.col("same"), F.col("a")).alias("value"), F.col("a").alias("low"), F.col("b").alias("high"), F.col("start").alias("first"), "n", "same")


def order_statistics(values: DataFrame, sizes: DataFrame, wanted: DataFrame, few: int = FEW) -> DataFrame:
    """(g, rank, value) for ``wanted`` (g, rank from 0) of ``values`` (g, v), of which ``sizes`` has the rows by group (g, n).

    ``values`` is read once or twice a pass and should be stored; null values are no rows. NaN is the largest value.
    """
    kind = values.schema["v"].dataType
    none = F.lit(None).cast(kind)
    every = sizes.select("g", none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"))
    found, small = [], []
    left = wanted
    large = stored(every.filter(F.col("n") > few), "spans")
    n = n_large = large.count()
    hot = large.select("g")
    while n:
        hits = stored(narrowed(values, large, left, n), "ranks")
        found.append(hits.filter("same").select("g", "rank", "value"))
        spans = hits.filter("NOT same").select("g", "low", "high", "first", "n").distinct()
        small.append(spans.filter(F.col("n") <= few))
        left = stored(hits.filter(~F.col("same") & (F.col("n") > few)).select("g", "rank"), "wanted")
        large = stored(spans.filter(F.col("n") > few), "spans")
        n = large.count()
    # Groups that are small as a whole are numbered by themselves; the rows of others stay where they are, if these can be broadcast.
    rest = values.join(F.broadcast(hot), "g", "left_anti") if 0 < n_large <= BROADCAST_ROWS else values
    ranks = every.filter(F.col("n") <= few).select("g").join(wanted, "g").groupBy("g").agg(F.collect_list("rank").alias("ranks"))
    n_rest = every.filter(F.col("n") <= few).agg(F.sum("n")).first()[0] or 0
    # Both are dealt by the number of rows, else the join deals them anew; it hashes the ranks, a row for each group.
    rest, ranks = (by_rows(df, n_rest, "g") for df in (rest, ranks))
    found.append(numbered(rest.join(ranks.hint("shuffle_hash"), "g"), ["g"], F.lit(0)))
    if small:
        spans = stored(reduce(DataFrame.unionByName, small).join(wanted.groupBy("g").agg(F.collect_list("rank").alias("ranks")), "g"), "spans")
        n, rows = spans.agg(F.count(F.lit(1)), F.sum("n")).first()
        if n:
            found.append(numbered(by_rows(with_spans(values, spans.drop("n"), n), rows, "g", "first"), ["g", "first"], F.col("first")))
    return reduce(DataFrame.unionByName, found)


def by_rows(values: DataFrame, n: int, *by: str) -> DataFrame:
    """``values``, of which n are sorted, dealt to as many tasks as keeps a sort small."""
    return values.repartition(-(-n // TASK_ROWS), *by) if n > TASK_ROWS else values


def numbered(values: DataFrame, by: list[str], first: Column) -> DataFrame:
    """(g, rank, value) of few values in order, from ``first`` on, where ``ranks`` has the rank."""
    place = first + F.row_number().over(Window.partitionBy(*by).orderBy("v")) - 1
    return values.withColumn("rank", place.cast("long")).filter(F.array_contains("ranks", F.col("rank"))).select("g", "rank", F.col("v").alias("value"))


def quantiles(rows: DataFrame, column: str, levels: tuple[float, ...] | list[float], by: tuple[str, ...] | list[str] = (), few: int = FEW) -> DataFrame:
    """(by, q): exact quantiles of a numeric column by group, an array in the order of ``levels``, interpolated as ``percentile`` does.

    Null values do not count; groups without values have no row, null keys are a group. Levels may repeat. What is counted is
    stored first, so that ``rows`` is computed once.
    """
    by = list(by)
    key = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    values = stored(rows.select(key.alias("g"), F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull()), "values")
    sizes = stored(values.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    at = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for i, q in enumerate(levels)])
    places = sizes.select("g", F.explode(at).alias("p")).select("g", "p.i", "p.at").withColumns({"lo": F.floor("at").cast("long"), "hi": F.ceil("at").cast("long")})
    wanted = stored(places.select("g", F.explode(F.array("lo", "hi")).alias("rank")).distinct(), "wanted")
    found = order_statistics(values, sizes, wanted, few)
    return interpolated(places, found, len(levels)).select(*[F.col("g")[c].alias(c) for c in by], "q")


def interpolated(places: DataFrame, found: DataFrame, levels: int) -> DataFrame:
    """(g, q) of places (g, i, at, lo, hi) between the values found for ranks; a group has two rows for each level at most."""
    known = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("known"))
    low, high = F.try_element_at("known", F.col("lo")), F.try_element_at("known", F.col("hi"))
    value: Column = F.when((F.col("lo") == F.col("hi")) | (low == high), low).otherwise((F.col("hi") - F.col("at")) * low + (F.col("at") - F.col("lo")) * high)
    each = places.join(known, "g").select("g", "i", value.alias("value"))
    return each.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("q"))
