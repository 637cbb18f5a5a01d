"""Audit of sources: which of a language's sources differ, and by which terms.

Terms are counted in one pass over the texts, summed in the task first. Groups of a language and a source
have smoothed shares of each term that the language keeps; where a group lacks a term its share is one
constant, the baseline. So the divergence of two sources over all kept terms is that of their baselines times
the number of terms, corrected at the terms that either has: by the histogram of its shares against the
other's baseline, and once more at terms that both have. No dense table of sources and terms is made.

The first ranks of many terms are found by radix selection: histograms over the high bits of values find the
bits of each group's kth value, 16 at a time; where more rows tie than a sort should take, histograms over
the bytes of terms go on, from where the least and the greatest of them differ.

All counts, shares and sums are whole numbers.
"""

from __future__ import annotations

import os
from collections import Counter
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallax.llm.common import BROADCAST_ROWS, SALTS, ArrowBatches, forget, ready, stored

# Least documents of a kept term, scale of shares, ranks of terms.
LEAST_DOCS, SCALE, RANKS = 3, 1_000_000_000, 200
#: Bytes of a text that are split at a time, counts that a task holds before it hands them on, and in batches of how many.
SLICE, HELD, ROWS = 4 << 20, 600_000, 1 << 16
#: Bits and bytes that a pass decides, and tied rows of a group that a sort may take.
BITS, BYTES, TIED = 16, 2, 4096
#: Bytes to what splits terms, or to lower case; bytes over 127 are parts of letters.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
GROUP = ["lang", "source"]


def terms_of(text: bytes):
    """Lists of the terms of a text in UTF-8: lower-cased runs of letters and of all that is not ASCII."""
    at, rest = 0, b""
    while at < len(text):
        part = rest + text[at : at + SLICE].translate(LOWER)
        at += SLICE
        cut = len(part) if at >= len(text) else part.rfind(b" ") + 1
        rest = part[cut:]
        yield part[:cut].split()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, in parts to be summed; nulls are empty."""

    def run(batches: ArrowBatches) -> ArrowBatches:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> ArrowBatches:
            rows = ((*group, term, n, within[term]) for group, (total, within) in held.items() for term, n in total.items())
            while part := list(islice(rows, ROWS)):
                lang, source, term, n, docs = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for text, *group in zip(batch.column("text").cast(pa.binary()).to_pylist(), *(batch.column(c).to_pylist() for c in GROUP), strict=True):
                total, within = held.setdefault(tuple(group), (Counter(), Counter()))
                before, own = len(total), set()
                for words in terms_of(text):
                    total.update(words)
                    own.update(words)
                within.update(own)
                size += len(total) - before
                if size >= HELD:
                    yield from out()
                    size = 0
        yield from out()

    said = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", *GROUP)])
    return said.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def beside(rows: DataFrame, table: DataFrame, n: int, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with a table of ``n`` rows: broadcast up to a count, else with rows of one key dealt by ``by``."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit(13), by), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def share(n: str, d: str) -> Column:
    """1 + floor(SCALE * (n + 1) / d)."""
    return F.expr(f"1 + (CAST({n} + 1 AS DECIMAL(20, 0)) * {SCALE}) div {d}")


def gain(p: str, q: str) -> str:
    """floor((p - q)^2 / q); at most 10^18, and a group's sum over terms no more than a few of it."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def shares(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Stored tables: (lang, source, term, p, q, p0) of the terms that groups have, (lang, source, v, p0) of all groups; the latter's rows.

    p: the group's share, q: the language's, p0: the group's baseline (null where the language keeps no term), v: kept terms.
    """
    within = Window.partitionBy("lang", "term")
    sums = counted(docs).repartition("lang", "term").groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = sums.withColumns({"_docs": F.sum("docs").over(within), "m": F.sum("n").over(within), "first": F.col("source") == F.min("source").over(within)})
    kept = stored(kept.filter(F.col("_docs") >= LEAST_DOCS).drop("_docs", "docs"), "kept")
    of_group = kept.groupBy(*GROUP).agg(F.sum("n").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("m"), F.count_if("first").alias("v"))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in GROUP]).distinct().join(of_group, GROUP, "left").join(of_lang, "lang", "left")
    groups = groups.select(*GROUP, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "m", "v")])
    some = F.col("v") > 0
    groups = stored(groups.withColumns({"d": F.when(some, F.col("n") + F.col("v")), "dl": F.when(some, F.col("m") + F.col("v"))}).withColumn("p0", F.when(some, share("0L", "d"))).drop("n", "m"), "groups")
    n_groups = groups.count()
    found = beside(kept, groups, n_groups, GROUP, "term").select(*GROUP, "term", share("n", "d").alias("p"), share("m", "dl").alias("q"), "p0")
    found = stored(found, "shares")
    forget(kept)
    return found, groups.drop("d", "dl"), n_groups


def divergences(found: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """(lang, source, item, q, value): each source's divergence from each other one, over all kept terms of their language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0"), "v")
    base = beside(groups.drop("v"), other, n_groups, ["lang"], "source").filter("source <> item")
    base = base.select("lang", "source", "item", F.expr(f"coalesce(v * {gain('p0', 'b0')}, 0L)").alias("value"))
    # Terms that the one has, as if the other had none of them: by how many terms have each share.
    spread = found.groupBy(*GROUP, "p", "p0").agg(F.count(F.lit(1)).alias("k"))
    spread = beside(spread, other.drop("v"), n_groups, ["lang"], "p").filter("source <> item")
    own = F.struct("source", "item", F.expr(f"k * ({gain('p', 'b0')} - {gain('p0', 'b0')})").alias("value"))
    theirs = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"k * ({gain('b0', 'p')} - {gain('b0', 'p0')})").alias("value"))
    spread = spread.select("lang", F.explode(F.array(own, theirs)).alias("_c")).select("lang", "_c.*")
    # Terms that both have: what the two corrections above got wrong. A term's list has a row for each source at most.
    both = found.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("held")).filter(F.size("held") > 1)
    both = both.select("lang", "held", F.explode("held").alias("a")).select("lang", "a", F.explode("held").alias("b")).filter("a.source <> b.source")
    right = f"{gain('a.p', 'b.p')} - {gain('a.p', 'b.p0')} - {gain('a.p0', 'b.p')} + {gain('a.p0', 'b.p0')}"
    both = both.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.expr(right).alias("value"))
    return base.unionByName(spread).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def high(value: Column | str, shift: str) -> Column:
    return F.expr(f"shiftright({value}, {shift})")


def largest(rows: DataFrame, n: int, k: int = RANKS, tied: int = TIED, by: tuple[str, ...] = tuple(GROUP), value: str = "value", item: str = "item") -> DataFrame:
    """Rows of the first ``k`` ranks of each group, with ``rank`` from 1: by value (0 or more) descending, then the UTF-8 bytes of item.

    ``n``: the number of groups. ``rows`` is read once a pass and should be cheap or stored. Each group's state is a row: the
    bits ``prefix`` of its kth value over ``shift``, and ``need``, how many rows with these bits are wanted; where those tie in all bits,
    also the first ``width`` bytes of the kth of them. Rows of repeated items tie, and any of them may count.
    """
    by = list(by)
    bits = F.greatest(F.length(F.bin("most")) - BITS, F.lit(0)).cast("int")
    state = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("most")).filter(F.col("n") > k + tied)
    state = state.select(*by, F.lit(k).cast("long").alias("need"), F.lit(63).alias("shift"), F.lit(0).cast("long").alias("prefix"), bits.alias("next"))
    state = stored(state, "select")
    done = []
    while not state.isEmpty():
        within = beside(rows.select(*by, value, item), state, n, by, item).filter(high(value, "shift") == F.col("prefix"))
        bins = within.groupBy(*by, "need", "next", high(value, "next").alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        decided = stored(crossed(bins, by, F.desc("prefix")).select(*by, "need", F.col("next").alias("shift"), "prefix", "n"), "select")
        forget(state)
        done.append(decided.filter((F.col("n") <= tied) | (F.col("shift") == 0)))
        state = stored(decided.filter((F.col("n") > tied) & (F.col("shift") > 0)).withColumn("next", F.greatest(F.col("shift") - BITS, F.lit(0))).drop("n"), "select")
    forget(state)
    if not done:
        bounds = None
    else:
        bounds = done[0]
        for d in done[1:]:
            bounds = bounds.unionByName(d)
        bounds = ties_refined(rows, bounds, n, k, tied, by, value, item)
    kept = rows
    if bounds is not None:
        over = high(value, "shift") > F.col("prefix")
        at = (high(value, "shift") == F.col("prefix")) & (F.col("width").isNull() | (F.substring(F.col(item).cast("binary"), 1, F.col("width")) <= F.col("start")))
        kept = beside(rows, bounds.withColumn("_bound", F.lit(True)), n, by, item, "left").filter(F.col("_bound").isNull() | over | at).select(*rows.columns)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), F.col(item).cast("binary")))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k)


def crossed(bins: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The bin of each group in which its ``need``-th row is, with ``need`` less what is in the bins before."""
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return bins.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("need")) & (F.col("_upto") - F.col("n") < F.col("need"))).withColumn("need", F.col("need") - F.col("_upto") + F.col("n")).drop("_upto")


def ties_refined(rows: DataFrame, bounds: DataFrame, n: int, k: int, tied: int, by: list[str], value: str, item: str) -> DataFrame:
    """(by, shift, prefix, width, start): groups of ``bounds`` with more than ``tied`` rows of the kth value get the first ``width`` bytes of the kth of these."""
    bytes_of = F.col(item).cast("binary")
    narrow = bounds.withColumns({"width": F.lit(None).cast("int"), "start": F.lit(None).cast("binary")})
    done = [narrow.filter(F.col("n") <= tied).drop("n", "need")]
    state = stored(narrow.filter(F.col("n") > tied).drop("n").withColumns({"width": F.lit(0), "start": F.lit(b"")}), "ties")
    while not state.isEmpty():
        within = beside(rows.select(*by, value, item), state, n, by, item).filter((F.col(value) == F.col("prefix")) & (F.substring(bytes_of, 1, F.col("width")) == F.col("start")))
        # The bytes that all of a group's ties share are passed over; equal items end the search.
        ends = within.groupBy(*by).agg(F.min(bytes_of).alias("_least"), F.max(bytes_of).alias("_most"))
        ends = ends.select(*by, (F.udf(shared_bytes, T.IntegerType())("_least", "_most") + BYTES).alias("next"), (F.col("_least") == F.col("_most")).alias("same"))
        bins = beside(within, ends, n, by, item).groupBy(*by, "need", "shift", "prefix", "next", "same", F.substring(bytes_of, 1, F.col("next")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
        decided = stored(crossed(bins, by, F.asc("start")).withColumnRenamed("next", "width"), "ties")
        ready_now = (F.col("n") <= tied) | F.col("same") | (F.length("start") < F.col("width"))
        done.append(decided.filter(ready_now).select(*by, "shift", "prefix", "width", "start"))
        following = stored(decided.filter(~ready_now).drop("n", "same"), "ties")
        forget(state)
        state = following
    forget(state)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d.select(*out.columns))
    return out


def shared_bytes(a: bytes, b: bytes) -> int:
    return len(os.path.commonprefix([bytes(a), bytes(b)]))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source), nulls empty; other columns are not read.

    ``pair``: every other source of the language with the divergence from it; ``term``: the terms with the largest gains over the
    language, up to rank 200. An empty table gives no rows; a language without kept terms gives pairs of value 0.
    """
    ready(docs.sparkSession)
    found, groups, n_groups = shares(docs)
    pairs = divergences(found, groups, n_groups)
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), F.col("item").cast("binary")))
    pairs = pairs.select(*GROUP, F.lit("pair").alias("part"), "item", "value", place.alias("rank"))
    gains = found.filter("p > q").select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gain("p", "q")).alias("value"))
    return pairs.unionByName(largest(gains, n_groups))
