"""MinHash near-duplicates by a chosen-path similarity join.

A document is the set of its word shingles; documents with a Jaccard likeness of ``SIMILAR`` percent or
more are linked, and linked documents, directly or through others, form a component.

1. Every document gets its shingles' minimum hashes: ``COORDINATES`` for branching, and one bit each of
   ``BITS`` for a sketch. Documents of equal sets go on as one representative.
2. ``TREES`` independent trees branch them: a node sends a document down two paths, each chosen by
   one minwise token (coordinate) of it. At 75 percent likeness, a pair shares the first level of
   at least one of 6 trees but for 6e-8 of the cases, and any depth but for about 2e-6.
3. Nodes of at most ``LEAF`` documents are compared exhaustively, by size and sketch (a linked pair fails
   that with a chance under 1e-8). Only a spanning forest of what may be linked goes on: candidates.
   Larger nodes compare all with one pivot. What then is outside the pivot's candidate cluster is compared with
   all of the node, block by block, where it is at most ``OUTSIDERS`` documents; where it is more, the node
   branches again. Beyond ``DEPTH``, all of the node joins one cluster: that is only more to compare.
4. Links lie within candidate clusters. Each cluster of at most ``CELL`` documents is one cell, to which
   whole texts are sent once, and where all full sets are compared exactly. A larger cluster is dealt
   to cells by hash, each with the same few pivots. Everything outside the cluster's largest component then
   meets all of the cluster again, block by block, by sketches of ``LONG_BITS`` bits; only where these
   allow a link do whole texts meet. Cells give spanning forests of links.

Joins on nodes and clusters, whose rows may be a third of all, have one row a key on the right: it is broadcast
where it was counted to be small, and else repeated for salts (``common.keyed``). No step makes
all pairs of a group as rows, gathers a group of unbounded size in a task, or brings documents, links or
components to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax.llm import common
from parallax.llm.common import forget, mix64, null_to_empty, ready, stored

WORDS = 5
SIMILAR = 75
TREES = 6
BRANCHES = 2
COORDINATES = 64
BITS = 512
LEAF = 256
DEPTH = 4
OUTSIDERS = 4096
CELL = 256
PIVOTS = 32
#: Documents on either side of a block of sketches, and of a block of texts within it.
BLOCK, SUBBLOCK = 1024, 128
#: Sketch bits that agree: 448 of 512 and 1792 of 2048 expected at 75 percent; six standard deviations less.
LEAST_BITS = 403
LONG_BITS, LEAST_LONG = 2048, 1702
SKETCH = [f"s{i}" for i in range(BITS // 64)]
LONGS = ", ".join(f"{c} long" for c in SKETCH)
#: As many edges are joined in one task (a few MB); more by stars.
LOCAL_EDGES = 500_000
#: Most slots of the filter that keeps texts without candidates from being shuffled; bounds its size.
FILTER_SLOTS = 1 << 25

RNG = np.random.default_rng(20240229)
FACTORS = RNG.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def permutations(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (RNG.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1))[:, None], RNG.integers(0, 2**32 - 1, n, np.uint32)[:, None], np.arange(n, dtype=np.uint64) << np.uint64(32)


HASHES, LONG_HASHES = permutations(BITS), permutations(LONG_BITS)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of five-word shingles, or of all words where there are fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: lowers A-Z, splits at ASCII space
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(w))
    n = len(w) - k + 1
    sums = np.full(n, np.uint64(k))
    for j in range(k):
        sums += w[j : j + n] * FACTORS[j]
    return np.unique(mix64(sums))


def minhashes(hashes: np.ndarray, by: tuple[np.ndarray, np.ndarray, np.ndarray] = HASHES) -> np.ndarray:
    multiply, flip, own = by
    lows = np.full(len(own), np.uint32(2**32 - 1))
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        part = short[at : at + 512] ^ flip
        part *= multiply
        np.minimum(lows, part.min(axis=1), out=lows)
    return mix64(lows.astype(np.uint64) + own)


def top_bits(lows: np.ndarray) -> np.ndarray:
    return np.packbits((lows >> np.uint64(63)).astype(np.uint8))


def signature(hashes: np.ndarray) -> tuple:
    """Two longs that name the set, longs of sketch bits, and 32 bits of each branching coordinate."""
    lows = minhashes(hashes)
    name = np.array([hashes.sum(dtype=np.uint64), mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).view(np.int64)
    return *name.tolist(), *top_bits(lows).view(np.int64).tolist(), (lows[:COORDINATES] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, a, b, sketch, sig) of (doc_id, text); ids go through untouched, null ones too."""
    names = ["n", "a", "b", *SKETCH, "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(hashes), *signature(hashes)) for t in batch.column(1) for hashes in [shingles(t.as_py())]]
            columns = [pa.array(c, pa.binary() if name == "sig" else pa.int64()) for name, c in zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n long, a long, b long, {LONGS}, sig binary")


# Branching


def coordinate(at: Column) -> Column:
    return F.substr(F.col("sig"), at * 4 + 1, F.lit(4))


def first_paths(reps: DataFrame) -> DataFrame:
    """(node, rep, n, sketch): the nodes of the first level of all trees."""
    nodes = [F.xxhash64(F.lit(at // BRANCHES), F.lit(at), coordinate(F.lit(at))) for at in range(TREES * BRANCHES)]
    return reps.select(F.explode(F.array(*nodes)).alias("node"), "rep", "n", *SKETCH)


def next_paths(members: DataFrame) -> DataFrame:
    """One level down of (node, rep, n, sketch, sig); a node's hash chooses its coordinates."""
    chosen = [F.pmod(F.xxhash64(F.lit(7), "node") + branch * 37, F.lit(COORDINATES)).cast("int") for branch in range(BRANCHES)]
    nodes = [F.xxhash64("node", at, coordinate(at)) for at in chosen]
    return members.select(F.explode(F.array(*nodes)).alias("node"), "rep", "n", *SKETCH)


def keyed(rows: DataFrame, table: DataFrame, n: int, key: str, how: str = "inner") -> DataFrame:
    return common.keyed(rows, table, n, key, "rep", how)


def may_link(n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Pairs of a small node that sizes and sketches allow to be linked."""
    agree = BITS - np.bitwise_count(bits[:, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64)
    return (agree >= LEAST_BITS) & (100 * np.minimum.outer(n, n) >= SIMILAR * np.maximum.outer(n, n))


def forest(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """A star for each component of a small graph: (id, smallest id)."""
    linked = linked | np.eye(len(ids), dtype=bool)
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), np.int64)
    label[order] = np.arange(len(ids))
    while True:
        low = np.where(linked, label[None, :], len(ids)).min(axis=1)
        low = np.minimum(low, label)
        if (low == label).all():
            break
        label = low
    root = ids[order][label]
    return [(int(i), int(r)) for i, r in zip(ids, root, strict=True) if i != r]


def groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole runs of equal keys of a sorted partition; holds one batch and one run."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        parts = [pdf.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True)]
        if held and held[-1][key].iloc[0] == keys[0]:
            held.append(parts.pop(0))
            if not parts:
                continue
        if held:
            yield pd.concat(held)
        yield from parts[:-1]
        held = parts[-1:]
    if held:
        yield pd.concat(held)


def small_nodes(rows: DataFrame) -> DataFrame:
    """Edges (u, v) of candidate forests of the nodes of (node, rep, n, sketch), compared exhaustively."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf])
            keys = pdf["node"].to_numpy()
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            held, pdf = pdf.iloc[last:], pdf.iloc[:last]
            yield edges(pdf)
        if held is not None:
            yield edges(held)

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, ids, n = (pdf[c].to_numpy(np.int64) for c in ("node", "rep", "n"))
        bits = pdf[SKETCH].to_numpy(np.int64).view(np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
        sizes = np.diff(cuts)
        first = cuts[:-1][sizes == 2]  # most nodes are pairs
        agree = BITS - np.bitwise_count(bits[first] ^ bits[first + 1]).sum(axis=1, dtype=np.int64)
        fits = (agree >= LEAST_BITS) & (100 * np.minimum(n[first], n[first + 1]) >= SIMILAR * np.maximum(n[first], n[first + 1]))
        found = list(zip(ids[first][fits].tolist(), ids[first + 1][fits].tolist(), strict=True))
        for at, size in zip(cuts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            s = slice(at, at + size)
            found += forest(ids[s], may_link(n[s], bits[s]))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    seen = F.count(F.lit(1)).over(Window.partitionBy("node"))
    dealt = rows.select("node", "rep", "n", *SKETCH, seen.alias("_seen")).filter("_seen > 1").drop("_seen")
    return dealt.mapInPandas(run, "u long, v long")


def pivot_edges(members: DataFrame, pivots: DataFrame, n: int) -> DataFrame:
    differ = reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"p{c}"))) for c in SKETCH])
    fits = (BITS - differ >= LEAST_BITS) & (100 * F.least("n", "pn") >= SIMILAR * F.greatest("n", "pn"))
    return keyed(members, pivots, n, "node").filter(fits & (F.col("rep") != F.col("p"))).select(F.col("rep").alias("u"), F.col("p").alias("v"))


def outsider_edges(members: DataFrame) -> DataFrame:
    """Candidate forests of (node, rep, n, sketch, root, outside, size): outsiders against all, in blocks of a node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in groups(batches, "cell"):
            pdf = pdf.sort_values("outside", ascending=False, kind="stable")
            ids, n, root = (pdf[c].to_numpy(np.int64) for c in ("rep", "n", "root"))
            bits = pdf[SKETCH].to_numpy(np.int64).view(np.uint64)
            label = np.unique(root, return_inverse=True)[1]
            found = []
            for at in range(int(pdf["outside"].sum())):
                other = np.flatnonzero((label != label[at]) & (100 * np.minimum(n, n[at]) >= SIMILAR * np.maximum(n, n[at])))
                agree = BITS - np.bitwise_count(bits[other] ^ bits[at]).sum(axis=1, dtype=np.int64)
                near = other[agree >= LEAST_BITS]
                if not len(near):
                    continue
                for new in np.unique(label[near]):
                    found.append((ids[at], ids[near[label[near] == new][0]]))
                label[np.isin(label, label[near])] = label[at]
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    to = F.when(F.col("outside"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(spread("rep", 5, blocks)))
    dealt = members.withColumn("block", F.explode(to)).select(F.xxhash64("node", "block").alias("cell"), "rep", "n", *SKETCH, "root", "outside")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "u long, v long")


def candidates(reps: DataFrame) -> list[DataFrame]:
    """Stored edges of candidate forests, from all levels of all trees."""
    edges: list[DataFrame] = []
    frontier = first_paths(reps)
    for depth in range(DEPTH):
        is_pivot = F.xxhash64("node", "rep")
        sizes = frontier.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min(is_pivot).alias("pivot"))
        large = stored(sizes.filter(F.col("size") > LEAF), "nodes")
        n = large.count()
        if not n:
            edges.append(stored(small_nodes(frontier), "candidates"))
            break
        members = stored(keyed(frontier, large, n, "node"), "members")
        firsts = members.filter(is_pivot == F.col("pivot"))
        pivots = firsts.select("node", F.col("rep").alias("p"), F.col("n").alias("pn"), *[F.col(c).alias(f"p{c}") for c in SKETCH])
        edges.append(stored(small_nodes(keyed(frontier, large, n, "node", "left_anti")).union(pivot_edges(members, pivots, n)), "candidates"))

        roots = components(edges).withColumnRenamed("id", "rep")
        labelled = stored(members.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "members")
        mains = labelled.filter(is_pivot == F.col("pivot")).select("node", F.col("rep").alias("p"), F.col("root").alias("main"))
        marked = keyed(labelled, mains, n, "node").withColumn("outside", F.col("root") != F.col("main")).drop("main", "pivot")
        outside = marked.filter("outside").groupBy("node").agg(F.count(F.lit(1)).alias("outsiders"))
        mixed = stored(outside, "mixed")
        counts = mixed.agg(F.count_if(F.col("outsiders") <= OUTSIDERS).alias("few"), F.count_if(F.col("outsiders") > OUTSIDERS).alias("many")).first()
        if counts["few"]:
            edges.append(stored(outsider_edges(keyed(marked, mixed.filter(F.col("outsiders") <= OUTSIDERS), counts["few"], "node")), "candidates"))
        if not counts["many"]:
            break
        rest = keyed(marked, mixed.filter(F.col("outsiders") > OUTSIDERS), counts["many"], "node")
        if depth == DEPTH - 1:
            edges.append(stored(rest.select(F.col("rep").alias("u"), F.col("p").alias("v")), "candidates"))
            break
        frontier = next_paths(stored(rest.select("node", "rep").join(reps.select("rep", "n", *SKETCH, "sig"), "rep"), "frontier"))
    return edges


# Components


def components(edges: list[DataFrame]) -> DataFrame:
    """(id, root), stored: the smallest id of each edge's component, for all ids of the stored ``edges``.

    At most ``LOCAL_EDGES`` edges are joined in one task. More alternate large and small stars: each
    vertex passes its least neighbour to its larger neighbours, then to its smaller ones, until
    nothing changes.
    """

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    every = union(edges)
    if every.count() <= LOCAL_EDGES:
        return stored(every.coalesce(1).mapInPandas(joined, "id long, root long"), "components")
    now = stored(every.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    seen = mark(now)
    while True:
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(now)
        then, seen = seen, mark(after)
        now = after
        if then == seen:
            break
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return stored(stars.union(stars.select("root", "root").distinct()), "components")


def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of all edges of a task."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                above[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in above.keys() | set(above.values())]
    yield pd.DataFrame(found, columns=["id", "root"], dtype="int64")


# Exact comparison in cells


def links(sets: list[np.ndarray], asked: np.ndarray | None = None) -> np.ndarray:
    """Which of some sets are linked, by full sets. ``asked``: only pairs with one of these."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    may = 100 * np.minimum.outer(n, n) >= SIMILAR * np.maximum.outer(n, n)
    may &= (n > 0)[:, None] & ~np.eye(m, dtype=bool)
    if asked is not None:
        may &= asked[:, None] | asked[None, :]
    common = np.zeros((m, m))
    if m <= 4:
        for i in range(m):
            for j in range(i):
                if may[i, j]:
                    common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    elif may.any():
        values, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        column = np.concatenate([[0], np.cumsum(values[1:] != values[:-1])])
        shared = np.bincount(column)[column] > 1
        owner, column = owner[shared], column[shared]
        if len(column):
            column = np.concatenate([[0], np.cumsum(column[1:] != column[:-1])])
            for a in range(0, int(column[-1]) + 1, 4096):
                lo, hi = np.searchsorted(column, [a, a + 4096])
                dense = np.zeros((m, min(4096, int(column[-1]) + 1 - a)), np.float32)
                dense[owner[lo:hi], column[lo:hi] - a] = 1
                common += dense @ dense.T
    union = n[:, None] + n[None, :] - common
    return may & (100 * common >= SIMILAR * union)


def compared(cells: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (u, v) of the links in ``cells`` (cell, rep, asked), where whole texts of ``docs`` meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in groups(batches, "cell"):
            if len(pdf) > 1:
                asked = pdf["asked"].to_numpy(bool)
                linked = links([shingles(t) for t in pdf["text"]], None if asked.all() else asked)
                yield pd.DataFrame(forest(pdf["rep"].to_numpy(np.int64), linked), columns=["u", "v"], dtype="int64")

    texts = sieved(docs.select(F.col("doc_id").alias("rep"), "text"), cells)
    met = cells.join(texts, "rep").select("cell", "rep", "asked", "text")
    return met.repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "u long, v long")


def sieved(rows: DataFrame, wanted: DataFrame, hit: bool = True) -> DataFrame:
    """``rows`` whose ``rep`` may be in the stored ``wanted`` (or, if not ``hit``, surely is not there).

    By a broadcast filter with 16 slots a wanted row, ``FILTER_SLOTS`` at most; more wanted rows let more through.
    """
    slots = min(FILTER_SLOTS, 1 << (16 * wanted.count() + 1024).bit_length())
    slot = F.pmod(F.xxhash64(F.lit(17), "rep"), F.lit(slots))
    word, bit = F.shiftright(slot, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    masks = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_mask"))
    met = rows.withColumn("_word", word).join(F.broadcast(masks), "_word", "left")
    found = F.coalesce(F.col("_mask"), F.lit(0).cast("long")).bitwiseAND(bit) != 0
    return met.filter(found if hit else ~found).select(*rows.columns)


def spread(key: str, seed: int, over):
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), over)


def long_sketches(rows: DataFrame) -> DataFrame:
    """``rows`` (cluster, rep, root, asked, rows, columns, text) with n and bits instead of text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t) for t in null_to_empty(pdf["text"])]
            yield pdf.drop(columns="text").assign(n=[len(s) for s in sets], bits=[top_bits(minhashes(s, LONG_HASHES)).tobytes() for s in sets])

    return rows.mapInPandas(run, "cluster long, rep long, root long, asked boolean, rows long, columns long, n long, bits binary")


def allowed(blocks: DataFrame) -> DataFrame:
    """Cells (cell, rep, asked) of texts: what long sketches allow in (block, rep, root, asked, n, bits)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in groups(batches, "block"):
            key = np.uint64(np.int64(pdf["block"].iloc[0]).view(np.uint64))
            sides = []
            for asked in (True, False):
                side = pdf[pdf["asked"] == asked]
                bits = np.frombuffer(b"".join(side["bits"]), np.uint64).reshape(len(side), LONG_BITS // 64)
                sides.append((*(side[c].to_numpy(np.int64) for c in ("rep", "root", "n")), bits))
            (ids, root, n, bits), (ids2, root2, n2, bits2) = sides
            for i in range(0, len(ids), SUBBLOCK):
                a = slice(i, i + SUBBLOCK)
                for j in range(0, len(ids2), SUBBLOCK):
                    b = slice(j, j + SUBBLOCK)
                    agree = LONG_BITS - np.bitwise_count(bits[a, None, :] ^ bits2[None, b, :]).sum(axis=2, dtype=np.int64)
                    may = (agree >= LEAST_LONG) & (root[a, None] != root2[None, b]) & (100 * np.minimum.outer(n[a], n2[b]) >= SIMILAR * np.maximum.outer(n[a], n2[b]))
                    if may.any():
                        cell = mix64(np.array([key + np.uint64(i // SUBBLOCK * 65536 + j // SUBBLOCK + 1)])).view(np.int64)[0]
                        one, two = ids[a][may.any(axis=1)], ids2[b][may.any(axis=0)]
                        yield pd.DataFrame({"cell": cell, "rep": np.concatenate([one, two]), "asked": np.arange(len(one) + len(two)) < len(one)})

    return blocks.repartition("block").sortWithinPartitions("block").mapInPandas(run, "cell long, rep long, asked boolean")


def exact_links(clusters: DataFrame, docs: DataFrame) -> list[DataFrame]:
    """Stored edges of all links inside the stored ``clusters`` (rep, cluster)."""
    big = stored(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > CELL), "clusters")
    n = big.count()
    small = keyed(clusters, big, n, "cluster", "left_anti").select(F.xxhash64("cluster").alias("cell"), "rep", F.lit(True).alias("asked"))
    if not n:
        return [stored(compared(stored(small, "cells"), docs), "links")]
    large = keyed(clusters, big, n, "cluster")
    blocks = F.ceil(F.col("size") / (CELL - 2 * PIVOTS)).cast("long")
    own = spread("rep", 1, blocks)
    to = F.when(spread("rep", 2, F.col("size")) < PIVOTS, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(own))
    dealt = large.select("cluster", "rep", F.explode(to).alias("block"))
    dealt = dealt.select(F.xxhash64("cluster", "block").alias("cell"), "rep", F.lit(True).alias("asked"))
    found = [stored(compared(stored(small.union(dealt), "cells"), docs), "links")]

    roots = components(found).withColumnRenamed("id", "rep")
    labelled = stored(large.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "labelled")
    counts = labelled.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("k"))
    mains = stored(counts.groupBy("cluster").agg(F.max(F.struct("k", "root")).alias("top")).select("cluster", F.col("top.root").alias("main"), F.col("top.k").alias("k")), "mains")
    rest = keyed(labelled, mains, n, "cluster").filter("k < size").withColumn("asked", F.col("root") != F.col("main"))
    rest = stored(rest.select("cluster", "rep", "root", "asked", F.ceil((F.col("size") - F.col("k")) / BLOCK).cast("long").alias("rows"), F.ceil(F.col("size") / BLOCK).cast("long").alias("columns")), "rest")
    if rest.isEmpty():
        return found
    texts = sieved(docs.select(F.col("doc_id").alias("rep"), "text"), rest)
    sketched = stored(long_sketches(rest.join(texts, "rep").select("cluster", "rep", "root", "asked", "rows", "columns", "text")), "sketches")

    def to_all(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    keep = ("cluster", "rep", "root", "n", "bits")
    asking = sketched.filter("asked").select(*keep, F.lit(True).alias("asked"), spread("rep", 3, F.col("rows")).alias("i"), to_all(F.col("columns")).alias("j"))
    others = sketched.select(*keep, F.lit(False).alias("asked"), to_all(F.col("rows")).alias("i"), spread("rep", 4, F.col("columns")).alias("j"))
    dealt = asking.union(others).select(F.xxhash64("cluster", "i", "j").alias("block"), "rep", "root", "asked", "n", "bits")
    found.append(stored(compared(stored(allowed(dealt), "cells"), docs), "links"))
    return found


def assign(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; others ignored).

    Null and empty texts have no shingles and are linked with nothing. Rows of one doc_id are one document
    whose links are those of any of its texts. Rows with a null doc_id are not compared: their
    component is null and they are kept. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = stored(signed(docs), "signatures")
    known = every.filter("doc_id IS NOT NULL AND n > 0")
    firsts = ("n", *SKETCH, "sig")
    reps = stored(known.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), *[F.first(c).alias(c) for c in firsts]), "reps")
    clusters = components(candidates(reps)).select(F.col("id").alias("rep"), F.col("root").alias("cluster"))

    # rows of one doc_id are one vertex: its sets are tied by their ids
    owners = known.join(reps.filter("last != rep").select("a", "b", "rep"), ["a", "b"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    low = owners.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).filter("u != v")
    tied = stored(owners.join(low.select("doc_id", F.col("u").alias("low")), "doc_id").select(F.col("rep").alias("u"), F.col("low").alias("v")), "tied")
    roots = components([*exact_links(clusters, docs.filter("doc_id IS NOT NULL")), tied]).withColumnRenamed("id", "rep")
    named = reps.select("a", "b", "rep").join(roots, "rep", "left").select("a", "b", F.coalesce("root", "rep").alias("root"))
    out = every.select("doc_id", "n", "a", "b").join(named, ["a", "b"], "left")
    root = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("root")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0].select("u", "v")
    for f in frames[1:]:
        out = out.union(f.select("u", "v"))
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.

    All columns stay. Rows of one doc_id are one document: of a kept one all rows stay but repeated texts, of
    which the first by the hash of its other columns stays. Rows with a null doc_id all stay. Null and empty texts
    are nobody's copies; an empty table stays empty.
    """
    assigned = stored(assign(docs).filter("doc_id IS NOT NULL"), "assigned")
    some = assigned.groupBy("doc_id").agg(F.min("kept").alias("stays"), F.count(F.lit(1)).alias("n")).filter("NOT stays OR n > 1")
    some = stored(some.select(F.col("doc_id").alias("rep"), "stays"), "copies")
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    known = rows.filter("rep IS NOT NULL")
    met = sieved(known, some).join(some, "rep", "left").filter("coalesce(stays, true)")
    first = Window.partitionBy("copy").orderBy(F.xxhash64("row"))  # a key of its own: copies are thinned before they are dealt
    met = met.withColumn("copy", F.struct("rep", F.sha2(F.col("row.text").cast("string"), 256))).withColumn("at", F.row_number().over(first)).filter("at = 1")
    whole = sieved(known, some, hit=False).union(met.select("rep", "row")).union(rows.filter("rep IS NULL"))
    return whole.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
