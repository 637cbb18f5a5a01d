"""Repair of the structure of conversations: the cheapest edits that make roles follow ``(s?(ua)+)?``.

A forward Viterbi search for each conversation, over four states: nothing yet, after a system turn, after
a user turn, after an assistant turn. Each state carries its least (cost, audit), the audit being the initials
of the edits, of which the ASCII-least counts among equally dear ones; after each turn the layer is closed
by insertions, of which two at most help. A turn is kept, gets another role, or is deleted; where a
role is given or a turn inserted, the state says which one it is.

Audits are not carried as strings, which would take time with the square of a conversation's length: of two
equally dear audits of the same turns neither begins with the other, so their order is a rank, which the
last edits carry on. What a layer does to the next depends on differences of costs and on ranks alone, of
which there are few, so each such transition is found once. A task holds four bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallax.llm.common import ArrowBatches, arrow_batch, ready, stored

# What edits cost, by their initials; an undeleted truncated turn adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
PRICE = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
WHITE = " \t\n\x0b\x0c\r"

#: States, and where a kept initial leads; a rerolled or inserted turn is the one the grammar wants next.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
#: A turn's code is its initial's place here, times 4, plus bits: must go, is truncated.
INITIALS = ("s", "u", "a", "")
MUST_GO, CUT_OFF = 1, 2

Layer = tuple  # by state None or (cost over the least, rank, base state before insertions, insertions)


def choices(state: int, code: int) -> Iterator[tuple[str, int, int]]:
    """(edit, price, next state) of a turn."""
    yield DELETE, PRICE[DELETE], state
    if not code & MUST_GO:
        more = TRUNCATED if code & CUT_OFF else 0
        yield REROLE, PRICE[REROLE] + more, WANTED[state]
        kept = KEPT.get((state, INITIALS[code >> 2]))
        if kept is not None:
            yield KEEP, PRICE[KEEP] + more, kept


def closed(bases: list[tuple[int, int] | None]) -> tuple[Layer, int]:
    """The layer of (cost, rank) by state after insertions, and the least cost, by which costs are less."""
    layer: list = [None if b is None else (*b, s, 0) for s, b in enumerate(bases)]
    for _ in range(2):
        for s, found in enumerate(list(layer)):
            if found:
                cost, rank, base, k = found
                more, to = (cost + PRICE[INSERT], rank, base, k + 1), WANTED[s]
                if layer[to] is None or more < layer[to]:
                    layer[to] = more
    done = layer[ASSISTANT][0]
    if layer[EMPTY] and layer[EMPTY][0] > done + PRICE[DELETE]:  # dearer than to go on from ASSISTANT, and without the system turn
        layer[EMPTY] = None
    if layer[SYSTEM] and layer[SYSTEM][0] > done:  # whatever follows may follow ASSISTANT
        layer[SYSTEM] = None
    least = min(found[0] for found in layer if found)
    return tuple(found and (found[0] - least, *found[1:]) for found in layer), least


class Transitions:
    """Layers and what a turn does to them, found when first met."""

    def __init__(self):
        self.start = closed([(0, 0), None, None, None])
        self.known: dict[tuple[Layer, int], tuple[Layer, int, bytes]] = {}

    def __call__(self, layer: Layer, code: int) -> tuple[Layer, int, bytes]:
        """The next layer, what it adds to the cost, and by state the byte (base before, insertions, edit)."""
        if (layer, code) not in self.known:
            best: list = [None] * 4
            for state, found in enumerate(layer):
                if found:
                    cost, rank, base, k = found
                    for edit, price, to in choices(state, code):
                        way = (cost + price, rank, INSERT * k + edit, base, k)
                        if best[to] is None or way < best[to]:
                            best[to] = way
            order = {audit: i for i, audit in enumerate(sorted(way[1:3] for way in best if way))}
            after, more = closed([way and (way[0], order[way[1:3]]) for way in best])
            self.known[layer, code] = after, more, bytes([(way[3] << 4 | way[4] << 2 | "DKR".index(way[2][-1])) if way else 0 for way in best])
        return self.known[layer, code]


class Search:
    """One conversation: turns by code, then (cost, audit)."""

    def __init__(self, transitions: Transitions):
        self.transitions = transitions
        self.layer, self.cost = transitions.start
        self.trail = bytearray()

    def add(self, code: int) -> None:
        self.layer, more, back = self.transitions(self.layer, code)
        self.cost += more
        self.trail += back

    def finish(self) -> tuple[int, str]:
        cost, _, base, k = min(found for found in (self.layer[EMPTY], self.layer[ASSISTANT]) if found)
        audit = [INSERT * k]
        for at in range(len(self.trail) - 4, -1, -4):
            step = self.trail[at + base]
            audit.append("DKR"[step & 3])
            base, k = step >> 4, step >> 2 & 3
            audit.append(INSERT * k)
        return self.cost + cost, "".join(reversed(audit))


def order() -> list[str]:
    return ["turn", "role", "text"]


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, text, code, fault) of turns (conv_id, turn, role, text).

    Turns go by turn, nulls first, then role and text; null roles and texts are a space. ``fault`` is the first of blank,
    duplicate (role and text seen earlier in the conversation), truncated (last character that is no white space not one
    of ``.!?``), or null. Rows with a null conv_id are one conversation. One exchange, by conversation.
    """
    said = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    stripped = F.rtrim(F.col("text"), F.lit(WHITE))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")) > 1
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order())) - 1
    found = said.repartition("conv_id").withColumn("_seen", seen).withColumn("position", place.cast("long"))
    fault = F.when(stripped == "", "blank").when(F.col("_seen"), "duplicate").when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), "truncated")
    found = found.withColumn("fault", fault)
    initial = F.substring("role", 1, 1)
    kind = F.lit(len(INITIALS) - 1)
    for i, c in enumerate(INITIALS[:-1]):
        kind = F.when(initial == c, i).otherwise(kind)
    bits = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", CUT_OFF).otherwise(0)
    return found.select("conv_id", "position", "turn", "role", "text", (kind * 4 + bits).cast("int").alias("code"), "fault")


COUNTS = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
#: The largest long: gaps between turns further apart count as so many.
MOST = (1 << 63) - 1


def audits(found: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of ``faults``, a row for each conversation.

    gaps: turns between the first and last one that are not there, without nulls. illegal: neighbours whose initials are none
    of su, ua, au. Conversations are streamed in order, without their texts.
    """

    def run(batches: ArrowBatches) -> ArrowBatches:
        transitions, done, key = Transitions(), [], None
        now = None

        def finish():
            first, last, distinct = span
            gaps = 0 if first is None else min(MOST, last - first + 1 - distinct)
            done.append((now[0], gaps, *(n[f] for f in ("blank", "duplicate", "truncated", "illegal")), *search.finish()))

        for batch in batches:
            key = batch.schema.field("conv_id")
            for conv_id, turn, initial, code, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "code", "fault")), strict=True):
                if now != (conv_id,):
                    if now:
                        finish()
                    now, search, before, span, n = (conv_id,), Search(transitions), None, [None, None, 0], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                search.add(code)
                if fault:
                    n[fault] += 1
                n["illegal"] += before is not None and before + initial not in LEGAL
                before = initial
                if turn is not None and turn != span[1]:
                    span = [turn if span[0] is None else span[0], turn, span[2] + 1]
            yield arrow_batch(done, pa.schema([key, *COUNTS]))
            done = []
        if now:
            finish()
            yield arrow_batch(done, pa.schema([key, *COUNTS]))

    dealt = found.select("conv_id", "position", "turn", F.substring("role", 1, 1).alias("initial"), "code", "fault").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return dealt.mapInArrow(run, T.StructType([found.schema["conv_id"], *[T.StructField(c, T.StringType() if c == "audit" else T.LongType()) for c, _ in COUNTS]]))


def repaired(found: DataFrame, audit: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the turns of ``faults`` after the edits of ``audits``, numbered from 0 by conversation.

    Inserted turns have an empty text. A conversation's audit is streamed before its turns; conversations are whole in a partition
    and in order.
    """

    def run(batches: ArrowBatches) -> ArrowBatches:
        now, done = None, []

        def insertions() -> None:
            nonlocal at
            while at < len(letters) and letters[at] == INSERT:
                give(ROLE[WANTED[state]], "", WANTED[state])
                at += 1

        def give(role: str, text: str, to: int) -> None:
            nonlocal position, state
            done.append((now, position, role, text))
            position, state = position + 1, to

        for batch in batches:
            key = batch.schema.field("conv_id")
            schema = pa.schema([key, ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
            for conv_id, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
                if place < 0:
                    now, letters, at, position, state = conv_id, text, 0, 0, EMPTY
                else:
                    if letters[at] == REROLE:
                        give(ROLE[WANTED[state]], text, WANTED[state])
                    elif letters[at] == KEEP:
                        give(role, text, KEPT[state, role[:1]])
                    at += 1
                insertions()
            yield arrow_batch(done, schema)
            done.clear()

    turns = found.select("conv_id", "position", "role", "text").unionByName(audit.select("conv_id", F.lit(-1).cast("long").alias("position"), F.lit("").alias("role"), F.col("audit").alias("text")))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return dealt.mapInArrow(run, T.StructType([found.schema["conv_id"], *[T.StructField(c, T.LongType() if c == "position" else T.StringType()) for c in ("position", "role", "text")]]))


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations as ``repaired`` gives them: ``role:text`` by newline. Conversations that are not whole
    and in order raise an error."""

    def run(batches: ArrowBatches) -> ArrowBatches:
        now, done, key = None, [], None
        for batch in batches:
            key = batch.schema.field("conv_id")
            for conv_id, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
                if now != (conv_id,):
                    if now:
                        done.append((now[0], whole.hexdigest()))
                    now, whole, due = (conv_id,), hashlib.sha256(), 0
                if position != due:
                    raise ValueError(f"conversation {conv_id} has position {position} in place of {due}: sort conversations, whole, by position")
                whole.update(f"{chr(10) if position else ''}{role}:{text}".encode())
                due += 1
            yield arrow_batch(done, pa.schema([key, ("repaired_sha256", pa.string())]))
            done = []
        if now:
            yield arrow_batch([(now[0], whole.hexdigest())], pa.schema([key, ("repaired_sha256", pa.string())]))

    return rows.select("conv_id", "position", "role", "text").mapInArrow(run, T.StructType([rows.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())]))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired turns) of turns (conv_id, turn, role, text); other columns are left out, an empty table gives empty ones.

    Faults are found once and stored, as the search must end before a conversation's first edit is known.
    """
    ready(turns.sparkSession)
    found = stored(faults(turns), "faults")
    audit = stored(audits(found), "audits")
    return audit, repaired(found, audit)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space): 0 drops a row, 1 empties its text, 2 removes
    its ``.!?``, 3 repeats it, 4 makes it the user's."""
    name = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:3])
    rows = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(name) % 20).alias("_k")).filter("_k <> 0")

    def when(k: int, value: Column, other: str) -> Column:
        return F.when(F.col("_k") == k, value).otherwise(F.col(other))

    text = F.when(F.col("_k") == 1, "").otherwise(when(2, F.translate("text", ".!?", ""), "text"))
    copies = F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", when(4, F.lit("user"), "role").alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")
