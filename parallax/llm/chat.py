"""Chat formatting by schema fingerprints.

Records come as JSON in whatever layout: rows, prompts with completions, instructions with inputs
and outputs, lists of messages. The sorted paths of a record's fields (``messages[].role``), hashed, are its
schema fingerprint, which selects a declarative mapping to turns (role, text). Turns are then
written by one template, whose marks cannot occur in a text: control strings there, of this and of
other common templates, get a backslash after their first character, and backslashes are doubled.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import ArrowBatches, arrow_batch, ready

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: What starts or ends turns in this and other templates.
CONTROL = re.compile(r"(?=<\||\|>|</?s>|\[/?INST\]|<</?SYS>>|<(?:start|end)_of_turn>)(.)", re.S)
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
UNESCAPE = re.compile(r"\\(\\?)")
FORMATTED = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


@dataclass(frozen=True)
class Layout:
    """``turns``: path of a list of turns, or "" for a record that is one turn; or else ``fields``: (role, field names
    joined by blank lines) in order. ``extra``: fields that may stand beside them."""

    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    turns: str | None = None
    role: str = "role"
    text: str = "text"
    extra: frozenset[str] = field(default_factory=frozenset)

    def paths(self) -> list[str]:
        if self.turns is None:
            return sorted(f for _, names in self.fields for f in names)
        at = f"{self.turns}[]." if self.turns else ""
        return sorted([at + self.role, at + self.text])

    def read(self, record: dict) -> list[tuple[str, str]]:
        if self.turns is None:
            return [(role, "\n\n".join(x for x in (as_text(record.get(f)) for f in names) if x)) for role, names in self.fields if role != "system" or any(record.get(f) for f in names)]
        found = record[self.turns] if self.turns else [record]
        return [(ROLES.get(r := as_text(t.get(self.role)), r), as_text(t.get(self.text))) for t in found or []]


def as_text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def two(user: tuple[str, ...], assistant: str, system: str | None = None) -> tuple:
    return (*((("system", (system,)),) if system else ()), ("user", user), ("assistant", (assistant,)))


ROW_KEYS = frozenset({"conv_id", "turn"})
LAYOUTS = (
    Layout("row", turns="", extra=ROW_KEYS),
    Layout("message_row", turns="", text="content", extra=ROW_KEYS),
    Layout("turns", turns="turns"),
    Layout("messages", turns="messages", text="content"),
    Layout("conversations", turns="conversations", role="from", text="value"),
    Layout("prompt_completion", two(("prompt",), "completion")),
    Layout("prompt_response", two(("prompt",), "response")),
    Layout("system_prompt_response", two(("prompt",), "response", "system")),
    Layout("instruction_output", two(("instruction",), "output")),
    Layout("instruction_input_output", two(("instruction", "input"), "output")),
    Layout("question_answer", two(("question",), "answer")),
)


def field_paths(record, at: str = "") -> set[str]:
    if isinstance(record, dict) and record:
        return {p for k, v in record.items() for p in field_paths(v, f"{at}.{k}" if at else str(k))}
    if isinstance(record, list):
        return {p for v in record for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def schema_fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


MAPPINGS = {schema_fingerprint(layout.paths()): layout for layout in LAYOUTS} | {
    schema_fingerprint([*layout.paths(), *layout.extra]): layout for layout in LAYOUTS
}


TURNS = pa.schema([("record_id", pa.int64()), ("own", pa.int64()), ("at", pa.int64()), ("position", pa.int32()), ("layout", pa.string()), ("role", pa.string()), ("text", pa.string())])


def canonical(records: DataFrame, mappings: dict[str, Layout] | None = None) -> DataFrame:
    """Turns (record_id long, own, at, position, layout, role, text) of ``records`` (record_id, at, body: JSON).

    A record without a mapping, null or malformed, gives one row with null layout, role and text, so
    that nothing is lost unseen; the caller sets them apart. Null values count as absent texts ("").
    ``own`` numbers the records without an id, null for others: each is a conversation of its own.
    """
    known = MAPPINGS if mappings is None else mappings
    ready(records.sparkSession)

    def run(batches: ArrowBatches) -> ArrowBatches:
        seen: dict[tuple, Layout | None] = {}
        unnamed = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for record_id, at, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    record = json.loads(body)
                except (TypeError, ValueError):
                    record = None
                layout = None
                if isinstance(record, dict):
                    paths = tuple(sorted(field_paths(record)))
                    if paths not in seen and len(seen) < 10_000:
                        seen[paths] = known.get(schema_fingerprint(paths))
                    layout = seen[paths] if paths in seen else known.get(schema_fingerprint(paths))
                turns = layout.read(record) if layout else [(None, None)]
                unnamed += 1
                own = unnamed if record_id is None else None
                rows += [(record_id, own, at, i, layout.name if layout else None, role, text) for i, (role, text) in enumerate(turns)]
            yield arrow_batch(rows, TURNS)

    return records.select(F.col("record_id").cast("long"), F.col("at").cast("long"), F.col("body").cast("string")).mapInArrow(
        run, "record_id long, own long, at long, position int, layout string, role string, text string"
    )


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def formatted(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}" for role, text in turns)


def read_back(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end of the escaped text in the formatted one."""
    at = 0
    for m in FORMATTED.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        yield unescape(m[1]), unescape(m[2]), *m.span(2)
    if at != len(text):
        raise ValueError(f"not a formatted conversation at {at}")


#: A formatted conversation is cut, between turns, to parts of about so many characters.
PART_CHARS = 1 << 20
PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.list_(pa.int32())))])


def format_chats(turns: DataFrame) -> DataFrame:
    """Parts (conv_id, part, formatted, loss_spans) of the conversations of ``turns`` (record_id, at, position, role, text).

    Turns go by ``at``, position, role and text, nulls first; null roles and texts are empty. Repeated rows are turns of
    their own. A conversation is one part, 0, unless it is longer than ``PART_CHARS``; parts of a conversation follow
    each other. Rows are streamed in order, so a task holds one part at a time, however long conversations are.
    Rows with a null record_id are conversations by their ``own`` number, or all one without such a column.
    loss_spans: [start, end) of assistant texts in the part.
    """

    def run(batches: ArrowBatches) -> ArrowBatches:
        now, part, said, held, done = None, 0, [], 0, []

        def cut():
            nonlocal part, said, held
            text = "".join(said)
            done.append((now[0], part, text, [[a, b] for role, _, a, b in read_back(text) if role == "assistant"]))
            part, said, held = part + 1, [], 0

        for batch in batches:
            for conv_id, own, role, text in zip(*(batch.column(c).to_pylist() for c in ("record_id", "own", "role", "text")), strict=True):
                if now != (conv_id, own):
                    if said:
                        cut()
                    now, part = (conv_id, own), 0
                elif held >= PART_CHARS:
                    cut()
                said.append(formatted([(role or "", text or "")]))
                held += len(said[-1])
            yield arrow_batch(done, PARTS)
            done = []
        if said:
            cut()
        yield arrow_batch(done, PARTS)

    order = ["record_id", "own", "at", "position", "role", "text"]
    if "own" not in turns.columns:
        turns = turns.withColumn("own", F.lit(None).cast("long"))
    dealt = turns.select(*order).repartition("record_id", "own").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "conv_id long, part int, formatted string, loss_spans array<array<int>>")


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from their parts, which come as ``format_chats`` gives them: whole
    conversations in a partition, their parts in order. Others raise an error."""

    def run(batches: ArrowBatches) -> ArrowBatches:
        state: list | None = None
        done: list[tuple] = []

        def finish():
            if state:
                conv_id, n_turns, whole, n_loss, loss, chars = state
                done.append((conv_id, n_turns, whole.hexdigest(), n_loss, loss.hexdigest(), chars))

        for batch in batches:
            for conv_id, part, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 0:
                    finish()
                    state, due = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], 0
                if state is None or state[0] != conv_id or part != due:
                    raise ValueError(f"conversation {conv_id} has part {part} out of order: sort the parts of whole conversations")
                due += 1
                for role, said, _, _ in read_back(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for a, b in spans:
                    said = unescape(text[a:b])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            yield arrow_batch(done, DIGESTS)
            done = []
        finish()
        yield arrow_batch(done, DIGESTS)

    parts = chats.select("conv_id", "part", "formatted", "loss_spans")
    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
