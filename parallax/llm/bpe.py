"""Byte-level BPE by a transducer: text -> ids -> text.

The ranks of a vocabulary say which tokens may stand beside each other: u, v may where merging the bytes
of both gives u, v again. The ids of a text are the one sequence of tokens that is allowed throughout, and
so are those of each prefix: a prefix ends with the one token that may follow the last token of what is
before it. The merges are compiled to a finite-state transducer of this rule. Its nondeterministic form
starts to read a token at every byte, along a trie; it is made deterministic as texts are read: a state is
the set of nodes that are being read, and knows the tokens that end there. A window has the last token of
each recent prefix. As no token is longer than the vocabulary's longest, what lies before the start of all
tokens that are being read is certain as soon as their histories meet, and is emitted: the lookahead is
bounded, and long pieces are streamed.

Decoding streams ids by chunks; a state machine holds back the bytes of a character that is not complete.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parallax.llm.common import ArrowBatches, arrow_batch, fresh, ready

#: Steps, pairs of tokens and pieces that a worker remembers before it starts anew; pieces up to so many characters.
STEPS, PAIRS, PIECES, PIECE_CHARS = 500_000, 500_000, 500_000, 32
#: Characters up to which a text's pieces are found at once.
LONG_TEXT = 1 << 20
#: Bytes after which a long piece is searched for what is certain.
WINDOW = 4096
#: Ids that a stream hands on at a time.
CHUNK = 1 << 16
#: Before the first token of a piece; the root of the trie.
START, ROOT = -1, 0


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: a line for each, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(data: bytes, ranks: dict[bytes, int], below: int = 1 << 62) -> list[bytes]:
    """The merges of a few bytes with ranks under ``below``, one by one: always the pair of least rank, the first of equal ones."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Ids of pieces, by ranks that have all 256 bytes; its states are made when a piece first reaches them."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks lack single bytes")
        self.ranks = ranks
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.edges: dict[int, int] = {}  # node * 256 + byte -> node
        self.token_at: list[int] = [START]
        self.depth = [0]
        for token, i in ranks.items():
            node = ROOT
            for b in token:
                found = self.edges.get(node << 8 | b)
                if found is None:
                    found = self.edges[node << 8 | b] = len(self.token_at)
                    self.token_at.append(START)
                    self.depth.append(self.depth[node] + 1)
                node = found
            self.token_at[node] = i
        self.states: list[tuple[int, ...]] = [()]  # nodes, the deepest first
        self.state_at: dict[tuple[int, ...], int] = {(): 0}
        self.ending: list[list[tuple[int, int]]] = [[]]  # (token, length) by state, the longest first
        self.steps: dict[int, int] = {}  # state * 256 + byte -> state
        self.edge_parts: dict[tuple[int, bool], list[tuple[bytes, int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def parts_at_edge(self, token: int, right: bool) -> list[tuple[bytes, int, int]]:
        """What stands at one edge of a token while its merges go on: (bytes, rank that makes it, rank that ends it)."""
        if (token, right) not in self.edge_parts:
            part, ends, out = self.bytes_of[token], 1 << 62, []
            while True:
                born = self.ranks[part] if len(part) > 1 else -1
                out.append((part, born, ends))
                if len(part) == 1:
                    break
                part, ends = merged(part, self.ranks, born)[-1 if right else 0], born
            self.edge_parts[token, right] = out
        return self.edge_parts[token, right]

    def may_meet(self, u: int, v: int) -> bool:
        """Whether the merges of the bytes of u and v give u, v: no merge across their border comes first while both its sides stand."""
        known = self.pairs.get(u << 32 | v)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[u << 32 | v] = len(merged(self.bytes_of[v], self.ranks)) == 1 if u == START else not self.border_merges(u, v)
        return known

    def border_merges(self, u: int, v: int) -> bool:
        for left, left_born, left_ends in self.parts_at_edge(u, True):
            for right, right_born, right_ends in self.parts_at_edge(v, False):
                if left_born < right_ends and right_born < left_ends:
                    rank = self.ranks.get(left + right)
                    if rank is not None and rank < left_ends and rank <= right_ends:
                        return True
        return False

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte; a token may start at each."""
        if len(self.steps) >= STEPS:
            self.steps.clear()
        nodes = tuple([n for node in (*self.states[state], ROOT) if (n := self.edges.get(node << 8 | byte))])
        found = self.state_at.get(nodes)
        if found is None:
            found = self.state_at[nodes] = len(self.states)
            self.states.append(nodes)
            self.ending.append([(self.token_at[n], self.depth[n]) for n in nodes if self.token_at[n] != START])
        self.steps[state << 8 | byte] = found
        return found

    def piece(self, data: bytes) -> Iterator[list[int]]:
        """The ids of one piece, in runs, each as soon as it is certain; a piece that is a token is that token alone."""
        if len(data) <= self.longest and data in self.ranks:
            yield [self.ranks[data]]
            return
        state, last, steps, pairs, ending = 0, [START], self.steps, self.pairs, self.ending  # last: by prefix, from a certain border on
        for at in range(0, len(data), WINDOW):
            for byte in data[at : at + WINDOW]:
                following = steps.get(state << 8 | byte)
                state = self.step(state, byte) if following is None else following
                for token, size in ending[state]:
                    before = last[-size]
                    if pairs.get(before << 32 | token) or self.may_meet(before, token):
                        last.append(token)
                        break
                else:
                    raise ValueError("the ranks leave no reading of a piece")
            if at + WINDOW < len(data):
                border = self.shared_border(last, self.depth[self.states[state][0]])
                if border:
                    yield self.back(last, border)
                    del last[:border]
        yield self.back(last, len(last) - 1)

    def shared_border(self, last: list[int], reach: int) -> int:
        """Where the histories of all prefixes meet that a token to come may follow."""
        open_at = set(range(len(last) - 1 - reach, len(last)))
        while len(open_at) > 1:
            latest = max(open_at)
            open_at.remove(latest)
            open_at.add(latest - len(self.bytes_of[last[latest]]))
        return open_at.pop()

    def back(self, last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def remember(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece, from the older generation of remembered ones or by the transducer."""
        if len(self.pieces) >= PIECES:
            self.older, self.pieces = self.pieces, {}
        found = self.pieces[piece] = self.older.get(piece) or tuple([i for run in self.piece(piece.encode()) for i in run])
        return found

    def ids(self, text: str) -> Iterator[tuple[int, ...] | list[int]]:
        """The ids of a text, in runs; short pieces are remembered, the pieces of a long text are not held at once."""
        split = splitter(text)
        for at in (split.findall(text),) if len(text) <= LONG_TEXT else batched((m.group() for m in split.finditer(text)), LONG_TEXT >> 4):
            found = list(map(self.pieces.get, at))
            for i, run in enumerate(found):
                if run is None:
                    found[i] = self.pieces.get(at[i]) or self.remember(at[i]) if len(at[i]) <= PIECE_CHARS else chain.from_iterable(self.piece(at[i].encode()))
            yield from found

    def encode(self, text: str) -> array:
        return array("i", chain.from_iterable(self.ids(text)))


# The letters, numbers and white space below U+0180, as classes of a pattern.
NARROW = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ſ", r"\p{N}": "0-9²³¹¼½¾", r"\s": r"\t-\r \x85\xa0"}


@lru_cache(maxsize=1)
def patterns() -> tuple:
    """The vocabulary's pattern, for texts without characters from U+0180 on (by the faster library) and for all texts."""
    import re

    import regex
    from public_tokenizers import PATTERN

    narrow = re.sub(r"\[[^]]*\]", lambda m: re.sub(r"\\p\{.\}|\\s", lambda c: NARROW[c[0]], m[0]), PATTERN)
    narrow = re.sub(r"\\p\{.\}|\\s", lambda c: f"[{NARROW[c[0]]}]", narrow).replace(r"\S", f"[^{NARROW[chr(92) + 's']}]")
    return re.compile("[^\\x00-\u017f]"), re.compile(narrow), regex.compile(PATTERN)


def splitter(text: str):
    wide, narrow, whole = patterns()
    return narrow if text.isascii() or not wide.search(text) else whole


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    return Transducer(read_ranks(path))


# Well-formed UTF-8 by first byte: first and last such byte, length, least and greatest second byte.
SEQUENCES = (
    (0xC2, 0xDF, 2, 0x80, 0xBF), (0xE0, 0xE0, 3, 0xA0, 0xBF), (0xE1, 0xEC, 3, 0x80, 0xBF), (0xED, 0xED, 3, 0x80, 0x9F),
    (0xEE, 0xEF, 3, 0x80, 0xBF), (0xF0, 0xF0, 4, 0x90, 0xBF), (0xF1, 0xF3, 4, 0x80, 0xBF), (0xF4, 0xF4, 4, 0x80, 0x8F),
)
#: State 0 is between characters; another is what may follow, as ranges of the bytes to come.
BETWEEN: tuple = ()
AFTER = {first: ((low, high), *[(0x80, 0xBF)] * (length - 2)) for a, b, length, low, high in SEQUENCES for first in range(a, b + 1)}


def after(state: tuple, byte: int) -> tuple:
    """The state after a byte: ``BETWEEN`` where a character is complete or cannot become one."""
    if state and state[0][0] <= byte <= state[0][1]:
        return state[1:]
    return AFTER.get(byte, BETWEEN)


class Utf8:
    """Bytes in any cuts to text; holds back up to three bytes. What is no UTF-8 becomes U+FFFD, as in a whole decode."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        lead = next((k for k in range(1, min(3, len(data)) + 1) if not 0x80 <= data[-k] <= 0xBF), 0)
        state = BETWEEN
        for byte in data[len(data) - lead :]:
            state = after(state, byte)
        cut = len(data) - lead if state else len(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


#: What an id that no token has decodes to.
UNKNOWN = "�".encode()


def decoded(runs: Iterable[Iterable[int]], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """The text of ids that come in runs, in parts that end between characters; unknown ids become U+FFFD."""
    stream = Utf8()
    for run in runs:
        yield stream.feed(b"".join([bytes_of.get(i, UNKNOWN) for i in run]))
    yield stream.close()


def chunks(ids: pa.Array) -> Iterator[list[int]]:
    for at in range(0, len(ids), CHUNK):
        yield ids[at : at + CHUNK].to_pylist()


# Spark


def lists_of(batch: pa.RecordBatch, name: str) -> Iterator[pa.Array | None]:
    column = batch.column(name)
    for i in range(len(column)):
        yield column[i].values if column[i].is_valid else None


def encode(docs: DataFrame, text: str = "text", out: str = "ids", ranks: str | None = None) -> DataFrame:
    """``docs`` with the ids of its texts, an array; null texts have none, as empty ones. Other columns stay, whatever
    their names; a column called ``out`` in any case is replaced. Each match of the vocabulary's pattern is encoded by itself.

    A task holds the ids of a batch; a worker's memory of steps and pieces is bounded.
    """
    ready(docs.sparkSession)
    path = ranks or default_ranks()
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() != out.lower()])

    def run(batches: ArrowBatches) -> ArrowBatches:
        own = transducer(path)
        for batch in batches:
            offsets, ids = array("i", [0]), array("i")
            for value in batch.column(text):
                ids.extend(chain.from_iterable(own.ids(value.as_py() or "")))
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)]), pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)]))
            yield batch.append_column(out, lists)

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", ranks: str | None = None) -> DataFrame:
    """``rows`` with the text of their ids; null ids give null, unknown ones and broken characters U+FFFD. A column called
    ``out`` is replaced."""
    ready(rows.sparkSession)
    path = ranks or default_ranks()
    rows = rows.select(*[f"`{c}`" for c in rows.columns if c.lower() != out.lower()])

    def run(batches: ArrowBatches) -> ArrowBatches:
        table = transducer(path).bytes_of
        for batch in batches:
            texts = [None if x is None else "".join(decoded(chunks(x), table)) for x in lists_of(batch, ids)]
            yield batch.append_column(out, pa.array(texts, pa.string()))

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField(out, T.StringType())]))


def digests(rows: DataFrame, key: str = "doc_id", ids: str = "ids", ranks: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of ids, streamed: neither the decimal ids nor the decoded text is held whole.

    Null ids count as none.
    """
    ready(rows.sparkSession)
    path = ranks or default_ranks()
    rows = rows.select(f"`{key}`", f"`{ids}`")
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def run(batches: ArrowBatches) -> ArrowBatches:
        table = transducer(path).bytes_of
        for batch in batches:
            out = []
            for name, x in zip(batch.column(key).to_pylist(), lists_of(batch, ids), strict=True):
                said, text = hashlib.sha256(), hashlib.sha256()

                def heard(x=x, said=said):
                    space = ""
                    for run in chunks(x) if x is not None else ():
                        said.update((space + " ".join(map(str, run))).encode())
                        space = " "
                        yield run

                for part in decoded(heard(), table):
                    text.update(part.encode())
                out.append((name, 0 if x is None else len(x), said.hexdigest(), text.hexdigest()))
            yield arrow_batch(out, pa.schema([(key, batch.schema.field(key).type), *fields]))

    schema = T.StructType([rows.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return rows.mapInArrow(run, schema)
