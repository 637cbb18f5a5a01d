"""The search against a plain one on audit strings and against all sequences of edits; faults and repaired rows by hand."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from parallax.llm import repair
from parallax.llm.repair import CUT_OFF, MUST_GO, Search, Transitions

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(codes):
    """Least (cost, audit) by state, with audits as strings."""

    def insertions(layer):
        for _ in range(3):
            for s, found in list(layer.items()):
                way, to = (found[0] + 2, found[1] + "I"), repair.WANTED[s]
                layer[to] = min(layer.get(to, way), way)
        return layer

    layer = insertions({0: (0, "")})
    for code in codes:
        after = {}
        for s, (cost, audit) in layer.items():
            for edit, price, to in repair.choices(s, code):
                way = (cost + price, audit + edit)
                after[to] = min(after.get(to, way), way)
        layer = insertions(after)
    return min(layer[s] for s in (0, 3) if s in layer)


def every(codes):
    """The same by trying all sequences of edits with up to two insertions in each gap."""
    best = None
    for edits in itertools.product("DKR", repeat=len(codes)):
        for gaps in itertools.product(range(3), repeat=len(codes) + 1):
            state, cost, audit = 0, 0, ""
            for at, k in enumerate(gaps):
                for _ in range(k):
                    state, cost, audit = repair.WANTED[state], cost + 2, audit + "I"
                if at < len(codes):
                    ways = [w for w in repair.choices(state, codes[at]) if w[0] == edits[at]]
                    if not ways:
                        break
                    state, cost, audit = ways[0][2], cost + ways[0][1], audit + edits[at]
            else:
                if state in (0, 3) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def searched(codes, transitions):
    s = Search(transitions)
    for c in codes:
        s.add(c)
    return s.finish()


ALL = [i * 4 + bits for i in range(4) for bits in (0, MUST_GO, CUT_OFF)]


def test_search_equals_all_sequences_of_edits():
    transitions = Transitions()
    for n in range(4):
        for codes in itertools.product(ALL if n < 3 else [0, 4, 8, 12, 6], repeat=n):
            assert searched(codes, transitions) == plain(codes) == every(codes), codes


def test_search_equals_plain_strings_on_long_conversations():
    rng, transitions = random.Random(4), Transitions()
    for _ in range(400):
        few = rng.sample(ALL, rng.randrange(1, 5))
        codes = [rng.choice(few) for _ in range(rng.randrange(1, 120))]
        assert searched(codes, transitions) == plain(codes)
    assert len(transitions.known) < 4000


def test_a_long_conversation_takes_linear_time():
    cost, audit = searched([12] * 300_001, Transitions())
    assert (cost, audit) == (3 + 2 * 300_000, "D" + "R" * 300_000)


def brute(rows):
    """A row of results by conv_id of turns (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted([(t is not None, t or 0, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv], key=lambda v: (v[0], v[1], v[3].encode(), v[4].encode()))
        seen, codes, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for *_, role, text in own:
            said = text.strip(repair.WHITE)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            codes.append(("sua".find(role[:1]) if role[:1] and role[0] in "sua" else 3) * 4 + (MUST_GO if fault in ("blank", "duplicate") else CUT_OFF if fault else 0))
        illegal = sum(a[3][:1] + b[3][:1] not in repair.LEGAL for a, b in zip(own, own[1:], strict=False))
        turns = [v[2] for v in own if v[2] is not None]
        cost, audit = plain(codes)
        state, lines, todo = 0, [], iter(own)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(todo)[3:]
            if edit != "D":
                state = repair.KEPT[state, role[0]] if edit == "K" else repair.WANTED[state]
                lines.append(f"{role if edit == 'K' else repair.ROLE[state]}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, rows):
    audits, fixed = repair.repair(spark.createDataFrame(rows, SCHEMA))
    shas = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(fixed).collect()}
    return {r["conv_id"]: (*tuple(r)[1:], shas.get(r["conv_id"], hashlib.sha256(b"").hexdigest())) for r in audits.collect()}


def test_tables_equal_brute_force(spark):
    rng = random.Random(8)
    texts = ["Yes.", "no", "What?", "", " \t", None, "wait!\n", "end. ", "\xa0", "x. "]
    rows = [(rng.choice([1, 2, 3, 4, 5, 6, 7, None]), rng.choice([0, 1, 2, 3, 5, 9, None]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for _ in range(160)]
    rows += [(50, i, "ua"[i % 2], f"{i}.") for i in range(3000)] + [(51, 0, "user", " "), (52, -(2**62), "user", "a."), (52, 2**62, "assistant", "b.")]
    assert run(spark, rows) == brute(rows)


def test_planted_faults(spark):
    turns = spark.createDataFrame([(c, t, "assistant" if t % 2 else "user", f"Text {c} {t}. More!") for c in range(60) for t in range(4)], SCHEMA)
    kinds = turns.select("*", (F.crc32(F.concat_ws(":", "conv_id", "turn")) % 20).alias("k")).collect()
    got = {}
    for r in repair.damaged(turns).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    for conv, turn, role, text, k in kinds:
        wanted = {0: None, 1: [(role, "")], 2: [(role, text.replace(".", "").replace("!", ""))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(k, [(role, text)])
        assert got.get((conv, turn)) == wanted
    assert {k for *_, k in kinds} >= {0, 1, 2, 3, 4}


def test_empty_tables_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", code string, Position int")
    audits, fixed = repair.repair(empty)
    assert audits.count() == 0 == fixed.count() == repair.digests(fixed).count() == repair.damaged(empty).count()
    extra = spark.createDataFrame([(1, 0, "user", "a.", "x", 2), (1, 1, "assistant", "b.", "y", 3)], SCHEMA + ", code string, Position int")
    audits, fixed = repair.repair(extra)
    assert audits.first()["audit"] == "KK" and [tuple(r) for r in fixed.collect()] == [(1, 0, "user", "a."), (1, 1, "assistant", "b.")]


def test_digests_refuse_conversations_out_of_order(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b."), (1, 0, "user", "a.")], "conv_id long, position long, role string, text string").coalesce(1)
    with pytest.raises(Exception, match="sort conversations"):
        repair.digests(rows).collect()
