import hashlib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from parallax.llm import chat

PARTS = st.lists(st.sampled_from(["<|turn|>", "<|text|>", "<|end|>\n", "<", "|", ">", "\\", "</s>", "[INST]", "[/INST]", "x", "\n", "<<SYS>>", "é"]) | st.text(max_size=4), max_size=12).map("".join)


@given(st.lists(st.tuples(PARTS, PARTS), max_size=4))
def test_round_trip_and_no_mark_inside(turns):
    text = chat.formatted(turns)
    assert [(r, t) for r, t, _, _ in chat.read_back(text)] == turns
    assert text.count(chat.TURN) == len(turns)
    for role, said in turns:
        assert not chat.CONTROL.search(chat.escape(role)) and not chat.CONTROL.search(chat.escape(said))


@pytest.mark.parametrize(
    "record, turns",
    [
        ({"role": "user", "text": "hi"}, [("user", "hi")]),
        ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "input": "", "output": None}, [("user", "i"), ("assistant", "")]),
        ({"messages": [{"role": "system", "content": "s"}, {"content": "u", "role": "user"}]}, [("system", "s"), ("user", "u")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"system": None, "prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
        ({"unknown": 1}, [(None, None)]),
    ],
)
def test_layouts(spark, record, turns):
    records = spark.createDataFrame([(1, 0, json.dumps(record))], "record_id long, at long, body string")
    assert [(r["role"], r["text"]) for r in chat.canonical(records).orderBy("position").collect()] == turns


def test_malformed_records_are_kept(spark):
    records = spark.createDataFrame([(1, 0, None), (2, 0, "{"), (None, None, "[1]")], "record_id long, at long, body string")
    assert [r["layout"] for r in chat.canonical(records).collect()] == [None] * 3


def test_ids_beyond_doubles_beside_a_null(spark):
    ids = [2**53 + 1, 2**53, 2**63 - 1, -(2**63), None]
    records = spark.createDataFrame([(i, 0, json.dumps({"role": "user", "text": str(i)})) for i in ids], "record_id long, at long, body string").coalesce(1)
    got = chat.digests(chat.format_chats(chat.canonical(records))).collect()
    assert {(r["conv_id"], r["turns_sha256"]) for r in got} == {(i, hashlib.sha256(f"user\n{i}\n".encode()).hexdigest()) for i in ids}


def test_records_without_an_id_are_conversations_of_their_own(spark):
    body = json.dumps({"prompt": "p", "completion": "c"})
    got = chat.digests(chat.format_chats(chat.canonical(spark.createDataFrame([(None, 0, body)] * 5, "record_id long, at long, body string")))).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(None, 2)] * 5


def test_a_long_conversation_is_cut_between_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 100)
    said = [("user" if i % 2 == 0 else "assistant", f"<|turn|> {i} " * (i % 7)) for i in range(200)]
    turns = spark.createDataFrame([(4, i, 0, r, t) for i, (r, t) in enumerate(said)] + [(5, 0, 0, "user", "x")], "record_id long, at long, position int, role string, text string")
    parts = sorted((r["part"], r["formatted"]) for r in chat.format_chats(turns).filter("conv_id = 4").collect())
    assert len(parts) > 20 and [p for p, _ in parts] == list(range(len(parts)))
    assert "".join(t for _, t in parts) == chat.formatted(said)
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(turns)).collect()}
    assert set(got) == {4, 5} and got[4]["n_turns"] == 200 and got[4]["formatted_chars"] == len(chat.formatted(said))
    assert got[4]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert got[4]["loss_sha256"] == hashlib.sha256("".join(t for r, t in said if r == "assistant").encode()).hexdigest()


def test_conversations(spark):
    rows = [(2, 1, "assistant", "b</s>"), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, None, None, None), (7, 0, "assistant", "x" * 300_000), (7, 1, "assistant", "")]
    turns = spark.createDataFrame([(c, t, 0, r, x, "clash") for c, t, r, x in rows], "record_id long, at long, position int, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(turns)).collect()}
    assert {c: r["n_turns"] for c, r in got.items()} == {2: 3, None: 1, 7: 2}
    whole = "user\na\nuser\na\nassistant\nb</s>\n"
    assert got[2]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert got[2]["loss_sha256"] == hashlib.sha256(b"b</s>").hexdigest() and got[7]["loss_chars"] == 300_000
    assert chat.digests(chat.format_chats(turns.limit(0))).count() == 0


def test_digests_refuse_parts_out_of_order(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 40)
    turns = spark.createDataFrame([(c, t, 0, "user", f"said {c} {t} " * 5) for c in range(3) for t in range(6)], "record_id long, at long, position int, role string, text string")
    parts = chat.format_chats(turns.coalesce(1)).orderBy("conv_id", "part").coalesce(1)
    assert chat.digests(parts).count() == 3
    with pytest.raises(Exception, match="out of order"):
        chat.digests(parts.filter("part <> 1")).collect()
