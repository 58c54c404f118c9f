"""Chat windows: round trips of the template, windows against a plain walk, edge rows."""

import collections
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import chat, queries
from strandline.llm.common import durable

SCHEMA = "conv_id long, turn long, role string, text string, window long, at int, n string"
BITS = [*chat.TEMPLATE._all, "<", "[", "/", "\\", "s>", "SYS>>", "INST]", "a", "é🙂", "\n", "<<", "<\\s>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "", "tool", "</s>", "[SAYS]"]), st.lists(st.sampled_from(BITS)).map("".join)), max_size=6))
def test_any_text_comes_back(turns):
    t = chat.TEMPLATE
    formatted = ""
    for role, text in turns:
        own, a, b = t.turn(role, text)
        assert t.unescaped(own[a:b]) == text and t._mark.search(own[a:b]) is None
        formatted += own
    assert list(t.parsed(formatted)) == turns


def rows(seed, convs=6, most=40):
    rng = random.Random(seed)
    out = []
    for c in range(convs):
        n = rng.randint(1, most)
        for i in range(n):
            role = "system" if i == 0 and c % 2 else rng.choice(["user", "assistant", "assistant", "tool"])
            text = rng.choice([None, "", "</s>[INST] ok [/INST]", " ".join("w" for _ in range(rng.randint(0, 30)))])
            out.append((c or None, i, role, text, 1, 2, "x"))
    return out


def digest(turns):
    """What the contract says of the turns of one conversation, in order."""
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def walk(turns, budget, history, most, block):
    """Windows of one conversation by a plain walk: (first, new, repeated)."""
    size = [chat.count_pieces(chat.TEMPLATE.turn(r or "", t or "")[0]) for r, t in turns]
    head = 0 if turns[0][0] == "system" else None
    fixed = 0 if head is None else size[0]
    out, i = [], 0
    while i < len(turns):
        new, past = [i], []
        rest = 0 if i == head else fixed
        if i != head:
            room = min(history, budget - fixed - size[i])
            for j in range(i - 1, max(-1, i - 1 - most), -1):
                if j == head or j < (i // block - 1) * block or size[j] > room:
                    break
                past.insert(0, j)
                room -= size[j]
        while new[-1] + 1 < len(turns) and (new[-1] + 1) % block and rest + sum(size[k] for k in past + new) + size[new[-1] + 1] <= budget:
            new.append(new[-1] + 1)
        out.append((i, new, ([] if head is None or i == head else [head]) + past))
        i = new[-1] + 1
    return out


@pytest.mark.parametrize(("budget", "history", "most", "block"), [(60, 20, 2, 8), (40, 0, 0, 1000), (200, 200, 9, 16), (1, 1, 1, 3)])
def test_windows_equal_a_plain_walk(spark, budget, history, most, block):
    data = rows(3)
    windows = durable(chat.format_windows(spark.createDataFrame(data, SCHEMA).repartition(5), budget, history, most, block), "test-windows")
    got = collections.defaultdict(list)
    for w in sorted(windows.collect(), key=lambda r: r["window"]):
        got[w["conv_id"]].append(w)
    for conv in {r[0] for r in data}:
        turns = [(r[2], r[3]) for r in sorted((r for r in data if r[0] == conv), key=lambda r: r[1])]
        want = walk(turns, budget, history, most, block)
        assert [(w["first_turn"], w["n_new"], w["n_repeated"]) for w in got[conv]] == [(i, len(new), len(old)) for i, new, old in want]
        for w, (_, new, old) in zip(got[conv], want, strict=True):
            assert list(chat.TEMPLATE.parsed(w["text"])) == [(turns[k][0], turns[k][1] or "") for k in old + new]
            assert w["n_tokens"] <= budget or len(new) == 1
            assert [chat.TEMPLATE.unescaped(w["text"][s["start"] : s["end"]]) for s in w["loss"]] == [turns[k][1] or "" for k in new if turns[k][0] == "assistant"]
    back = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    assert back == {conv: digest([(r[2], r[3]) for r in sorted((r for r in data if r[0] == conv), key=lambda r: r[1])]) for conv in {r[0] for r in data}}


def test_a_conversation_over_many_partitions_and_blocks(spark):
    turns = [(7, i, "system" if i == 0 else ("assistant" if i % 2 == 0 else "user"), f"turn {i} of many") for i in range(3000)] + [(7, 5, "user", "turn 5 of many")] * 50
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        windows = durable(chat.format_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 64, 16, 2, 100), "test-long")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = sorted(windows.collect(), key=lambda r: r["window"])
    assert sum(w["n_new"] for w in found) == 3050 and all(w["text"].startswith("<<SYS>>turn 0") for w in found)
    assert all(b["first_turn"] == a["first_turn"] + a["n_new"] for a, b in zip(found, found[1:]))
    assert tuple(chat.read_back(windows).first())[1:5] == digest([(r[2], r[3]) for r in sorted(turns, key=lambda r: r[1])])


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.chat_digest(none).count() == 0
    odd = [(1, None, None, None, 1, 1, "x"), (1, 0, "user", " ", 1, 1, "x"), (1, 0, "user", " ", 1, 1, "x"), (None, 3, "assistant", "word " * 50_000, 1, 1, "x")]
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.chat_digest(spark.createDataFrame(odd, SCHEMA)).collect()}
    assert got == {1: digest([("", ""), ("user", " "), ("user", " ")]), None: digest([("assistant", "word " * 50_000)])}


def test_the_query_holds_marks_as_text(spark):
    got = {r["conv_id"]: r for r in queries.op12_chat_windows(spark, "/root/testdata/sf0.001").collect()}
    marked = "</s>[INST] ok [/INST]"
    assert tuple(got[-1])[1:5] == digest([("user", marked), ("assistant", marked)])
    turns = collections.defaultdict(list)
    for r in sorted(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect(), key=lambda r: r["turn"]):
        turns[r["conv_id"]].append((r["role"], r["text"]))
    assert {c: digest(t) for c, t in turns.items()} == {c: tuple(r)[1:5] for c, r in got.items() if c != -1}


def test_tokens_of_a_tokenizer_file(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    it = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    it.pre_tokenizer = pre_tokenizers.Whitespace()
    it.save(str(tmp_path / "t.json"))
    assert chat.tokenizer_counts(str(tmp_path / "t.json"))("a b zzz") == 3
