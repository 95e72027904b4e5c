"""Chat windows: template, spans, budgets and digests, against a plain reading of the conversations."""

import hashlib
import random
from collections import defaultdict

import pytest

from exprlake.llm import chat, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Digests of conversations by a dictionary, without windows."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role != "system", role or "", text or ""))
    out = {}
    for conv, items in turns.items():
        items.sort()
        said = "".join(f"{role}\n{text}\n" for *_, role, text in items)
        loss = "".join(text for *_, role, text in items if role == "assistant")
        out[conv] = (len(items), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(frame):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in frame.collect()}


@pytest.fixture(scope="module")
def path():
    return queries.vocabulary()


def test_escape_is_reversible_and_leaves_no_control_string():
    draw = random.Random(3)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", " [/INST]", "[INST] ", "\\", "<", "s>", "/", "\n", "ok", "é", "<\\s>", "[INST"]
    for _ in range(2_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 9)))
        role = "".join(draw.choice(parts) for _ in range(draw.randint(0, 3)))
        assert chat.unescape(chat.escape(text)) == text and not chat.CONTROLS.search(chat.escape(text))
        said, at = chat.written(role, text)
        assert chat.read_back("<s>" + said + said) == [(role, text)] * 2 and chat.unescape(said[at:-4]) == text


def test_query_equals_a_plain_reading(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    assert read(queries.op12_chat(spark, SF)) == plain([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def conversation(n, system=True, long_turn=None, seed=5):
    draw = random.Random(seed)
    rows = []
    for t in range(n):
        role = "system" if t == 0 and system else ("user", "assistant")[t % 2]
        words = 900 if t == long_turn else draw.randint(0, 40)
        rows.append((7, t, role, " ".join(draw.choice(["one", "two", "</s>", "\\"]) for _ in range(words))))
    return rows


@pytest.mark.parametrize("system, long_turn", [(True, None), (False, None), (True, 500), (True, 515)])
def test_windows_of_a_long_conversation(spark, path, system, long_turn):
    """Every own turn once and in order; budgets, system turn and history as promised; same results in pieces."""
    rows = conversation(700, system, long_turn)
    found = chat.windows(spark.createDataFrame(rows, SCHEMA), path, budget=400, history=100)
    got = sorted(found.collect(), key=lambda r: (r["segment"], r["window"]))
    assert read(chat.digests(found)) == plain(rows)
    own, split_targets = [], []
    for r in got:
        turns = chat.read_back(r["formatted"])
        assert len(turns) == r["turns"] and r["split"]
        assert r["over"] == (r["tokens"] > 400) and (not r["over"] or r["turns"] <= 2)
        if own and system:
            assert turns[0] == (rows[0][2], rows[0][3])
        repeated = turns[1 if own and system else 0 : r["repeated"]]
        assert repeated == own[len(own) - len(repeated) :]
        own += turns[r["repeated"] :]
        split_targets += [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss"]]
    assert own == [(role, text) for _, _, role, text in rows]
    assert split_targets == [text for _, _, role, text in rows if role == "assistant"]
    assert len({r["segment"] for r in got}) == 3 and any(r["repeated"] > 1 for r in got)
    assert any(r["over"] for r in got) == (long_turn is not None)


def test_few_waiting_turns_make_the_same_windows(spark, path, monkeypatch):
    turns = spark.createDataFrame(conversation(200), SCHEMA)
    once = chat.windows(turns, path, budget=300, history=80).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    size = lambda said: len(tokenizer.encode(said, add_special_tokens=False).ids)
    monkeypatch.setattr(chat, "WAITING", 3)
    made, segment = [], chat.Segment(300, 80, size("<s>"))
    for _, t, role, text in conversation(200):
        said, at = chat.written(role, text)
        made += segment.add(chat.OWN, chat.Turn(said, at, role == "assistant", size(said)), t == 0)
    made += segment.windows(last=True)
    assert [m[4] for m in made] == [r["formatted"] for r in sorted(once, key=lambda r: r["window"])]


def test_nulls_ties_repeats_and_clashing_names(spark, path):
    rows = [
        (None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, None, "assistant", "late"), (1, 0, None, None), (1, 300, "assistant", ""),
        (2, 5, "assistant", "x"), (2, 5, "assistant", "x"), (2, 5, "system", "s"), (2, 9, "tool", "[INST]"), (3, 0, "system", "only"), (4, -300, "user", "n"), (4, 700, "assistant", "m"),
    ]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", segment int, formatted string")
    assert read(chat.digests(chat.windows(frame, path))) == plain(rows)


def test_a_very_long_text(spark, path):
    rows = [(1, 0, "user", "why " * 100_000), (1, 1, "assistant", "[/INST]" * 30_000)]
    assert read(chat.digests(chat.windows(spark.createDataFrame(rows, SCHEMA), path))) == plain(rows)


def test_routes_joined_by_key(spark, path, monkeypatch):
    rows = conversation(600)
    monkeypatch.setattr(chat, "SMALL_ROUTES", -1)
    assert read(chat.digests(chat.windows(spark.createDataFrame(rows, SCHEMA), path))) == plain(rows)


def test_empty_table(spark, path):
    assert chat.digests(chat.windows(spark.createDataFrame([], SCHEMA), path)).count() == 0
