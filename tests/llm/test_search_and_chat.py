"""Exact top-k search and chat formatting against brute force."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenground.llm import chat, queries, topk
from evenground.runtime import read_table


def plain_top(rows, queries_, k):
    out = []
    for q, a in queries_:
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_query_equals_brute_force(spark, llm_dir):
    rows = []
    for r in read_table(spark, llm_dir, "embeddings").collect():
        if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding):
            rows.append((r.vec_id, [math.floor(256 * x) for x in r.embedding]))
    got = queries.queries()["op4_exact_topk"](spark, llm_dir)
    want = plain_top(rows, [x for x in rows if x[0] % 50 == 0], 5)
    assert want and sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want


def test_many_blocks_and_groups_in_one_plan(spark):
    draw = np.random.default_rng(11)
    rows = [(i, [int(x) for x in draw.normal(0, 1 + i % 9, 24) * 50]) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>")
    want = plain_top(rows, [x for x in rows if x[0] % 20 == 0], 5)
    for block, group in ((7, 100), (1000, 40), (5, 100_000)):
        got = topk.top_k(frame.where("vec_id % 20 = 0"), frame, 5, block, group)
        assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_ties_repeats_and_bad_vectors(spark, block):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.integers(-2, 3, 6)], "v") for i in range(60)]
    bad = [(100, None, "v"), (101, [1.0, None] * 3, "v"), (102, [1.0, float("nan")] * 3, "v"), (103, [float("inf")] * 6, "v"), (104, [], "v"), (None, [1.0] * 6, "v"), (105, [1.0] * 5, "v")]
    frame = topk.whole_vectors(spark.createDataFrame([*rows, rows[7], *bad], "vec_id long, embedding array<double>, v string"), scale=1.0)
    asked = frame.where("vec_id % 10 = 0")
    got = sorted(map(tuple, topk.top_k(asked, frame, 7, block).collect()))
    whole = [(i, [int(x) for x in v]) for i, v, _ in rows]
    assert got == plain_top(whole, [x for x in whole if x[0] % 10 == 0], 7)
    assert topk.top_k(asked.limit(0), frame, 7).count() == 0 == topk.top_k(frame.limit(0), frame.limit(0), 7).count()


def test_fewer_rows_than_asked_and_large_components(spark):
    frame = spark.createDataFrame([(0, [1 << 30, 3]), (50, [1 << 30, -5]), (7, [-(1 << 30), 2])], "vec_id long, v array<long>")
    got = topk.top_k(frame.where("vec_id % 50 = 0"), frame, 5).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == {
        (0, 1, 50, (1 << 60) - 15), (0, 2, 7, -(1 << 60) + 6), (50, 1, 0, (1 << 60) - 15), (50, 2, 7, -(1 << 60) - 10)
    }


def digests(turns):
    text = "".join(f"{role}\n{content}\n" for role, content in turns)
    loss = "".join(content for role, content in turns if role == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_query_equals_brute_force(spark, llm_dir):
    turns = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in read_table(spark, llm_dir, "conversations").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    want = {c: digests([t[1:] for t in sorted(x)]) for c, x in turns.items()}
    got = {r.conv_id: r for r in queries.queries()["op5_chat_format"](spark, llm_dir).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    assert all(r.formatted_chars >= r.loss_chars for r in got.values())


def test_stored_segments_and_whole_conversations_read_back(spark, tmp_path):
    rows = [(c, t, ("user", "assistant", "tool")[t % 3], f"turn {t} [INST] of </s> {c}") for c in range(20) for t in range(1 + c % 7)]
    segments = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = {r.conv_id: tuple(r) for r in chat.read_back(segments).collect()}
    segments.orderBy("rendered").write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert {r.conv_id: tuple(r) for r in chat.read_back(chat.in_order(stored)).collect()} == want
    with pytest.raises(Exception, match="out of order"):
        chat.read_back(stored.orderBy("rendered")).collect()
    for c in range(20):  # all segments as one text
        text = "".join(r.rendered for r in sorted(stored.where(f"conv_id = {c}").collect(), key=lambda r: r.segment)) if c % 6 == 0 else ""
        at, got = 0, []
        while at < len(text):
            role, content, _, _, at = chat.parse(text, at)
            got.append((role, content))
        assert not text or got == [r[2:] for r in rows if r[0] == c]


MARKS = ["[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[\\INST]", "<\\/s>", "[\\\\/INST]", "\\", "[", "<", "text", " ", "\n", "s>", "INST]"]


@settings(max_examples=500, deadline=None)
@given(st.sampled_from(["system", "user", "assistant", "tool", "", "[INST]", "</s>"]), st.lists(st.sampled_from(MARKS), max_size=12).map("".join))
def test_a_turn_always_reads_back(role, content):
    text, low, high = chat.render(role, content)
    got = chat.parse(text)
    assert got[:2] == (role, content) and got[2:4] == (low, high) and got[4] == len(text)
    assert chat.unescape(text[low:high]) == content


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", "y"), (2, 0, "assistant", "a" * 100_000), (1, 0, "user", None), (3, None, "system", "[SYS]"), (2, 1, "assistant", "</s>")]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, start int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(frame)).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == {
        1: digests([("user", ""), ("user", ""), ("", "x")]), None: digests([("assistant", "y")]), 2: digests([("assistant", "a" * 100_000), ("assistant", "</s>")]), 3: digests([("system", "[SYS]")])
    }
    assert chat.read_back(chat.format_chats(frame.limit(0))).count() == 0
