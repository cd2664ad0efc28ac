"""Near copies by shingle sets against brute force."""

import random

import numpy as np

from evenground.llm import near_copies, simhash


def plain_components(rows):
    sets = []
    for _, text in rows:
        words = text.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    low = list(range(len(rows)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def edited_texts():
    draw = random.Random(7)
    passage = [f"c{i}" for i in range(60)]  # in every third text
    rows = []
    for group in range(40):
        base = [f"w{draw.randrange(4000)}" for _ in range(draw.choice((3, 12, 80, 200)))] + (passage if group % 3 == 0 else [])
        for _ in range(12 if group else 60):
            words = list(base)
            for _ in range(draw.randrange(0, 1 + len(words) // 40)):
                words[draw.randrange(len(words))] = f"n{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_near_copies_are_those_of_brute_force(spark, monkeypatch):
    rows = edited_texts()
    want = plain_components(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame).collect()} == want
    assert 40 <= len(set(want.values())) < len(rows)


def test_long_runs_are_cut_into_blocks(spark):
    rows = edited_texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for run_rows, block_rows in ((1, 7), (20, 1000)):
        found = near_copies.near_copies(frame, run_rows, block_rows)
        assert {r.doc_id: r.component_id for r in found.collect()} == plain_components(rows)


def some_sets(n, kin):
    """(sid, n, bits, members) of ``n`` random sets that share one member; every one of the last ``kin`` is like the first."""
    draw = np.random.default_rng(11)
    first = np.unique(draw.integers(-(2**62), 2**62, 100))
    rows = []
    for sid in range(n):
        members = np.unique(np.concatenate([first[:97], draw.integers(-(2**62), 2**62, 3)])) if sid == 0 or sid >= n - kin else np.unique(np.append(draw.integers(-(2**62), 2**62, 99), first[0]))
        rows.append((sid, len(members), near_copies.parities(members), members))
    return rows


def test_a_key_of_very_many_unlike_sets_offers_few_pairs(spark):
    sets = some_sets(6000, 3)
    classes = spark.createDataFrame([(s, n, b) for s, n, b, _ in sets], "sid long, n int, bits binary")
    shared = spark.createDataFrame([(5, s, n, 0) for s, n, _, _ in sets], "key long, sid long, n int, at int")
    parts = spark.createDataFrame([], "sid long, part long")
    offered = {(r.a, r.b) for r in near_copies._rest(shared, parts, classes, 512, 1500).collect()}
    alike = {(a[0], b[0]) for i, a in enumerate(sets) if a[0] == 0 or a[0] >= 5997 for b in sets[i + 1 :] if b[0] >= 5997 and near_copies.similar(a[3], b[3])}
    assert len(alike) == 6 and alike <= offered and len(offered) < 1000


def test_the_stage_drops_near_copies_beyond_four_bits(spark):
    import corpus_pipeline

    rows = edited_texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.keep_one_copy(spark, frame, "").collect()}
    assert kept == set(plain_components(rows).values())
    assert len({r.component_id for r in simhash.near_duplicates(frame).collect()}) > len(kept)


def test_rows_of_one_id_are_told_apart(spark):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(100))
    near = long.replace("w99", "x")
    rows = [(1, long), (2, long), (2, "a text of its own that no other row has"), (None, "no id"), (None, "no id"), (3, "twice the very same row"), (3, "twice the very same row"), (4, near), (5, ""), (6, None), (7, long)]
    frame = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, digest int, class_id string")
    kept = corpus_pipeline.keep_one_copy(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, (rows[i] for i in (0, 2, 3, 4, 5, 8))))


def test_one_id_with_two_texts_of_a_group_stays_once(spark):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(100))
    frame = spark.createDataFrame([(1, long), (1, long.replace("w99", "x")), (1, "quite another text for this id"), (2, long)], "doc_id long, text string")
    kept = [r.text for r in corpus_pipeline.keep_one_copy(spark, frame, "").collect()]
    assert len(kept) == 2 and "quite another text for this id" in kept


def test_bitmaps_never_rule_out_similar_sets():
    draw = random.Random(3)
    for _ in range(300):
        base = draw.sample(range(-(10**12), 10**12), draw.choice((1, 3, 20, 200, 600)))
        gone = draw.randrange(0, len(base) // 5 + 1)
        a = np.unique(np.array(base, np.int64))
        b = np.unique(np.array(base[gone:] + draw.sample(range(10**13, 10**14), draw.randrange(0, len(base) // 5 + 1)), np.int64))
        assert near_copies.at_least_differing(near_copies.parities(a), near_copies.parities(b)) <= len(np.setxor1d(a, b))
