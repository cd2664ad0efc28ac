"""SimHash near duplicates against brute force."""

import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from evenground.llm import golay, queries, simhash
from evenground.runtime import read_table


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=4):
    """Smallest index reachable for every fingerprint of an array."""
    prints = np.array(prints, np.uint64)
    low = list(range(len(prints)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= bits) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            low[b] = a
    return [root(i) for i in range(len(prints))]


def test_query_equals_brute_force(spark, llm_dir):
    docs = sorted((r.doc_id, r.text) for r in read_table(spark, llm_dir, "documents").collect())
    prints = [plain_fingerprint(t) for _, t in docs]
    component = [docs[i][0] for i in plain_components(prints)]
    want = sorted((i, f"{p:016x}", c) for (i, _), p, c in zip(docs, prints, component, strict=True))
    got = queries.queries()["op6_simhash_dedup"](spark, llm_dir)
    assert sorted(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect())) == want
    assert len(set(component)) < len(component)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {None, 1, 2, 3} and {r.component_id for r in zero} == {1}
    assert {r.component_id for r in rows if r.doc_id in (-9, 10)} == {-9}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_every_link_within_four_bits_is_found_in_runs_of_any_size(spark):
    draw = np.random.default_rng(3)
    prints = []
    for _ in range(60):
        center = int(draw.integers(0, 1 << 63)) * 2 + 1
        for _ in range(8):
            flips = draw.choice(64, int(draw.integers(0, 6)), replace=False)
            prints.append(center ^ sum(1 << int(b) for b in flips))
    prints = sorted(set(prints))
    signed = [int(np.array(p, np.uint64).view(np.int64)) for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = plain_components(prints)
    for run_rows in (simhash.RUN_ROWS, 3):
        links = [tuple(r) for r in simhash.fingerprint_links(frame, run_rows=run_rows).collect()]
        assert all(bin(prints[signed.index(a)] ^ prints[signed.index(b)]).count("1") <= 4 for a, b in links)
        low = list(range(len(prints)))
        for _ in range(12):
            for a, b in links:
                i, j = signed.index(a), signed.index(b)
                low[i] = low[j] = min(low[i], low[j])
        assert low == want


def test_a_group_of_very_many_near_copies(spark):
    prints = spark.range(3000).selectExpr("cast(shiftleft(id % 3, 1) as long) + shiftleft(id div 3, 40) as fp")
    joined = simhash.connected_components(simhash.fingerprint_links(prints, run_rows=64), "a", "b")
    nodes = joined.count()
    assert nodes == prints.distinct().count() and joined.select("component").distinct().count() == 1


@settings(max_examples=200, deadline=None)
@given(st.integers(0, (1 << 22) - 1), st.sets(st.integers(0, 21), max_size=2))
def test_words_two_bits_apart_share_a_codeword(word, flips):
    other = word ^ sum(1 << b for b in flips)
    near = golay.nearby_indices(np.array([word, other]), 22)
    assert set(near[0].tolist()) & set(near[1].tolist())


def test_decoding_is_perfect():
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    index = golay.codeword_index(words)
    assert index.max() < 1 << 12
    code = np.array([i << 11 | golay._remainder(i << 11) for i in range(1 << 12)])
    assert (np.bitwise_count((code[index] ^ words).astype(np.uint32)) <= 3).all()


def test_slices_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"w{i % 113}" for i in range(900))
    whole = simhash.simhash(text.encode())
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.simhash(text.encode()) == whole == plain_fingerprint(text)
