"""Merkle fingerprints, license scans, packing and sentence pieces against brute force."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenground.llm import license_rules, licenses, merkle, packing, pieces, queries
from evenground.llm.common import tokenizer_path
from evenground.llm.license_rules import rules
from evenground.runtime import read_table


def texts(spark, folder):
    return sorted((r.doc_id, r.text or "") for r in read_table(spark, folder, "documents").select("doc_id", "text").collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_print(text):
    paragraphs = [[sha(x) for x in re.findall(r"(?:\S{1,64}\s*){1,8}|\s+", p, re.A)] for p in text.split("\n")]
    nodes = [sha("".join(p)) for p in paragraphs]
    shown = ["".join(x[:8] for x in p) for p in paragraphs]
    sections = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return f"{sha(''.join(sections))}:" + "|".join(f"{s[:8]}={'/'.join(shown[8 * i : 8 * i + 8])}" for i, s in enumerate(sections))


def plain_likeness(a, b):
    if a == b:
        return 1.0
    one, two = (set(f.split(":")[1].split("|")) for f in (a, b))
    leaves = lambda x: re.findall(".{8}", x)
    opened = lambda sections: {p for s in sections for p in s.split("=")[1].split("/")}
    shared = sum(len(leaves(p)) for s in one & two for p in s.split("=")[1].split("/"))
    one, two = opened(one - two), opened(two - one)
    shared += sum(len(leaves(p)) for p in one & two)
    one, two = ({x for p in side for x in leaves(p)} for side in (one - two, two - one))
    return (shared + len(one & two)) / max(1, shared + len(one | two))


def test_fingerprint_query_equals_brute_force(spark, llm_dir):
    docs = texts(spark, llm_dir)
    got = {r.doc_id: r for r in queries.queries()["op3_document_fingerprints"](spark, llm_dir).collect()}
    assert len(got) == len(docs)
    for at, (i, text) in enumerate(docs):
        following = docs[at - 1][1]  # descending ids; the smallest is followed by the largest
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        prints = [plain_print(x) for x in (text, edited, following)]
        row = got[i]
        assert (row.n_chars, row.edited_sha256, row.fingerprint, row.edited_fingerprint) == (len(text), sha(edited), prints[0], prints[1])
        assert row.near_edited == pytest.approx(plain_likeness(*prints[:2])) and row.near_next == pytest.approx(plain_likeness(prints[0], prints[2]))


def test_fingerprint_odd_rows(spark, odd_docs, no_docs):
    rows = merkle.edit_fingerprints(odd_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_docs.collect())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert merkle.edit_fingerprints(no_docs).count() == 0
    one = spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")
    assert merkle.edit_fingerprints(one).first().edited_sha256 == sha("abcdab")


def test_many_ids_of_one_kind_keep_their_order(spark):
    docs = spark.range(5000).selectExpr("(id * 7919) % 5003 as doc_id", "cast(id as string) as text")
    _in_order(docs)


def _in_order(docs, size=None):
    rows = merkle.with_next(docs, ["text"], size).collect()
    told = {r.doc_id: (r.text, r.next_text) for r in rows}
    ids = sorted(told)
    assert len(rows) == docs.count() == len(ids)
    assert all(told[i][1] == told[j][0] for i, j in zip(ids[1:], ids, strict=False)) and told[ids[0]][1] == told[ids[-1]][0]


def test_ids_far_apart_and_close_together_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 50)
    monkeypatch.setattr(merkle, "RANGE_BYTES", 2000)
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 3)
    crowded = "case when id % 3 = 0 then id when id % 3 = 1 then 4000000000000000000 + id * 1000003 else -9000000000000000000 + id end"
    _in_order(spark.range(1500).selectExpr(f"{crowded} as doc_id", "cast(id as string) as text"), F.octet_length("text"))


def test_edits_are_located(spark):
    lines = [f"paragraph {i} with words" for i in range(40)]
    edited = [*lines]
    edited[19] = "another one"
    frame = spark.createDataFrame([("\n".join(lines), "\n".join(edited))], "a string, b string")
    prints = frame.select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    assert prints.select(merkle.changed_paragraphs(F.col("a"), F.col("b"))).first()[0] == [19]


PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def plain_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_license_query_equals_brute_force(spark, llm_dir):
    docs = texts(spark, llm_dir)
    rows = {r.doc_id: r for r in queries.queries()["op9_license_scan"](spark, llm_dir).collect()}
    assert {i: tuple(rows[i])[1:6] for i, _ in docs} == {i: plain_base(t) for i, t in docs}
    assert any(r.n_base for r in rows.values())
    for r in rows.values():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))


def plain_detections(text, known):
    """(label, weight) of the detections that no other one contains, rules tried one by one without a gate."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    found = []
    for r in known:
        for m in r.finditer(low):
            found.append((m.start(), -m.end(), known.index(r)))
    found.sort()
    kept, end = [], -1
    for start, minus_end, rank in found:
        if -minus_end > end:
            kept.append(rank)
            end = -minus_end
    return kept


def test_every_rule_without_the_gate_by_brute_force(spark, llm_dir):
    told = rules()
    compiled = [re.compile(r.regex.replace(r"\x{10FFFF}", "\U0010ffff")) for r in told]
    examples = []
    for r in license_rules._RULES.strip().splitlines():
        words = r.split(": ", 1)[1]
        for _ in range(6):  # inner groups first: the first way through each group, optional ones kept
            words = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(?:\?|\{1,2\})?", r"\1", words)
        examples.append(re.sub(r"\[([^\]])[^\]]*\](?:\{\d\})?", r"\1", words).replace(" ?", " ").replace("?", ""))
    examples = [x.replace("copyright 0", "copyright 2020").replace("c 0", "c 2020") for x in examples]
    hit = [bool(c.search(x)) for c, x in zip(compiled, examples, strict=True)]
    assert all(hit), [x for x, h in zip(examples, hit, strict=True) if not h]
    docs = texts(spark, llm_dir)[:60] + [(10**6 + i, x.upper()) for i, x in enumerate(examples)] + [(2 * 10**6 + i, f"So: {x}, and\n{y}.") for i, (x, y) in enumerate(zip(examples, examples[1:], strict=False))]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        kept = plain_detections(text, compiled)
        base = plain_base(text)[4]
        labels = {told[k].label for k in kept} | set(filter(None, base.split(",")))
        score = max([told[k].weight for k in kept] + [licenses.BASE_WEIGHT if base else 0.0])
        assert (rows[i].labels, rows[i].score) == (",".join(sorted(labels)), pytest.approx(score)), text


def test_many_matches_in_one_text(spark):
    for n in (300, 16_000):
        docs = spark.createDataFrame([(1, "mit license, " * n + "all rights reserved worldwide")], "doc_id long, text string")
        began = time.perf_counter()
        row = licenses.scan(docs).first()
        took = time.perf_counter() - began
        assert (row.labels, row.n_base) == ("copyright,mit,reserved", 1)
        print(n, "matches", round(took, 1), "s")
    found = spark.range(1).select(licenses.detections(F.repeat(F.lit("mit license, "), 1000)).alias("d")).first().d
    assert [(x.start, -x.minus_end) for x in found] == [(13 * i, 13 * i + 11) for i in range(1000)]


def test_license_rules_and_suppression(spark, odd_docs, no_docs):
    assert len(rules()) > 200
    cases = {
        "Licensed under the Apache License, Version 2.0 (the \"License\")": "apache-2.0",
        "SPDX-License-Identifier: MIT": "mit",
        "GNU GENERAL PUBLIC LICENSE Version 3": "gpl,gpl-3.0",
        "This work is CC BY-SA 4.0": "cc-by,cc-by-sa-4.0",
        "CC_by and xcc by": "cc-by",
        "cc bye; ccby; succ by": "",
        "All\n\nRights -- RESERVED": "reserved",
        "plain words without anything": "",
    }
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    assert [r.labels for r in licenses.scan(frame).orderBy("doc_id").collect()] == list(cases.values())
    assert [plain_base(t)[4] for t in cases] == [r.base_labels for r in licenses.scan(frame).orderBy("doc_id").collect()]
    rows = licenses.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and next(r for r in rows if r.doc_id == 7).n_base == 3
    assert licenses.scan(no_docs).count() == 0


def check_packing(rows, docs, tokenizer, capacity=2048):
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(n, low, min(capacity, len(ids[i]) - low)) for n, low in enumerate(range(0, len(ids[i]), capacity))]
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes())
    for own in by_sequence.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= capacity
    total = sum(r.length for r in rows)
    return len(by_sequence), -(-total // capacity)


def test_packing_query(spark, llm_dir):
    from tokenizers import Tokenizer

    rows = queries.queries()["op8_best_fit_packing"](spark, llm_dir).collect()
    used, least = check_packing(rows, texts(spark, llm_dir), Tokenizer.from_file(tokenizer_path()))
    print("sequences", used, "at least", least)
    assert used <= least * 1.02 + 1


def test_packing_odd_rows(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, tokenizer_path()).collect()
    assert sum(r.piece == 0 for r in rows) == odd_docs.count() and {(r.length, r.ids_crc32) for r in rows if r.doc_id in (1, 2, 3)} == {(1, zlib.crc32(b"\0\0\0\0"))}
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


def test_plan_places_every_length_once():
    draw = np.random.default_rng(2)
    for _ in range(5):
        counts = Counter(draw.integers(1, 101, 400).tolist())
        plan = packing.plan_packing(dict(counts), 100)
        placed = Counter()
        for pattern, uses in plan:
            assert sum(pattern) <= 100
            for length in pattern:
                placed[length] += uses
        assert placed == counts
        assert sum(n for _, n in plan) <= -(-sum(k * n for k, n in counts.items()) // 100) * 1.06 + 2
    assert packing.plan_packing({}, 100) == []
    assert sum(n for _, n in packing.plan_packing({6: 9, 4: 9}, 10)) == 9


def best_fit(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else capacity) - length)
    return len(rooms)


def test_the_linear_program_packs_what_best_fit_cannot():
    for counts, capacity, least in (({44: 300, 33: 300, 23: 300}, 100, 300), ({51: 200, 27: 200, 26: 200, 23: 200, 25: 200}, 100, 317), ({6: 90, 4: 90, 3: 120, 7: 120}, 10, 210)):
        used = sum(n for _, n in packing.plan_packing(counts, capacity))
        assert least <= used <= least * 1.01 + 1, (used, least)
    assert best_fit({44: 300, 33: 300, 23: 300}, 100) == 325


def test_pieces_equal_the_library(spark, llm_dir):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    judge = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = {r.doc_id: r for r in queries.queries()["op10_sentencepiece"](spark, llm_dir).collect()}
    for i, text in texts(spark, llm_dir):
        ids = judge.encode(text)
        assert (rows[i].n_tokens, rows[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert rows[i].decoded_sha256 == sha(judge.decode(ids))
    assert all(r.parity for r in rows.values())


def test_pieces_odd_rows(spark, odd_docs, no_docs):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = pieces.encode_documents(odd_docs, path, with_ids=True).collect()
    assert len(rows) == odd_docs.count() and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert pieces.encode_documents(no_docs, path).count() == 0


def unigram_model(*more):
    """A small unigram model file, written field by field."""

    def field(number, value):
        return bytes([number << 3 | 2, len(value)]) + value

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + np.array(score, "<f4").tobytes() + bytes([3 << 3, kind]))

    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁ab", -1.0, 1), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -4.5, 1), ("c", -5.0, 1), *more]
    return b"".join(piece(*r) for r in rows) + field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 1]))


def test_a_unigram_model_is_rebuilt(spark, tmp_path):
    import sentencepiece

    path = str(tmp_path / "small.model")
    with open(path, "wb") as file:
        file.write(unigram_model())
    judge = sentencepiece.SentencePieceProcessor(model_file=path)
    cases = ["ab abc", "cab", "", "  a  b ", "zab", "c"]
    got = pieces.encode_documents(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string"), path, with_ids=True)
    rows = {r.doc_id: r for r in got.collect()}
    assert {i: np.frombuffer(r.ids, "<u4").tolist() for i, r in rows.items()} == {i: judge.encode(t) for i, t in enumerate(cases)}
    assert all(r.parity for r in rows.values())
    assert {i: r.decoded_sha256 for i, r in rows.items()} == {i: sha(judge.decode(judge.encode(t))) for i, t in enumerate(cases)}


def test_a_model_with_marks_inside_pieces_is_compared_whole(tmp_path):
    import sentencepiece

    whole = unigram_model(("ab▁c", -0.5, 1))
    path = str(tmp_path / "inside.model")
    with open(path, "wb") as file:
        file.write(whole)
    coder, judge = pieces.PieceEncoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    cases = ["ab c ab", "ab  ab c", "zz ab c", ""]
    got = coder.encode(cases)
    assert not coder.splits and [np.frombuffer(ids, "<u4").tolist() for ids, _ in got] == [judge.encode(t) for t in cases]
    assert [agreed for _, agreed in got] == [True] * 4
    coder.tokenizer = pieces.PieceModel.read(unigram_model(("ab▁c", -9.5, 1))).tokenizer()
    assert [agreed for _, agreed in coder.encode(cases)] == [False, False, False, True]
    assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in coder.encode(cases)] == [judge.encode(t) for t in cases]


def test_words_that_are_known_are_not_looked_through_again():
    """What a batch wants is looked up among the known words: these aren't passed over, however many they are."""
    from evenground.llm import words

    class Known(dict):
        def __iter__(self):
            raise AssertionError("all known words are passed over")

        def keys(self):
            return self.__iter__()

    encoder, text = words.WordEncoder(tokenizer_path()), "It's well-known; word word2 WORD, naïve — ok"
    encoder.known = Known()
    first = encoder.encode([text, "more words"])
    assert encoder.encode(["more words", text]) == first[::-1]
    assert np.frombuffer(first[0], "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_new_runs_go_to_the_libraries_together():
    """Many new words are few texts to both libraries, and each gets the ids that it has on its own; odd ones go one by one."""
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    coder, judge = pieces.PieceEncoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    words = [f"w{i * i}x{i}" for i in range(3000)]
    texts = [" ".join(words), "", " ", "  a   b ", "é 日本\n\nx \t", "▁▁ ▁a", "<s> <unk> </s> <0x0A>", "\x00 \U0001f600"]
    seen = []

    class Judge:
        def encode(self, given, **how):
            seen.extend(given)
            return judge.encode(given, **how)

    coder.judge = Judge()
    told = coder.round_trips(texts)
    assert [np.frombuffer(ids, "<u4").tolist() for ids, _, _ in told] == [judge.encode(t) for t in texts]
    assert [decoded for _, _, decoded in told] == [judge.decode(judge.encode(t)) for t in texts]
    assert len(seen) < 30 and coder.round_trips(texts) == told
    coder.known.clear()
    coder.judge = type("Other", (), {"encode": lambda self, given, **how: [[5] if t == words[7] else [0] + judge.encode(t) if words[7] in t else judge.encode(t) for t in given]})()
    assert [agreed for _, agreed, _ in coder.round_trips([words[7], words[8]])] == [False, True]
    assert np.frombuffer(coder.encode([words[7]])[0][0], "<u4").tolist() == [5]
