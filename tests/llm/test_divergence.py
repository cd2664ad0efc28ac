"""The divergence audit against a plain calculation."""

import re
from collections import Counter

import pytest

from evenground.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    """What the audit of rows (text, lang, source) returns, sorted."""
    groups, docs, langs = {}, Counter(), {}
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(FOLD))
        lang, source = lang or "", source or ""
        groups.setdefault((lang, source), Counter()).update(words)
        langs.setdefault(lang, Counter()).update(words)
        docs.update((lang, w) for w in set(words))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for (lang, source), counts in groups.items():
        kept = [w for w in langs[lang] if docs[lang, w] >= 10]
        share = lambda c, kept=kept: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}
        own, whole = share(counts), share(langs[lang])
        pairs = [(-sum(f(own[w], other[w]) for w in kept), s.encode()) for (x, s), c in groups.items() if x == lang and s != source for other in [share(c)]]
        found = [(-f(own[w], whole[w]), w.encode()) for w in kept if counts[w] and own[w] > whole[w]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(found)[:10])):
            out += [(lang, source, part, item.decode(), -v, i) for i, (v, item) in enumerate(items, 1)]
    return sorted(out)


def told(spark, rows, **more):
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], "text string, lang string, source string, term string, n int, g int")
    return sorted(tuple(r) for r in divergence.audit(df.repartition(3), **more).select("lang", "source", "part", "item", "value", "rank").collect())


def some_rows(sources=7):
    rows = []
    for i in range(260):
        words = [f"w{'abcdefgh'[(i * j) % 8]}{'xyz'[(i + j) % 3]}" for j in range(i % 40)] + ["Straße"] * (i % 3) + (["ONLY", "here"] * 2 if i % sources == 3 else [])
        rows.append((" ".join(words), ("de", "en", None)[i % 13 % 3], f"s{i % sources}"))
    return rows


def test_audit_equals_plain_calculation(spark):
    rows = some_rows() + [(None, "en", "s1"), ("", "en", None), ("2 + 2", "xx", "alone"), ("rare words", "xx", "other"), ("a-b_c'd Ä_é\x00Q " * 11, "de", "s2")]
    rows += [("same text stands here", "en", "copies")] * 12
    assert told(spark, rows) == expected(rows)


@pytest.mark.parametrize("block", [2, 3])
def test_blocks_change_nothing(spark, block):
    assert told(spark, some_rows(), block=block) == expected(some_rows())


def test_rounds_change_nothing(spark):
    assert told(spark, some_rows(3), first=1) == expected(some_rows(3))


def test_ties_go_by_the_items_bytes(spark):
    rows = [(f"{w} common", "en", s) for s in ("b", "a", "Z", "é") for w in ("q", "r", "é", "z") for _ in range(3)]
    assert told(spark, rows) == expected(rows)


def test_empty_table_and_long_text(spark, no_docs, monkeypatch):
    df = no_docs.selectExpr("text", "cast(null as string) as lang", "cast(null as string) as source")
    assert divergence.audit(df).count() == 0
    text = ("one two three four five six\n" * 3000).encode()
    whole = [w for part in divergence.terms(text) for w in part]
    monkeypatch.setattr(divergence, "SLICE", 100)
    assert [w for part in divergence.terms(text) for w in part] == whole == text.split()
