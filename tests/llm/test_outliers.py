"""Quality rules against a plain calculation of counts and of the minimum covariance determinant."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from evenground.llm import outliers, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
D = outliers.D


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def vector(text):
    n, chars, symbols, doubled, repeats = counts(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    capitals, digits = (len(re.findall(p, text or "")) for p in ("[A-Z]", "[0-9]"))
    m, c = max(1, n), max(1, chars)
    shown = (math.log2(1 + n), math.log2(1 + chars / m), math.sqrt(symbols / m), math.sqrt(capitals / c), math.sqrt(digits / c), math.sqrt(doubled / max(1, len(lines))), math.sqrt(repeats / m))
    return tuple(round(1024 * v) for v in shown)


def failed(text):
    n, _, _, _, repeats = counts(text)
    return n < 20 or 100 * repeats > 30 * n


def plain_estimate(vectors):
    """(mean, covariance) of different lattice vectors of one group."""
    x = np.array(sorted(set(vectors)), float) / 1024
    n, floor = len(x), np.diag(np.square(outliers.FLOOR))

    def of(rows, factor):
        centred = rows - rows.mean(axis=0)
        return rows.mean(axis=0), factor * (centred.T @ centred) / len(rows) + floor

    def distances(mean, covariance):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(covariance), x - mean)

    quartiles = np.percentile(x, [25, 50, 75], axis=0)
    found = []
    for mean, covariance in (of(x, 1.0), (quartiles[1], np.diag(((quartiles[2] - quartiles[0]) / 1.349) ** 2) + floor)):
        was = (np.linalg.slogdet(covariance)[1], n)
        for _ in range(outliers.STEPS):
            with np.errstate(divide="ignore"):
                spot = np.clip(np.floor(64 * np.log2(distances(mean, covariance))), -768, 1536)
            edge = np.sort(spot)[min(n, (n + D + 1) // 2) - 1]
            near = x[spot <= edge]
            mean, covariance = of(near, outliers.consistency(len(near) / n))
            now = (np.linalg.slogdet(covariance)[1], len(near))
            if now[1] == was[1] and abs(now[0] - was[0]) <= 1e-9:
                break
            was = now
        found.append((np.linalg.slogdet(covariance)[1], len(found), mean, covariance))
    _, _, mean, covariance = min(found, key=lambda f: f[:2])
    near = x[distances(mean, covariance) <= outliers.chi_square_quantile(outliers.REWEIGHT, D)]
    return of(near, outliers.consistency(outliers.REWEIGHT))


def expected(rows):
    groups = {}
    for _, text, lang, source in rows:
        if not failed(text):
            groups.setdefault((lang or "", source or ""), []).append(vector(text))
    found = {g: plain_estimate(v) for g, v in groups.items()}
    out = []
    for doc_id, text, lang, source in rows:
        group = (lang or "", source or "")
        far = None
        if group in found:
            mean, covariance = found[group]
            off = np.array(vector(text)) / 1024 - mean
            far = math.sqrt(off @ np.linalg.inv(covariance) @ off)
        base = failed(text)
        out.append((doc_id, *counts(text), base, not base and far <= math.sqrt(outliers.chi_square_quantile(outliers.KEEP, D)), far))
    return out


def same(got, wanted):
    key = lambda r: tuple((v is None, v or 0) for v in r[:6])
    got, wanted = sorted(map(tuple, got), key=key), sorted(wanted, key=key)
    assert [r[:8] for r in got] == [r[:8] for r in wanted]
    for a, b in zip(got, wanted, strict=True):
        assert (a[8] is None) == (b[8] is None) and (b[8] is None or a[8] == pytest.approx(b[8], rel=1e-6, abs=1e-6))


def test_query_equals_plain_calculation(spark, llm_dir):
    table = spark.read.parquet(f"{llm_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    same(queries.queries()["op11_quality_rules"](spark, llm_dir).collect(), expected([tuple(r) for r in table]))


def test_odd_rows(spark, odd_docs, no_docs):
    df = odd_docs.selectExpr("*", "case when doc_id > 6 then 'en' end as lang", "cast(null as string) as source", "1 as z0", "2L as n_words", "0D as d2")
    got = outliers.judge(df).collect()
    same(got, expected([tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]))
    empty = no_docs.selectExpr("*", "'en' as lang", "'s' as source")
    assert outliers.judge(empty).count() == 0


def test_many_groups_are_joined_by_salt(spark, llm_dir, monkeypatch):
    docs = spark.read.parquet(f"{llm_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    want = sorted(map(str, outliers.judge(docs).collect()))
    monkeypatch.setattr(outliers, "FEW_STATES", 3)
    assert sorted(map(str, outliers.judge(docs).collect())) == want


def test_outliers_go_and_copies_weigh_nothing(spark):
    draw = random.Random(5)
    prose = lambda: " ".join("".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(60, 600)))
    rows = [(i, prose(), "en", "a") for i in range(150)]
    rows += [(1000 + i, rows[0][1], "en", "a") for i in range(400)]
    noisy = [(2000 + i, " ".join(f"{w.upper()}$$$ %%%" for w in prose().split()), "en", "a") for i in range(30)]
    got = {r["doc_id"]: r for r in outliers.judge(spark.createDataFrame(rows + noisy, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[r[0]]["kept"] for r in rows)
    assert not any(got[r[0]]["kept"] for r in noisy) and not any(got[r[0]]["base_failed"] for r in noisy)


@pytest.mark.parametrize("text", ["a b c d e f g h " * 2, "a b c d e f g h a b c d e f g h", "x " * 9, "x " * 8, "a b c d e f g h i a b c d e f g x a b c d e f g h"])
def test_repeated_words(text):
    assert outliers.repeated_words(text.encode().split()) == counts(text)[4]


def test_repeated_words_at_random():
    draw = random.Random(1)
    for _ in range(300):
        text = " ".join(draw.choice("ab") for _ in range(draw.randint(0, 60)))
        assert outliers.repeated_words(text.encode().split()) == counts(text)[4]


def test_chi_square():
    assert outliers.chi_square(outliers.chi_square_quantile(0.975, 7), 7) == pytest.approx(0.975)
    assert outliers.chi_square_quantile(0.5, 7) == pytest.approx(6.3458, abs=1e-3)
    assert outliers.chi_square_quantile(0.975, 1) == pytest.approx(5.0239, abs=1e-3)


def test_clean_documents_stay(spark, llm_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{llm_dir}/labels.parquet").collect()}
    got = queries.queries()["op11_quality_rules"](spark, llm_dir).collect()
    clean = [r["kept"] for r in got if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(clean) >= 0.99 * len(clean)
