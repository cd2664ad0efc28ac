"""Toxicity and quality: held-out accuracy, inputs, odd rows."""

import zlib

import numpy as np
import pytest

from evenground.llm import labelled, quality, queries, toxicity
from evenground.runtime import read_table

FITTED = "/root/testdata/sf0.01"


def ranked_right(scores, y):
    """Share of (label 1, label 0) pairs with the higher score at label 1; ties count half."""
    one, zero = scores[y == 1], scores[y == 0]
    return ((one[:, None] > zero[None, :]).mean() + (one[:, None] == zero[None, :]).mean() / 2).item()


@pytest.mark.parametrize(("query", "label", "threshold"), [("op1_toxicity", "toxic", 0.5), ("op7_quality_classifier", "quality", 0.3)])
def test_held_out_rows_are_told_apart(spark, query, label, threshold):
    scored = queries.queries()[query](spark, FITTED)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in scored.collect()}
    assert len(rows) == read_table(spark, FITTED, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows.values())
    told = [(rows[r.doc_id].score, r[label]) for r in read_table(spark, FITTED, "labels").collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    scores, y = np.array([s for s, _ in told]), np.array([v for _, v in told])
    right = ((scores >= threshold) == y).mean()
    print(query, "held out", len(y), "ranked", round(ranked_right(scores, y), 3), "accuracy", round(right, 3), "most frequent", round(max(y.mean(), 1 - y.mean()), 3))
    assert ranked_right(scores, y) > 0.85
    assert right >= max(y.mean(), 1 - y.mean())


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_odd_rows_and_missing_labels(spark, odd_docs, no_docs, operator):
    label = "toxic" if operator is toxicity else "quality"
    none = spark.createDataFrame([(None, 1), (4, None), (4, 7)], f"doc_id long, {label} int")
    some = spark.createDataFrame([(1, 0), (2, 1), (4, 1), (6, 0), (7, 0), (8, 1), (10, 0), (4, 0), (99, 1)], f"doc_id long, {label} int")
    apply = toxicity.toxicity if operator is toxicity else quality.quality
    for labels in (none, some):
        model = operator.fit(odd_docs, labels)
        rows = apply(odd_docs, model).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 4}) == 1
        assert apply(no_docs, model).count() == 0
    assert 0 <= apply(no_docs.union(odd_docs.select("doc_id", "text")), operator.fit(no_docs, some)).first().score <= 1


def test_labels_of_held_out_rows_change_nothing(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text")
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 0]
    base = spark.createDataFrame([(1, 0), (4, 1), (6, 0), (10, 0)], "doc_id long, toxic int")
    more = base.union(spark.createDataFrame([(i, i % 2) for i in held], "doc_id long, toxic int"))
    score = lambda labels: sorted((r.doc_id or 0, r.score) for r in toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect())
    assert score(base) == score(more)


def test_buckets_do_not_depend_on_slices(monkeypatch):
    text = " ".join(f"word{i % 97} und{i % 31}" for i in range(500))
    whole = toxicity.buckets(text)
    monkeypatch.setattr(toxicity, "SLICE", 64)
    assert np.array_equal(whole, toxicity.buckets(text))
    described = quality.describe(text)
    monkeypatch.setattr(quality, "SLICE", 64)
    assert np.allclose(described, quality.describe(text))


def test_ratios_follow_the_class_counts():
    kept, ratio, evidence = toxicity.choose_buckets(np.array([[50, 1], [1, 50], [20, 20]]), np.array([100.0, 100.0]))
    assert kept.tolist() == [0, 1] and ratio[0] < 0 < ratio[1] and (evidence >= toxicity.EVIDENCE).all()
    assert ratio[1] == pytest.approx(np.log(50.5 / 101) - np.log(1.5 / 101))


def test_quality_learns_from_every_labelled_row(spark):
    ids = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 5][:4400]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    ranked = {y: [r.doc_id for r in labels.where(f"quality = {y}").selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h").collect()] for y in (0, 1)}
    late = {i for y in (0, 1) for i in ranked[y][2000:]}
    assert late

    def docs(last):
        return spark.createDataFrame([(i, last if i in late else f"word{i % 7} good text." if i % 2 else f"#{i % 5} @@") for i in ids], "doc_id long, text string")

    one, two = (quality.fit(docs(last), labels) for last in ("plain words here", "A, B, C! " * 9))
    assert any(not np.array_equal(a, b) for a, b in zip(one.edges, two.edges, strict=True))


def test_all_pairs_are_counted_by_strengths():
    draw = np.random.default_rng(3)
    strengths = [draw.integers(0, 50, 40), draw.integers(0, 50, 30)]
    held = [np.bincount(s, minlength=50) for s in strengths]
    gaps = 1 / (1 + np.exp(0.1 * np.arange(-49, 50)))
    lost = quality._against(held[0], gaps)
    assert lost[strengths[1]] == pytest.approx([sum(1 / (1 + np.exp(0.1 * (s - t))) for t in strengths[0]) for s in strengths[1]])


def test_quality_moves_no_texts(spark, odd_docs):
    """Labels meet descriptions, dealt by id at any size; what is scored are the descriptions that the model was learnt from."""
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 1), (6, 0), (7, 0), (8, 1)], "doc_id long, quality int")
    told = quality.described(odd_docs)
    plan = labelled.labelled_rows(told, labels, "quality")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "text" not in plan
    scored = quality.fit_and_score(odd_docs, labels)
    assert "text" not in scored._jdf.queryExecution().executedPlan().toString()
    expected = quality.quality(odd_docs, quality.fit(odd_docs, labels))
    assert sorted(map(str, scored.collect())) == sorted(map(str, expected.collect()))


def test_rounds_of_the_fit_shuffle_nothing(spark, monkeypatch):
    """However many partitions the rows come in, a round is a task per core at most and no shuffle."""
    from pyspark import RDD

    shuffled, fitted, dealt, fit = [], [], RDD.partitionBy, quality.fit_pairs

    def partition_by(self, n, *more):
        shuffled.append(n)
        return dealt(self, n, *more)

    def fit_pairs(blocks, n, edges):
        fitted.append(blocks.getNumPartitions())
        return fit(blocks, n, edges)

    monkeypatch.setattr(RDD, "partitionBy", partition_by)
    monkeypatch.setattr(quality, "fit_pairs", fit_pairs)
    monkeypatch.setattr(quality, "ROUNDS", 5)
    labels = spark.range(1, 400).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    docs = labels.selectExpr("doc_id", "repeat(if(quality = 1, 'A good text. ', 'bad|| '), cast(doc_id % 7 + 1 as int)) as text")
    told = quality.described(docs)
    with monkeypatch.context() as patch:
        patch.setattr(quality, "labelled_rows", lambda *of, found=quality.labelled_rows: found(*of).repartition(40))
        patch.setattr(quality, "materialize", lambda df: df)
        patch.setattr(quality, "release", lambda *of: None)
        many = quality.fit_described(told, labels)
    assert fitted == [min(40, spark.sparkContext.defaultParallelism)] and len(shuffled) <= 2
    few = quality.fit_described(told, labels)
    assert (many.cut, many.slope) == (few.cut, few.slope) and all(np.array_equal(a, b) for a, b in zip(many.weights, few.weights, strict=True))
