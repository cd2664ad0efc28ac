"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the different n-grams (4 to 6 code points, lower case, white space as one blank) it holds, hashed to
2^20 buckets. On a bounded sample of labelled rows the log ratio of the buckets' smoothed document frequencies among
toxic and other texts is taken; the buckets whose class counts tell the classes apart stay; logistic regression is fitted on the ratios of
the buckets a text holds, rows weighted so that the sample has the class shares of all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenground.llm.common import whole_texts
from evenground.llm.labelled import held_out, training_rows
from evenground.runtime import materialize

BUCKET_BITS = 20
SIZES = (4, 5, 6)
#: Log-likelihood ratio (G squared, one degree of freedom) that a bucket's class counts must reach.
EVIDENCE = 15.0
ROUNDS = 200
RIDGE = 1e-3
#: Code points that are hashed at once; longer texts go slice by slice.
SLICE = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str) -> np.ndarray:
    """The different buckets of a text's n-grams, sorted; of an empty text none."""
    text = f" {' '.join(text.lower().split())} "
    if len(text) < 4:
        return np.zeros(0, np.uint32)
    found = []
    for low in range(0, len(text), SLICE):
        codes = np.frombuffer(text[low : low + SLICE + max(SIZES) - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        rolled = codes
        for size in range(2, max(SIZES) + 1):
            if len(rolled) < 2:
                break
            rolled = (rolled[:-1] * _MULTIPLIER) ^ codes[size - 1 :]
            if size in SIZES:
                mixed = rolled * _MULTIPLIER
                found.append(((mixed ^ mixed >> np.uint64(29)) * _MULTIPLIER >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class NaiveBayesLinear:
    """Buckets with the weight of each (ratio times coefficient) and the intercept."""

    kept: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, texts: pd.Series) -> np.ndarray:
        table = np.zeros(1 << BUCKET_BITS, np.float32)
        table[self.kept] = self.weights
        sums = np.array([table[buckets(t or "")].sum(dtype=np.float64) for t in texts])
        return 1 / (1 + np.exp(-np.clip(sums + self.intercept, -30, 30)))

    def column(self, text: str = "text") -> Column:
        """The score, 0 to 1, of a text column; NULL counts as empty."""

        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(self.scores(part))

        # the type hints are strings here, so the kind of function is named
        score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(score, "double")(F.col(text))


def choose_buckets(held: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in ``held``, their log-count ratios, evidence) of the buckets that tell the classes apart.

    ``held``: (buckets, 2), how many texts of either label hold each bucket; ``n``: texts of either label.
    """
    held = held.astype(float)
    evidence = np.zeros(len(held))
    for cells in (held, n - held):
        expected = cells.sum(axis=1, keepdims=True) * (n / n.sum())
        evidence += 2 * (cells * np.log(np.maximum(cells, 1) / np.maximum(expected, 1e-9))).sum(axis=1)
    kept = np.flatnonzero(evidence >= EVIDENCE)
    ratio = np.log((held[kept, 1] + 0.5) / (n[1] + 1)) - np.log((held[kept, 0] + 0.5) / (n[0] + 1))
    return kept, ratio, evidence[kept]


def fit_coefficients(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, sizes: dict[int, int]) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of the weighted, ridged logistic regression, by Adam from 0.

    ``rows``: per text the positions in ``ratio`` of the buckets that it holds; ``sizes``: rows of each label in all.
    """
    columns = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(p) for p in rows])
    weight = np.array([sizes[c] / sum(sizes.values()) / max(1, (y == c).sum()) for c in (0, 1)])[y]
    values = ratio[columns]
    coefficient, intercept = np.zeros(len(ratio)), float(np.log(sizes[1] / sizes[0]))
    mean, square = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for step in range(1, ROUNDS + 1):
        sums = np.bincount(owner, values * coefficient[columns], len(rows)) + intercept
        error = weight * (1 / (1 + np.exp(-np.clip(sums, -30, 30))) - y)
        gradient = np.append(np.bincount(columns, values * error[owner], len(ratio)) + RIDGE * coefficient, error.sum())
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = 0.02 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        coefficient -= move[:-1]
        intercept -= move[-1]
    return coefficient, float(intercept)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> NaiveBayesLinear:
    """The model learnt from ``labels`` (doc_id, ``label``) and the texts of ``docs`` (doc_id, text).

    The sample's texts are stored once; how many of them hold each bucket is counted where they lie, and only the buckets with
    enough evidence, then each text's positions among those, come to the driver. Without rows of both labels every text gets
    the smoothed share of label 1.
    """
    whole_texts(docs.sparkSession)
    drawn, sizes = training_rows(docs, labels, label)
    rows = materialize(drawn)
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
        return NaiveBayesLinear(np.zeros(0, np.uint32), np.zeros(0, np.float32), float(np.log(share / (1 - share))))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((1 << BUCKET_BITS, 2), np.int32)
        for part in parts:
            for y, text in zip(part["y"], part["text"], strict=True):
                held[buckets(text), y] += 1
        found = np.flatnonzero(held.sum(axis=1))
        yield pd.DataFrame({"bucket": found, "n0": held[found, 0], "n1": held[found, 1]})

    counted = rows.mapInPandas(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    totals = np.array([n[0], n[1]], float)
    few = counted.where(_evidence(F.col("n0"), F.col("n1"), *totals) >= EVIDENCE)
    found = np.array(few.collect(), np.int64).reshape(-1, 3)  # buckets are 2^BUCKET_BITS at most
    found = found[np.argsort(found[:, 0])]
    kept, ratio, _ = choose_buckets(found[:, 1:], totals)
    chosen = found[kept, 0].astype(np.uint32)

    def positions(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            at = [np.flatnonzero(np.isin(chosen, buckets(t))).astype(np.int32).tobytes() for t in part["text"]]
            yield pd.DataFrame({"y": part["y"], "b": at})

    told = sorted((r["y"], bytes(r["b"])) for r in rows.mapInPandas(positions, "y int, b binary").collect())
    coefficient, intercept = fit_coefficients([np.frombuffer(b, np.int32) for _, b in told], np.array([y for y, _ in told], np.int64), ratio, sizes)
    return NaiveBayesLinear(chosen, (ratio * coefficient).astype(np.float32), intercept)


def _evidence(n0: Column, n1: Column, all0: float, all1: float) -> Column:
    """choose_buckets' evidence as a column."""
    part = lambda cell, both, share: cell * F.log(F.greatest(cell, F.lit(1)) / F.greatest(both * share, F.lit(1e-9)))
    share = (all0 / (all0 + all1), all1 / (all0 + all1))
    out0, out1 = F.lit(all0) - n0, F.lit(all1) - n1
    return 2 * (part(n0, n0 + n1, share[0]) + part(n1, n0 + n1, share[1]) + part(out0, out0 + out1, share[0]) + part(out1, out0 + out1, share[1]))


def toxicity(docs: DataFrame, model: NaiveBayesLinear, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs`` (doc_id, text).

    NULL texts count as empty and get the intercept's score; a NULL doc_id stays, with held_out false; repeated rows get equal
    scores; an empty table gives an empty table; other columns are not read.
    """
    whole_texts(docs.sparkSession)
    scored = docs.select("doc_id", held_out().alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
