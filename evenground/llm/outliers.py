"""Quality rules: counts of a text with fixed limits, and robust multivariate outliers among the texts of its language and source.

A text's counts become seven numbers (``TRANSFORMED``: logarithms of sizes, square roots of shares), on a lattice of 1/1024. For every language
and source the minimum covariance determinant is sought among the different vectors of the texts that pass the limits: from two starts
(mean and covariance of all; medians and quartiles), each step takes the half nearest by Mahalanobis distance and its mean and
covariance, until nothing changes. The start of smaller determinant wins, its covariance is made consistent and reweighted once, and texts
farther than a quantile of the chi-square distribution are rejected.

A step is one aggregate over all vectors: moments by group, start and distance bin (64 to a doubling), partial in every task; a group's
bins, some thousand at most, are then added up from the nearest on until half of the group is in. Sums are of integers, so the
estimates don't depend on the partitions. Every covariance has ``FLOOR`` added on its diagonal: what a share or a length may differ by
without being evidence, also where half of a group has none of it at all, or a group has few texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, exp, gamma, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenground.llm.common import whole_texts
from evenground.runtime import materialize, release

#: Limits of the base rule: words at least, and percent of words in repeated windows at most; words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: What the vector holds, and the standard deviation that counts as no evidence in each.
TRANSFORMED = ("log_words", "log_word_length", "root_symbols", "root_capitals", "root_digits", "root_dup_lines", "root_repeats")
FLOOR = (1.2, 0.25, 0.12, 0.12, 0.12, 0.2, 0.25)
D, LATTICE = len(TRANSFORMED), 1024
#: Distance bins to a doubling; concentration steps at most; shares of the chi-square distribution for reweighting and for the verdict.
BINS, STEPS, REWEIGHT, KEEP = 64, 8, 0.975, 1 - 1e-4
#: States of groups (some 400 bytes each) that are broadcast at most; parts that a group's rows are dealt to beyond that.
FEW_STATES, SALTS = 20_000, 64
_GROUP = ["lang", "source"]
_BLANK, _INNER, _SYMBOLS = b" \t\n\x0b\x0c\r", bytes(range(0x80, 0xC0)), b"#*$%&|<>"
_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in windows of eight that the text has twice or more."""
    n = len(words)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    size = 1
    while size < WINDOW:  # number the runs of twice as many words; different runs have different numbers
        if len(ids) <= size or ids.max() + 1 == len(ids):
            return 0
        ids = np.unique(ids[:-size] * (ids.max() + 1) + ids[size:], return_inverse=True)[1]
        size *= 2
    start = np.flatnonzero(np.bincount(ids)[ids] > 1)
    covered = np.zeros(n + 1, np.int64)
    covered[start] += 1
    covered[start + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


def describe(text: bytes) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a UTF-8 text, then its vector on the lattice."""
    words = text.split()  # bytes: exactly \\x20 and \\x09-\\x0D
    n = len(words)
    chars = len(text.translate(None, _BLANK + _INNER))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    doubled = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    capitals, digits = len(text.translate(None, _NOT_CAPITAL)), len(text.translate(None, _NOT_DIGIT))
    m, c = max(1, n), max(1, chars)
    shown = (log2(1 + n), log2(1 + chars / m), sqrt(symbols / m), sqrt(capitals / c), sqrt(digits / c), sqrt(doubled / max(1, len(lines))), sqrt(repeats / m))
    return n, chars, symbols, doubled, repeats, *(round(v * LATTICE) for v in shown)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_Z = [f"z{i}" for i in range(D)]


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source`` (NULL: empty), the counts, ``base_failed`` and the vector z0 to z6 of every row of ``docs``."""
    names = ["doc_id", *_GROUP, *_COUNTS, *_Z]
    schema = ", ".join(["doc_id long, lang string, source string", *(f"{c} long" for c in (*_COUNTS, *_Z))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = np.array([describe(t or b"") for t in batch.column(3).to_pylist()], np.int64).reshape(-1, len(_COUNTS) + D)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c) for c in np.ascontiguousarray(told.T))], names)

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _GROUP]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *named, F.encode("text", "UTF-8").alias("t"))
    failed = F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words")
    return rows.mapInArrow(scan, schema).withColumn("base_failed", failed)


def chi_square(x: float, k: int) -> float:
    """The share of the chi-square distribution with odd ``k`` degrees of freedom under ``x``."""
    return erf(sqrt(x / 2)) - sum((x / 2) ** (j / 2) * exp(-x / 2) / gamma(j / 2 + 1) for j in range(1, k, 2))


def chi_square_quantile(share: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        low, high = ((low + high) / 2, high) if chi_square((low + high) / 2, k) < share else (low, (low + high) / 2)
    return high


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal vectors is to be multiplied by."""
    return 1.0 if share >= 1 else share / chi_square(chi_square_quantile(share, D), D + 2)


def _told(rows: DataFrame, states: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group's ``states``: broadcast if these are few, else by group and salt, so that no group is in one task."""
    if states.count() <= FEW_STATES:
        return rows.join(F.broadcast(states), _GROUP, how)
    salted = states.withColumn("_salt", F.explode(F.lit(list(range(SALTS)))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*_Z), F.lit(SALTS))).join(salted, [*_GROUP, "_salt"], how).drop("_salt")


def _distance() -> Column:
    """Squared Mahalanobis distance of a row's vector from ``mean`` by ``inverse`` (the upper triangle, row by row)."""
    off = [F.col(z) / LATTICE - F.element_at("mean", i + 1) for i, z in enumerate(_Z)]
    cells = [(i, j) for i in range(D) for j in range(i, D)]
    return sum(((1.0 if i == j else 2.0) * F.element_at("inverse", k + 1) * off[i] * off[j] for k, (i, j) in enumerate(cells)), F.lit(0.0))


_MOMENTS = [*_Z, *(f"z{i}z{j}" for i in range(D) for j in range(i, D))]
_STATE = "lang string, source string, start int, mean array<double>, inverse array<double>, log_det double, n long, used long"


def _moments() -> list[Column]:
    first = [F.sum(z).alias(z) for z in _Z]
    return [F.count("*").alias("n"), *first, *(F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"z{i}z{j}") for i in range(D) for j in range(i, D))]


def _state(group: pd.DataFrame, sums: np.ndarray, used: int, factor: float) -> pd.DataFrame:
    """The row of ``_STATE`` that the moments ``sums`` of ``used`` vectors give."""
    mean = sums[:D] / used / LATTICE
    square = np.zeros((D, D))
    square[np.triu_indices(D)] = sums[D:] / used / LATTICE**2
    square = np.triu(square) + np.triu(square, 1).T - np.outer(mean, mean)
    covariance = factor * square + np.diag(np.square(FLOOR))
    inverse = np.linalg.inv(covariance)[np.triu_indices(D)]
    first = group.iloc[0]
    row = (first["lang"], first["source"], first["start"], mean, inverse, np.linalg.slogdet(covariance)[1], int(group["n"].sum()), used)
    return pd.DataFrame([row], columns=[c.split()[0] for c in _STATE.split(", ")])


def _concentrate(group: pd.DataFrame) -> pd.DataFrame:
    """Of a group's bins the nearest ones that hold half of it."""
    group = group.sort_values("bin")
    n = int(group["n"].sum())
    half = min(n, (n + D + 1) // 2)
    near = group.iloc[: int(np.searchsorted(group["n"].cumsum().to_numpy(), half)) + 1]
    used = int(near["n"].sum())
    return _state(group, near[_MOMENTS].to_numpy(np.float64).sum(axis=0), used, consistency(used / n))


def _reweigh(group: pd.DataFrame) -> pd.DataFrame:
    return _state(group, group[_MOMENTS].to_numpy(np.float64).sum(axis=0), int(group["n"].sum()), consistency(REWEIGHT))


def _starts(vectors: DataFrame) -> DataFrame:
    """Start 0: mean and covariance of all vectors of a group; start 1: medians, and squared quartile ranges on the diagonal."""
    whole = vectors.groupBy(*_GROUP).agg(*_moments()).withColumn("start", F.lit(0)).groupBy(*_GROUP).applyInPandas(lambda g: _state(g, g[_MOMENTS].to_numpy(np.float64).sum(axis=0), int(g["n"].sum()), 1.0), _STATE)
    # lattice values are few, so a group's percentiles hold counts of some thousand values
    quartiles = vectors.groupBy(*_GROUP).agg(F.count("*").alias("n"), *[F.percentile(z, F.lit([0.25, 0.5, 0.75])).alias(z) for z in _Z])
    middle = F.array(*[F.col(z)[1] / LATTICE for z in _Z])
    spread = [F.pow((F.col(z)[2] - F.col(z)[0]) / (1.349 * LATTICE), F.lit(2.0)) + f * f for z, f in zip(_Z, FLOOR, strict=True)]
    inverse = F.array(*[1 / spread[i] if i == j else F.lit(0.0) for i in range(D) for j in range(i, D)])
    det = sum((F.ln(s) for s in spread), F.lit(0.0))
    robust = quartiles.select(*_GROUP, F.lit(1).alias("start"), middle.alias("mean"), inverse.alias("inverse"), det.alias("log_det"), "n", F.col("n").alias("used"))
    return whole.unionByName(robust)


def estimates(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """``lang``, ``source``, ``mean``, ``inverse`` of every group of ``vectors`` (lang, source, z0 to z6; different ones), stored."""
    spot = F.when(F.col("d2") > 0, F.greatest(F.lit(-12 * BINS), F.least(F.lit(24 * BINS), F.floor(BINS * F.log2("d2"))))).otherwise(F.lit(-12 * BINS)).cast("int")
    state = materialize(_starts(vectors))
    for _ in range(steps):
        measured = _told(vectors, state.select(*_GROUP, "start", "mean", "inverse")).withColumn("d2", _distance())
        bins = measured.groupBy(*_GROUP, "start", spot.alias("bin")).agg(*_moments())
        old, state = state, materialize(bins.groupBy(*_GROUP, "start").applyInPandas(_concentrate, _STATE))
        moved = state.join(old.select(*_GROUP, "start", F.col("log_det").alias("was"), F.col("used").alias("had")), [*_GROUP, "start"]).where("used <> had or abs(log_det - was) > 1e-9")
        done = moved.isEmpty()
        release(old)
        if done:
            break
    best = state.groupBy(*_GROUP).agg(F.min(F.struct("log_det", "start", "mean", "inverse")).alias("s")).select(*_GROUP, "s.start", "s.mean", "s.inverse")
    best = materialize(best)
    near = _told(vectors, best).where(_distance() <= chi_square_quantile(REWEIGHT, D))
    weighed = near.groupBy(*_GROUP, "start").agg(*_moments()).groupBy(*_GROUP).applyInPandas(_reweigh, _STATE)
    done = materialize(weighed.select(*_GROUP, "mean", "inverse"))
    release(state, best)
    return done


def judge(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed``, ``kept``, ``distance`` for every row of ``docs`` (doc_id, text, lang, source).

    NULL texts have no words and fail the base rule, as empty ones do; NULL language and source count as empty ones; a NULL doc_id stays;
    repeated rows give repeated rows and count once in the estimates, as texts of equal vectors do; an empty table gives an empty
    table; other columns are not read. ``distance`` is NULL where no text of the language and source passes the base rule.
    """
    whole_texts(docs.sparkSession)
    told = materialize(statistics(docs))
    vectors = materialize(told.where("not base_failed").select(*_GROUP, *_Z).distinct())
    found = estimates(vectors)
    release(vectors)
    judged = _told(told, found, "left").withColumn("distance", F.sqrt(_distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= sqrt(chi_square_quantile(keep, D)), F.lit(False))
    return judged.select("doc_id", *_COUNTS, "base_failed", kept.alias("kept"), "distance")
