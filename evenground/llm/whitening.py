"""Whitening of embeddings by the eigenvectors of their covariance, found by cyclic Jacobi rotations.

Vectors are taken on a lattice of 1/256. Every different one counts once: tasks sum these exactly, then their products centred on the
mean, and one matrix of the vectors' length reaches the driver. There symmetric rotations run over all pairs of dimensions (half as
many disjoint pairs at a time as there are dimensions) until each off-diagonal entry vanishes against the two diagonal ones, which
keeps small eigenvalues accurate. The largest components, scaled to unit variance, go to the tasks again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenground.runtime import materialize, release

STEPS, COMPONENTS = 256, 4
#: Entries of this size and more have no exact place on the lattice; a rotation's sweeps; what vanishes against the diagonal.
LARGEST, SWEEPS, VANISHED = 2.0**44, 60, 1e-16


def lattice(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``x`` (floor(256 c) of every entry c) of the rows whose vector is there and has finite entries alone."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False))
    entries = F.transform(F.col(vector), lambda c: c.cast("double"))
    kept = rows.select(F.col(id_column).cast("long").alias("vec_id"), entries.alias("c")).where(F.col("c").isNotNull() & F.forall("c", finite))
    return kept.select("vec_id", F.transform("c", lambda c: F.floor(c * STEPS).cast("long")).alias("x"))


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with the sums ``s``; ``vectors`` (d, k): unit eigenvectors by falling ``values``; ``trace`` of the covariance."""

    n: int
    s: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Which components have any variance, for double precision."""
        return self.values > len(self.s) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, whose whole part is taken off exactly."""
        whole = [v // self.n for v in self.s]
        return (x - np.array(whole, np.int64)) - np.array([(v - w * self.n) / self.n for v, w in zip(self.s, whole, strict=True)])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(rows, k); components without variance are NaN."""
        return self.centred(x) @ (self.vectors / np.sqrt(np.where(self.usable, self.values, np.nan)))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - s)^2 over the dimensions, exactly."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.s), default=0)
        kind = np.int64 if len(self.s) * most**2 < 1 << 63 else object
        y = self.n * x.astype(kind) - np.array(self.s, kind)
        return (y * y).sum(axis=1).tolist()


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of dimensions as rounds of disjoint pairs (p < q), as in a tournament."""
    seats = list(range(d + d % 2))
    rounds = []
    for _ in range(len(seats) - 1):
        pairs = [sorted((a, b)) for a, b in zip(seats[: len(seats) // 2], reversed(seats[len(seats) // 2 :]), strict=True) if max(a, b) < d]
        rounds.append((np.array([p for p, _ in pairs], np.int64), np.array([q for _, q in pairs], np.int64)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return rounds


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, by falling eigenvalue."""
    a, v = np.array(matrix, float), np.eye(len(matrix))
    rounds = _rounds(len(a))
    least = np.finfo(float).tiny + VANISHED**2 * np.abs(a).max(initial=0.0)
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds:
            off, diagonal = a[p, q], np.diag(a)
            far = np.abs(off) > np.maximum(VANISHED * np.sqrt(np.abs(diagonal[p] * diagonal[q])), least)
            if not far.any():
                continue
            turned = True
            p, q, off = p[far], q[far], off[far]
            theta = (a[q, q] - a[p, p]) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            new_p, new_q = a[p, p] - t * off, a[q, q] + t * off
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[:, p], a[:, q] = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
            v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
            a[p, p], a[q, q], a[p, q], a[q, p] = new_p, new_q, 0.0, 0.0
        if not turned:
            order = np.argsort(-np.diag(a), kind="stable")
            return np.diag(a)[order], v[:, order]
    raise ArithmeticError("rotations don't converge")


def _sums(fitted: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors there are, and their exact sums."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            x = _vectors(batch.column(0), d)
            n += len(x)
            high, low = (x >> 26).sum(axis=0).tolist(), (x & (1 << 26) - 1).sum(axis=0).tolist()
            sums = [s + (h << 26) + w for s, h, w in zip(sums, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(38))], ["i", "v"])

    rows = fitted.select("x").mapInArrow(scan, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()
    found = {r["i"]: int(r["v"]) for r in rows}
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def _products(fitted: DataFrame, d: int, k: int, shown) -> np.ndarray:
    """Sum over the vectors x of z z^T, z being the ``k`` numbers that ``shown`` gives for x; a row of the matrix is added up in one task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            z = shown(_vectors(batch.column(0), d))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def added(table: pa.Table) -> pa.Table:
        parts = np.sort(np.array(table["row"].to_pylist()).reshape(-1, k), axis=0)  # in an order that doesn't depend on arrival
        return pa.table({"i": table["i"][:1], "row": pa.array([parts.sum(axis=0)], pa.list_(pa.float64()))})

    rows = fitted.select("x").mapInArrow(scan, "i int, row array<double>").groupBy("i").applyInArrow(added, "i int, row array<double>").collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])]).reshape(-1, k)


def fit(fitted: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of the column ``x`` (different vectors of length ``d``) of ``fitted``, which is read twice."""
    n, s = _sums(fitted, d)
    mean = Whitening(n, s, np.zeros(0), np.zeros((d, 0)), 0.0)
    covariance = _products(fitted, d, d, mean.centred) / n
    values, vectors = jacobi((covariance + covariance.T) / 2)
    return Whitening(n, s, np.maximum(values[:components], 0.0), vectors[:, :components], float(np.trace(covariance)))


def identity_error(fitted: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the covariance of the whitened vectors less the identity; None without a component that has variance."""
    used = model.usable
    k = int(used.sum())
    if not k:
        return None
    # a first column of ones gives the sums beside the products
    both = _products(fitted, len(model.s), k + 1, lambda x: np.concatenate([np.ones((len(x), 1)), model.whitened(x)[:, used]], axis=1)) / model.n
    return float(np.abs(both[1:, 1:] - np.outer(both[0, 1:], both[0, 1:]) - np.eye(k)).max())


_SHOWN = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


def project(rows: DataFrame, d: int, model: Whitening) -> DataFrame:
    """Every row of ``rows`` (vec_id, x) once per component."""
    k = len(model.values)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
        for batch in batches:
            x = _vectors(batch.column(1), d)
            m = len(x)
            deviations = pa.array([Decimal(v) if v < 10**38 else None for v in model.deviations(x)], pa.decimal128(38))
            each = np.repeat(np.arange(m), k)
            z = model.whitened(x).ravel()
            columns = [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviations.take(pa.array(each))]
            columns += [pa.array(z, mask=np.isnan(z)), pa.array(e := np.tile(explained, m), mask=np.isnan(e))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SHOWN.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(scan, _SHOWN)


def whiten(rows: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` for every row and component up to ``components``.

    Rows whose vector is NULL or has NULL, non-finite or enormous (2^44 and more) entries are left out; a NULL id stays; repeated rows give
    repeated rows and count once in the fit, as equal vectors do. Vectors of different lengths are fitted apart; those of length 0 have no
    component and so no row. Components without variance (one vector, or fewer directions than components) have whitened NULL, and
    explained NULL where nothing varies at all. ``deviation`` is a decimal of 38 digits,
    NULL beyond that. An empty table gives an empty table; other columns are not read.
    """
    placed = lattice(rows, id_column, vector)
    out = None
    for d in sorted(r["d"] for r in placed.select(F.size("x").alias("d")).distinct().collect() if r["d"]):
        own = placed.where(F.size("x") == d)
        fitted = materialize(own.select("x").distinct())
        model = fit(fitted, d, components)
        error = identity_error(fitted, model)
        release(fitted)
        shown = project(own, d, model).withColumn("identity_error", F.lit(error).cast("double"))
        out = shown if out is None else out.unionByName(shown)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"{_SHOWN}, identity_error double")
    return out
