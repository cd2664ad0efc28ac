"""Column helpers for missing values, sums and divisions as statisticians expect them (NaN is missing, x / 0 is infinite)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOATS = ("double", "float")


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN as NULL."""
    column = F.col(f"`{name}`")
    return F.nanvl(column, F.lit(None).cast("double")) if dict(df.dtypes)[name] in FLOATS else column


def total(column: Column, na_rm: bool) -> Column:
    """Sum aggregate. ``na_rm``: missing values are left out and the sum of none is 0; else one missing value makes it NULL."""
    if na_rm:
        return F.coalesce(F.sum(column), F.lit(0))
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def divide(a: Column, b: Column) -> Column:
    """a / b in doubles: x / 0 is infinite by the sign of x, 0 / 0 is NaN, NULL stays NULL; never raises."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a == 0, F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b != 0, a / b).when(b == 0, by_zero)


def strict_max(*columns: Column) -> Column:
    """The largest value across columns; NULL if one is NULL."""
    return F.when(reduce(lambda x, y: x & y, [c.isNotNull() for c in columns]), F.greatest(*columns) if len(columns) > 1 else columns[0])


def strict_min(*columns: Column) -> Column:
    """The smallest value across columns; NULL if one is NULL."""
    return F.when(reduce(lambda x, y: x & y, [c.isNotNull() for c in columns]), F.least(*columns) if len(columns) > 1 else columns[0])


def log(column: Column) -> Column:
    """Natural logarithm; of 0 negative infinity, of less NaN."""
    return F.when(column > 0, F.ln(column)).when(column == 0, F.lit(float("-inf"))).when(column < 0, F.lit(float("nan")))


def natural_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, missing equal to missing, with each key once (from the side that has the row), ``left``'s columns first."""
    theirs = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(theirs)
    match = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(r)) for k, r in theirs.items()])
    joined = left.join(right, match, how)
    from_both = how in ("full", "right")
    shown = [F.coalesce(F.col(f"`{c}`"), F.col(theirs[c])).alias(c) if from_both and c in theirs else F.col(f"`{c}`") for c in left.columns]
    return joined.select(*shown, *[f"`{c}`" for c in right.columns if c not in theirs.values()])


def annual_rate(change: Column, years: float) -> Column:
    """Geometric yearly rate of a relative change: sign(x) (exp(log(1 + |x|) / years) - 1)."""
    return F.signum(change) * (F.exp(F.log1p(F.abs(change)) / years) - 1)
