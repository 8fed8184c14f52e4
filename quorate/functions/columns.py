"""Column expressions shared by the operators.  All of them stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def elements(array: str | Column, size: int) -> list[Column]:
    """The first ``size`` entries of an array column, NULL where the array is shorter."""
    col = F.col(array) if isinstance(array, str) else array
    return [F.get(col, F.lit(i)) for i in range(size)]


def stored(cols: list[Column]) -> Column:
    """An array the planner keeps as one computed column instead of copying its entries into every later use."""
    return F.slice(F.array(*cols), F.lit(1), F.lit(len(cols)))


def add(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def count_present(cols: list[Column]) -> Column:
    return add([F.when(c.isNotNull(), 1).otherwise(0) for c in cols])


def sum_present(cols: list[Column]) -> Column:
    return add([F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])


def ratio(num: Column, den: Column, otherwise: float | None = 0.0) -> Column:
    """``num / den`` with a fixed value where the denominator is zero."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(otherwise).cast("double"))


def mean_present(cols: list[Column]) -> Column:
    """Mean over the non-NULL entries, NULL when there are none."""
    return ratio(sum_present(cols), count_present(cols), None)


def spread_present(cols: list[Column], mean: Column) -> Column:
    """Population standard deviation over the non-NULL entries around an already computed ``mean``."""
    squares = [F.when(c.isNotNull(), (c - mean) * (c - mean)).otherwise(F.lit(0.0)) for c in cols]
    return F.sqrt(ratio(add(squares), count_present(cols), None))


def least_present(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.least(*cols)


def greatest_present(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def positive(cond: Column) -> Column:
    """Counts rows where ``cond`` holds (NULL counts as no)."""
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def exceeds(score: Column, thr: float | Column, inclusive: bool = False) -> Column:
    """Threshold decision as 0/1; ``inclusive`` picks ``>=`` over ``>``."""
    thr = thr if isinstance(thr, Column) else F.lit(float(thr))
    return (score >= thr if inclusive else score > thr).cast("int")


def seeded_order(key: Column, seed: int) -> Column:
    """Portable pseudo-random sort key: hex md5 of ``key:seed``."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))


def binary_entropy(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-8)), F.lit(1 - 1e-8))
    return -q * F.log2(q) - (F.lit(1.0) - q) * F.log2(F.lit(1.0) - q)


def finite(col: Column, value: float | None = 0.0) -> Column:
    """Replace NaN and both infinities."""
    bad = F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
    return F.when(bad, F.lit(value).cast("double")).otherwise(col)
