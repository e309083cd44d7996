"""Numeric conventions as Column builders. Keep the sample and the population forms apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

EPS = 1e-6


#: Added before rounding, here and in the SQL: decimal inputs give exact ties, which the order of summation would decide.
NUDGE = 1e-10


def rounded(c: Column | str, digits: int) -> Column:
    """Rounded for output; adding zero turns -0.0 into 0.0."""
    return F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, digits) + F.lit(0.0)


def r6(c: Column | str) -> Column:
    return rounded(c, 6)


def r4(c: Column | str) -> Column:
    return rounded(c, 4)


def over(c: Column, w: WindowSpec | None) -> Column:
    return c.over(w) if w is not None else c


def hash_key(seed: str, *cols: Column | str) -> Column:
    """md5 of seed and key: a reproducible random order that no partitioning changes."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols)))


def masked_mean(x: Column, mask: Column) -> Column:
    """Aggregate: sum(x * mask) / (sum(mask) + 1e-8); values outside the mask may be NaN."""
    return F.sum(F.when(mask != 0, x * mask).otherwise(F.lit(0.0))) / (F.sum(mask) + F.lit(1e-8))
