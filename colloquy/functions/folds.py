"""Left folds over arrays that give a value for each element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values gather in blocks of this many, so that a long array isn't copied for each element.
BLOCK = 128


def scan(rows: Column, zero: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]], kind: str) -> Column:
    """array<kind> of what step(state, x) -> (new state, value) gives along ``rows``; the state is a struct with the names of ``zero``."""
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    start = F.struct(*(c.alias(k) for k, c in zero.items()), none.alias("_run"), nones.alias("_out"))

    def one(a: Column, x: Column) -> Column:
        new, value = step(a, x)
        run = F.concat(a["_run"], F.array(value))
        full = F.size(a["_run"]) >= BLOCK - 1
        return F.struct(
            *(c.alias(k) for k, c in new.items()),
            F.when(full, none).otherwise(run).alias("_run"),
            F.when(full, F.concat(a["_out"], F.array(run))).otherwise(a["_out"]).alias("_out"),
        )

    return F.aggregate(rows, start, one, lambda a: F.concat(F.flatten(a["_out"]), a["_run"]))
