"""Places of regular-expression matches, with SQL functions alone.

Spark has no function for the offsets of all matches. But the matches and the text
between them (``split`` by the same pattern) take turns, so running sums of their
lengths are the offsets, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Running sums are taken in blocks of this many, so that no long array is copied for each match.
BLOCK = 64

_NONE = "array<struct<start:int,end:int,value:string,part:string>>"


def matches(text: Column, pattern: str, when: Column, part: int = 0) -> Column:
    """array<struct<start, end, value, part>> of all leftmost non-overlapping matches; empty unless ``when``.

    ``part`` is a group of the pattern whose text is wanted too.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(part))
    gaps = F.transform(F.split(text, pattern), F.length)
    rows = F.filter(
        F.transform(F.arrays_zip(found.alias("m"), gaps.alias("g"), parts.alias("p")), lambda x: F.struct(x["m"].alias("m"), x["g"].alias("g"), x["p"].alias("p"))),
        lambda x: x["m"].isNotNull(),
    )
    empty = F.lit(None).cast(_NONE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("run"), F.array().cast(f"array<{_NONE}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["g"]
        e = s + F.length(x["m"])
        run = F.concat(a["run"], F.array(F.struct(s.alias("start"), e.alias("end"), x["m"].alias("value"), x["p"].alias("part"))))
        full = F.size(a["run"]) >= BLOCK - 1
        return F.struct(
            e.alias("at"),
            F.when(full, F.array().cast(_NONE)).otherwise(run).alias("run"),
            F.when(full, F.concat(a["out"], F.array(run))).otherwise(a["out"]).alias("out"),
        )

    got = F.aggregate(rows, start, step, lambda a: F.concat(F.flatten(a["out"]), a["run"]))
    return F.coalesce(F.when(when, got).otherwise(empty), F.array().cast(_NONE))


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans as array<struct<start, ord, kind, end, value>>, which sorts by start, then by kind as listed."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, by start and then kind as listed."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlaps(s: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
