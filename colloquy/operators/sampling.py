"""Filtering, resampling and balancing of groups of rollouts."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.numeric import hash_key
from colloquy.operators.datasets import ranges, ranked, running_total
from colloquy.sources.cache import cut


def informative(df: DataFrame, group: str = "uid", metric: str = "score") -> DataFrame:
    """Rows of groups whose metric varies, and of groups of one."""
    w = Window.partitionBy(group)
    d = df.withColumns({"_s": F.stddev_pop(metric).over(w), "_n": F.count("*").over(w)})
    return d.where("_s > 0 OR _n = 1").drop("_s", "_n")


def band_sample(df: DataFrame, group: str, acc: str, length: str, low: float, high: float, max_len: int, oversample: float) -> DataFrame:
    """The first 1/oversample of the groups, those with mean accuracy in the band and no truncated row first."""
    g = df.groupBy(group).agg(F.avg(acc).alias("_a"), F.max(length).alias("_l"))
    ok = F.col("_a").between(low, high) & (F.col("_l") < max_len - 1)
    r = ranked(g.withColumn("_ok", (~ok).cast("int")), [F.col("_ok"), F.col(group)], "_k").crossJoin(F.broadcast(g.agg(F.floor(F.count("*") / oversample).alias("_n"))))
    return df.join(r.where("_k < _n").select(group), group, "left_semi")


def weights(df: DataFrame, method: str, power: float = 2.0, value: str = "score") -> DataFrame:
    """df with weight: |score|^power (pow), 1 at the largest or smallest score else 0 (max_min), the same with 0.4 elsewhere (max_random)."""
    v = F.col(value)
    if method == "pow":
        return df.withColumn("weight", F.pow(F.abs(v), F.lit(power)))
    g = F.broadcast(df.agg(F.max(value).alias("_hi"), F.min(value).alias("_lo")))
    d = df.crossJoin(g)
    if method == "max_min":
        c = F.when((v == F.col("_hi")) | (v == F.col("_lo")), 1.0).otherwise(0.0)
    elif method == "max_random":
        c = F.when(v == F.col("_hi"), 1.0).otherwise(0.4)
    else:
        raise ValueError(f"unknown method {method!r}")
    return d.withColumn("weight", c).drop("_hi", "_lo")


def resample(df: DataFrame, key: str, weight: str, n: int, seed: str) -> DataFrame:
    """n draws with replacement by weight: draw, and the columns of df. Rows without a positive weight are not drawn.

    Rows own intervals of the cumulative weight, draws are points by hash, and a draw finds the row
    whose interval begins last before it: both are dealt into ranges of that line together, each
    range is sorted, and the last interval before a draw is carried along; a range begins with
    the last interval of those before it (one row a range). So however many draws and rows there are,
    each is looked at once, and a row that holds half of the weight has its draws spread over ranges.
    """
    heavy = df.where(F.col(weight) > 0)
    total = F.broadcast(heavy.agg(F.sum(weight).alias("_t")))
    rows = running_total(heavy, [F.col(key)], F.col(weight), "_hi").crossJoin(total)
    row = F.struct(*df.columns)
    begin = rows.select(((F.col("_hi") - F.col(weight)) / F.col("_t")).alias("_at"), F.lit(None).cast("long").alias("draw"), row.alias("_row"))
    u = F.conv(F.substring(hash_key(seed, "draw"), 1, 12), 16, 10).cast("double") / float(1 << 48)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw")).select(u.alias("_at"), "draw", F.lit(None).cast(begin.schema["_row"].dataType).alias("_row"))
    # an interval that begins at a draw's very point holds it: nulls, which rows have, sort first
    d = ranges(begin.unionByName(draws), [F.col("_at"), F.col("draw")])
    ends = d.where("_row IS NOT NULL").groupBy("__p").agg(F.max_by("_row", "_at").alias("_own"))
    parts = d.select("__p").distinct().join(F.broadcast(ends), "__p", "left")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.broadcast(parts.select("__p", F.last("_own", ignorenulls=True).over(before).alias("_carried")))
    last = F.last("_row", ignorenulls=True).over(Window.partitionBy("__p").orderBy("_at", "draw").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_last", last).where("draw IS NOT NULL").join(carried, "__p").withColumn("_row", F.coalesce("_last", "_carried"))
    return d.where("_row IS NOT NULL").select("draw", *(F.col("_row")[c].alias(c) for c in df.columns))


def karmarkar_karp(counts: list[tuple[int, int]], k: int, equal: bool) -> dict[int, list[int]]:
    """The part of each row that is left of every length once whole rounds of k rows are dealt, from (length, rows).

    Rows of one length are interchangeable, and k of them change no part's place against another. What is left is
    fewer than k rows of a length: they, or for ``equal`` k neighbours in order of length (the count of all must divide),
    are a first set of k sums. The two sets whose spread is largest are joined, the largest sum of one with
    the smallest of the other, until one set is left; its spread is no more than the largest at first.
    """
    odd = [(length, n % k) for length, n in sorted(counts)]
    if equal and sum(n for _, n in odd) % k:
        raise ValueError("equal parts need a count that k divides")
    if equal:
        rows = [length for length, n in odd for _ in range(n)]
        first = [rows[at : at + k] for at in range(0, len(rows), k)]
    else:
        first = [[length] * n for length, n in odd if n]
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    for tick, lengths in enumerate(first):
        sets = sorted([(x, [x]) for x in lengths] + [(0, [])] * (k - len(lengths)), key=lambda s: -s[0])
        heap.append((sets[-1][0] - sets[0][0], tick, sets))
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda s: -s[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], tick, both))
        tick += 1
    out: dict[int, list[int]] = {}
    for part, (_, lengths) in enumerate(heap[0][2] if heap else []):
        for x in lengths:
            out.setdefault(x, []).append(part)
    return out


#: Rows of the table of lengths that is broadcast; beyond it the table is joined.
BROADCAST_LENGTHS = 1 << 20


def _dealt(d: DataFrame, plan: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """step, row, length, part of d(step, row, length).

    The plan of a step is made from its lengths and their counts (``step``, ``length``, ``n``), so a group is as
    large as the number of distinct lengths, whatever the number of rows: it adds the number of parts ``k``
    and the parts of the rows of each length that are left after whole rounds of k (``parts``).
    Rows take their part by their exact rank among those of their length.
    """
    got = cut(ranked(d, [F.col("step"), F.col("length"), F.col("row")], "_r"))
    counts = got.groupBy("step", "length").agg(F.count("*").alias("n"), F.min("_r").alias("first"))
    plans = cut(counts.groupBy("step").applyInPandas(plan, "step long, length long, n long, first long, k int, parts array<int>"))
    side = F.broadcast(plans) if plans.count() <= BROADCAST_LENGTHS else plans.hint("merge")
    at = F.col("_r") - F.col("first")
    whole = F.floor(F.col("n") / F.col("k")) * F.col("k")
    part = F.when(at < whole, at % F.col("k")).otherwise(F.get("parts", (at - whole).cast("int")))
    return got.join(side, ["step", "length"]).select("step", "row", "length", part.cast("int").alias("part"))


def _three(df: DataFrame, step: str | None, row: str, length: str) -> DataFrame:
    return df.select((F.lit(0) if step is None else F.col(step)).cast("long").alias("step"), F.col(row).cast("long").alias("row"), F.col(length).cast("long").alias("length"))


def balanced(df: DataFrame, step: str | None, row: str, length: str, k: int, equal: bool = False) -> DataFrame:
    """step, row, part: each step's rows (without a step, the whole table's, as step 0) in k parts whose length sums differ by the longest row at most; ``equal``: with the same count of rows.

    Rows need a length and an id that is one within the step.
    """

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = karmarkar_karp(list(zip(pdf["length"].tolist(), pdf["n"].tolist(), strict=True)), k, equal)
        return pdf.assign(k=k, parts=[parts.get(x, []) for x in pdf["length"].tolist()])

    return _dealt(_three(df, step, row, length), plan).select("step", "row", "part")


def serpentine(df: DataFrame, length: str, key: str, k: int) -> DataFrame:
    """A whole table in k parts: longest first, dealt forth and back. Cheaper than :func:`balanced`, and close to it."""
    d = ranked(df, [F.desc(length), F.col(key)], "_r")
    turn = F.floor(F.col("_r") / k) % 2
    return d.withColumn("part", F.when(turn == 0, F.col("_r") % k).otherwise(k - 1 - F.col("_r") % k).cast("int")).drop("_r")


def micro_batches(df: DataFrame, step: str, row: str, length: str, budget: int, least: int = 1, divisor: int = 1) -> DataFrame:
    """step, row, batch, place: as few batches a step as the budget allows (at least ``least``, a multiple of ``divisor``), of about equal sums, heaviest (by squared lengths) first.

    place is the row's position when the batches are laid end to end, which restores the step's order. A batch
    has as many rows as its budget of tokens holds; a step may have any number.
    """

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths, counts = pdf["length"].tolist(), pdf["n"].tolist()
        if max(lengths) > budget:
            raise ValueError(f"a row of length {max(lengths)} exceeds the budget of {budget}")
        k = max(least, -(-sum(x * n for x, n in zip(lengths, counts, strict=True)) // budget))
        k = min(sum(counts), -(-k // divisor) * divisor)
        parts = karmarkar_karp(list(zip(lengths, counts, strict=True)), k, False)
        work = [0] * k  # beyond what whole rounds give to every part
        for x, own in parts.items():
            for p in own:
                work[p] += x * x
        batch = {p: i for i, p in enumerate(sorted(range(k), key=lambda p: (-work[p], p)))}
        return pdf.assign(k=k, parts=[[batch[p] for p in parts.get(x, [])] for x in lengths])

    d = cut(_dealt(_three(df, step, row, length), plan).select("step", "row", F.col("part").alias("batch")))
    size = d.groupBy("step", "batch").agg(F.count("*").alias("_n"))
    start = size.select("step", "batch", (F.sum("_n").over(Window.partitionBy("step").orderBy("batch")) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("step", "batch").orderBy("row")) - 1
    return d.hint("merge").join(start, ["step", "batch"]).select("step", "row", "batch", (F.col("_start") + inside).cast("int").alias("place"))


def epoch_order(df: DataFrame, key: str, epochs: int, seed: str, batch: int, by: list[Column] | None = None) -> DataFrame:
    """epoch, batch, place and the rows: in another hash order each epoch, or in the same order ``by`` (the key for sequential, a difficulty for curriculum)."""
    d = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("_h", hash_key(seed, "epoch", key))
    n = F.broadcast(df.agg(F.count("*").alias("_n")))
    r = ranked(d, [F.col("epoch"), *(by or [F.col("_h")]), F.col(key)], "_r").crossJoin(n)
    return r.withColumn("place", F.col("_r") - F.col("epoch") * F.col("_n")).withColumn("batch", F.floor(F.col("place") / batch)).drop("_h", "_r", "_n")
