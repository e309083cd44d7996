"""Building training sets: splits, mixes, samples, reshaping. Every random choice is an order by a hash of a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.numeric import hash_key
from colloquy.sources.cache import cut, discard


def group_split(rows: DataFrame, group: str, key: str, quotas: dict[str, int], seed: str) -> DataFrame:
    """rows with split: whole groups in hash order go to each part in turn until it has its quota, then parts are cut to it. No group is shared.

    Rows get their exact place in that order side by side; a part takes the places from where
    the last one's groups end, so only the ends come to the driver, one number a part.
    """
    d = cut(ranked(rows.withColumn("_o", hash_key(seed, group)), [F.col("_o"), F.col(group), F.col(key)], "_r"))
    g = cut(d.groupBy(group).agg(F.min("_r").alias("_first"), F.max("_r").alias("_last")))
    begin, split = 0, F.lit(None).cast("string")
    for name, quota in quotas.items():
        split = F.when((F.col("_r") >= begin) & (F.col("_r") < begin + quota), F.lit(name)).otherwise(split)
        last = g.where((F.col("_first") >= begin) & (F.col("_first") < begin + quota)).agg(F.max("_last")).first()[0]
        begin = begin if last is None else last + 1
    discard(g)
    return d.withColumn("split", split).where("split IS NOT NULL").select(*rows.columns, "split")


def initial_symptoms(edges: DataFrame, seed_n: str = "3", seed: str = "4") -> DataFrame:
    """The heaviest symptom of a disease and 0 to 2 more, by hash, of its heavier half."""
    w = Window.partitionBy("disease")
    d = edges.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("weight"), "symptom")), "_n": F.count("*").over(w)})
    d = d.withColumn("_x", F.conv(F.substring(hash_key(seed_n, "disease"), 1, 4), 16, 10).cast("int") % 3).where(F.col("_r") <= F.greatest(F.lit(2), F.floor(F.col("_n") / 2)))
    k = F.row_number().over(Window.partitionBy("disease", F.col("_r") == 1).orderBy(hash_key(seed, "disease", "symptom")))
    return d.withColumn("_k", k).where((F.col("_r") == 1) | (F.col("_k") <= F.col("_x"))).drop("_r", "_n", "_x", "_k")


def ranges(df: DataFrame, order: list[Column], n: int | None = None) -> DataFrame:
    """df dealt in n ranges of the order (as many as a shuffle has partitions), numbered in __p, and written: what is counted and what is shifted by the counts must be the same rows, even after a lost executor."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))


def _before(d: DataFrame, total: Column) -> DataFrame:
    """__p, __b: the total of all ranges before one; as many rows as there are ranges, so a window without partitions and a broadcast are bounded."""
    n = d.groupBy("__p").agg(total.alias("__n"))
    return F.broadcast(n.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b")))


def ranked(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Exact rank from 0 without one task holding all rows: ranges are sorted side by side, then shifted by the counts before them."""
    d = ranges(df, order)
    r = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return d.withColumn("__r", r).join(_before(d, F.count("*")), "__p").withColumn(out, (F.col("__b") + F.col("__r") - 1).cast("long")).drop("__p", "__r", "__b")


def ranked_within(df: DataFrame, group: str, order: list[Column], out: str = "rank", size: str = "size") -> DataFrame:
    """Exact rank from 0 within the group and the group's size; a group that has a share of all rows is sorted in ranges like any other."""
    r = cut(ranked(df, [F.col(group), *order], "__g"))
    first = cut(r.groupBy(group).agg(F.min("__g").alias("__f"), F.count("*").alias(size)))
    few = first.count() <= GATHER  # few groups are large ones: merged, each would be one task's
    return (r.join(F.broadcast(first), group) if few else r.hint("merge").join(first, group)).withColumn(out, F.col("__g") - F.col("__f")).drop("__g", "__f")


def running_total(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """The sum of value over the rows up to and with each, in order, in the way of :func:`ranked`."""
    d = ranges(df.withColumn("__v", value), order)
    inner = F.sum("__v").over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("__r", inner).join(_before(d, F.sum("__v")), "__p").withColumn(out, F.col("__b") + F.col("__r")).drop("__p", "__r", "__b", "__v")


def ratio_split(df: DataFrame, key: str, ratio: float, seed: str, least: int = 1) -> DataFrame:
    """split train or val: floor(n * ratio) rows, at least ``least``, in hash order."""
    n = F.broadcast(df.agg(F.greatest(F.floor(F.count("*") * ratio), F.lit(least)).alias("_v")))
    return ranked(df.withColumn("_h", hash_key(seed, key)), [F.col("_h"), F.col(key)], "_rank").crossJoin(n).withColumn("split", F.when(F.col("_rank") < F.col("_v"), "val").otherwise("train")).drop("_h", "_rank", "_v")


#: Rows that one task may gather; the first n of more are found by ranges.
GATHER = 1 << 16


def first_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in an order that has no ties.

    A few are the best of each task's best. Of more, rows are dealt into ranges of the order and counted, a number a
    range; whole ranges are taken as they are, and only the range in which the n-th row lies is ranked, so no
    task holds n rows.
    """
    if n <= GATHER:
        return df.orderBy(*order).limit(n)
    d = ranges(df, order)
    left, whole, open_ = n, -1, None
    for r in d.groupBy("__p").count().orderBy("__p").collect():  # as many rows as ranges
        if left < r["count"]:
            open_ = r["__p"]
            break
        left, whole = left - r["count"], r["__p"]
    out = d.where(F.col("__p") <= whole).drop("__p")
    if open_ is None or not left:
        return out
    part = ranked(d.where(F.col("__p") == open_).drop("__p"), order, "__k").where(F.col("__k") < left).drop("__k")
    return out.unionByName(part)


def sample_n(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows by hash."""
    return first_n(df.withColumn("_h", hash_key(seed, key)), [F.col("_h"), F.col(key)], n).drop("_h")


def fill_sample(first: DataFrame, spare: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows by hash from ``first``, the gap filled from ``spare``."""
    both = first.withColumn("_f", F.lit(0)).unionByName(spare.withColumn("_f", F.lit(1)))
    return first_n(both.withColumn("_h", hash_key(seed, key)), [F.col("_f"), F.col("_h"), F.col(key)], n).drop("_h", "_f")


def mix(parts: list[tuple[DataFrame, float]], key: str, seed: str) -> DataFrame:
    """round(frac * n) rows of each source by hash, together; null strings become empty."""
    out = []
    for i, (df, frac) in enumerate(parts):
        n = F.broadcast(df.agg(F.bround(F.count("*") * frac).alias("_v")))
        d = ranked(df.withColumn("_h", hash_key(f"{seed}{i}", key)), [F.col("_h"), F.col(key)], "_rank").crossJoin(n).where(F.col("_rank") < F.col("_v")).drop("_h", "_rank", "_v")
        out.append(d)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out).fillna("")


def repeat(df: DataFrame, n: int | Column, row_id: str, interleave: bool = True) -> DataFrame:
    """Rows n times with new ids: each row's copies together, or whole passes after each other."""
    k = F.lit(n) if isinstance(n, int) else n
    d = df.withColumn("copy", F.explode(F.sequence(F.lit(0), k - 1)))
    if not isinstance(n, int):
        return d
    if interleave:
        return d.withColumn(row_id, F.col(row_id) * n + F.col("copy"))
    total = F.broadcast(df.agg(F.count("*").alias("_n")))
    return d.crossJoin(total).withColumn(row_id, F.col(row_id) + F.col("copy") * F.col("_n")).drop("_n")


def pad_to(df: DataFrame, divisor: int, row_id: str) -> DataFrame:
    """df and its first rows again until the count divides; is_pad marks those."""
    n = df.agg(F.count("*").alias("_n"))
    pad = (F.lit(divisor) - F.col("_n") % divisor) % divisor
    extra = df.crossJoin(F.broadcast(n)).where(F.col(row_id) < pad).withColumn(row_id, F.col(row_id) + F.col("_n")).drop("_n")
    return df.withColumn("is_pad", F.lit(False)).unionByName(extra.withColumn("is_pad", F.lit(True)))


def chunked(df: DataFrame, k: int, row_id: str) -> DataFrame:
    """chunk 0..k-1 of equal sizes (the count must divide)."""
    n = F.broadcast(df.agg(F.count("*").alias("_n")))
    d = df.crossJoin(n)
    ok = F.when(F.col("_n") % k == 0, F.floor(F.col(row_id) * k / F.col("_n"))).otherwise(F.raise_error(F.lit("rows do not divide into equal chunks")).cast("long"))
    return d.withColumn("chunk", ok).drop("_n")


def unfold_arrays(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Each row as n rows with consecutive slices of the array columns."""
    d = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return d.withColumns({c: F.slice(c, (F.col("chunk") * F.size(c) / n).cast("int") + 1, (F.size(c) / n).cast("int")) for c in columns})


def unite(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Columns of both by row; a shared column must agree."""
    shared = [c for c in right.columns if c in left.columns and c != row_id]
    r = right.select(row_id, *(F.col(c).alias(f"_r_{c}" if c in shared else c) for c in right.columns if c != row_id))
    d = left.join(r, row_id)
    for c in shared:
        d = d.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(left.schema[c].dataType)))
    return d.drop(*(f"_r_{c}" for c in shared))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys two splits share; a leak if not 0."""
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("n_shared"))


def canonical(df: DataFrame, prompt: Column, answer: Column, source: str, style: str, split: str, index: Column, **extra: Column) -> DataFrame:
    """The canonical training row of any source: prompt messages, reward model, source, extra info."""
    return df.select(
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("prompt"),
        F.struct(F.lit(style).alias("style"), answer.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.alias("index"), *(c.alias(k) for k, c in extra.items())).alias("extra_info"),
    )


def with_system_prompt(df: DataFrame, content: str, prompt: str = "prompt") -> DataFrame:
    """The first message's content replaced, changed telling whether it differed; a first message of another role is an error."""
    first = F.get(prompt, F.lit(0))
    ok = F.when(first["role"] == "system", F.lit(content)).otherwise(F.raise_error(F.lit("the first message is not the system's")).cast("string"))
    d = df.withColumn("changed", first["content"] != content)
    return d.withColumn(prompt, F.transform(prompt, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, ok).otherwise(m["content"]).alias("content"))))


def cases(edges: DataFrame, least: int, most: int, templates: list[str], seed: str) -> DataFrame:
    """edges(disease, disease_group, symptom, weight) -> a case a disease: its heaviest symptoms in order, and a complaint from a template by hash."""
    w = Window.partitionBy("disease").orderBy(F.desc("weight"), "symptom")
    d = edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    g = d.groupBy("disease", "disease_group").agg(F.sort_array(F.collect_list(F.struct("_r", "symptom"))).alias("x")).where(F.size("x") >= least)
    pick = F.conv(F.substring(hash_key(seed, "disease"), 1, 4), 16, 10).cast("int") % len(templates)
    pool = F.transform("x", lambda r: r["symptom"])
    return g.select("disease", "disease_group", pool.alias("pool"), F.concat(F.element_at(F.array(*map(F.lit, templates)), pick + 1), F.get(pool, F.lit(0))).alias("chief_complaint"))


def merged_map(own: Column, extra: Column) -> Column:
    """Both maps' keys; own values win."""
    return F.map_concat(own, F.map_filter(extra, lambda k, v: ~F.map_contains_key(own, k)))
