"""Evaluation metrics over logged rollouts: long tables instead of nested dictionaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.numeric import hash_key
from colloquy.operators.datasets import ranked_within
from colloquy.operators.sampling import balanced
from colloquy.sources.cache import cut


def long(df: DataFrame, keys: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Columns other than keys as rows (metric, value)."""
    cols = [c for c in df.columns if c not in keys]
    return df.unpivot(keys, [F.col(c).cast("double").alias(c) for c in cols], name, value)


def sizes(n: Column) -> Column:
    """2, 4, 8, ... below n, and n; nothing for n = 1."""
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.pow(F.lit(2.0), i).cast("long")), lambda p: p < n)
    return F.when(n > 1, F.concat(powers, F.array(n))).otherwise(F.array().cast("array<bigint>"))


#: Rows of groups with resampled votes that one task takes; their draws are some four times as many.
TASK_ROWS = 100_000


def group_metrics(rows: DataFrame, keys: list[str], value: str, order: str, pred: str | None = None, draws: int = 0, seed: str = "42", only: tuple[str, ...] = ("mean", "std", "best", "worst", "maj")) -> DataFrame:
    """keys, metric, value for each group: mean@N, and for N > 1 std@N (population), best@n and worst@n, mean and std, of n draws with replacement.

    The largest of n draws from v1 <= ... <= vN is v_i with probability (i/N)^n - ((i-1)/N)^n,
    so no draws are made. maj@N is the value of the first row of the commonest ``pred`` (ties
    to the pred seen first); with ``draws`` there is maj@n for n below N too (:func:`resampled_majority`).
    ``only``: the kinds of metric that are made.
    """
    d = rows.select(*keys, F.col(value).cast("double").alias("_v"), F.col(order).alias("_o"), *([F.col(pred).alias("_p")] if pred else []))
    if draws and pred and "maj" in only:  # a task's groups stay few, however many there are
        d = cut(d)
        d = d.repartition(max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-d.count() // TASK_ROWS)), *keys)
    at = lambda name, n, tail="": F.concat(F.lit(f"{name}@"), n.cast("string"), F.lit(tail))
    out = []
    if {"mean", "std"} & set(only):
        base = d.groupBy(*keys).agg(F.avg("_v").alias("m"), F.stddev_pop("_v").alias("s"), F.count("*").alias("n"))
        two = F.array(F.struct(at("mean", F.col("n")).alias("metric"), F.col("m").alias("value")), F.struct(F.when(F.col("n") > 1, at("std", F.col("n"))).alias("metric"), F.col("s").alias("value")))
        out.append(base.select(*keys, F.explode(two).alias("x")).select(*keys, "x.metric", "x.value").where("metric IS NOT NULL"))
    if {"best", "worst"} & set(only):
        w = Window.partitionBy(*keys)
        e = d.withColumns({"_i": F.row_number().over(w.orderBy("_v", "_o")), "_n": F.count("*").over(w)})
        # every row meets the few sizes of its group
        e = e.withColumn("k", F.explode(sizes(F.col("_n"))))
        i, n, k = F.col("_i"), F.col("_n"), F.col("k")
        best = F.pow(i / n, k) - F.pow((i - 1) / n, k)
        worst = F.pow((n - i + 1) / n, k) - F.pow((n - i) / n, k)
        e = e.withColumns({"pb": best, "pw": worst})
        mom = e.groupBy(*keys, "k").agg(*(F.sum(F.col(p) * F.pow("_v", F.lit(q))).alias(f"{p}{q}") for p in ("pb", "pw") for q in (1, 2)))
        std = lambda p: F.sqrt(F.greatest(F.col(f"{p}2") - F.col(f"{p}1") * F.col(f"{p}1"), F.lit(0.0)))
        four = F.array(*(F.struct(at(nm, F.col("k"), t).alias("metric"), c.alias("value")) for nm, p in (("best", "pb"), ("worst", "pw")) for t, c in (("/mean", F.col(f"{p}1")), ("/std", std(p)))))
        out.append(mom.select(*keys, F.explode(four).alias("x")).select(*keys, "x.metric", "x.value"))
    if pred and "maj" in only:
        votes = d.groupBy(*keys, "_p").agg(F.count("*").alias("c"), F.min("_o").alias("o"), F.min_by("_v", "_o").alias("v"))
        top = votes.groupBy(*keys).agg(F.min_by("v", F.struct(-F.col("c"), F.col("o"))).alias("value"), F.sum("c").alias("_n")).where("_n > 1")
        out.append(top.select(*keys, at("maj", F.col("_n"), "/mean").alias("metric"), "value"))
        if draws:
            out.append(resampled_majority(d, keys, draws, seed))
    metrics = reduce(DataFrame.unionByName, out)
    return metrics.where(F.split_part("metric", F.lit("@"), F.lit(1)).isin(*only))


def resampled_majority(d: DataFrame, keys: list[str], draws: int, seed: str) -> DataFrame:
    """maj@n/mean and maj@n/std for n below the group's size: the value of the first row of the commonest pred among n rows drawn with replacement, over ``draws`` such samples.

    A draw is a hash of seed, group, sample and place, so that no partitioning changes it; ties go to the pred drawn first.
    Row j of a group makes draw j of each sample that has one. Draws stand behind the row that they name in the group's
    order, so d(keys, _o, _v, _p) is shuffled once, by the group, and not at all if it is dealt by group already.
    """
    at = lambda t: F.concat(F.lit("maj@"), F.col("k").cast("string"), F.lit(t))
    w = Window.partitionBy(*keys)
    rows = d.withColumns({"_r": F.row_number().over(w.orderBy("_o")), "_n": F.count("*").over(w)}).where("_n > 2")
    made = F.filter(sizes(F.col("_n")), lambda k: (k < F.col("_n")) & (k >= F.col("_r")))
    own = F.array(F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).alias("b")))
    samples = F.flatten(F.transform(made, lambda k: F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda b: F.struct(k.alias("k"), b.alias("b")))))
    e = rows.select(*keys, "_v", "_p", "_r", "_n", (F.col("_r") - 1).cast("long").alias("j"), F.inline(F.concat(own, samples)))
    h = F.conv(F.substring(hash_key(seed, *keys, "k", "b", "j"), 1, 8), 16, 10).cast("long")
    is_row = F.col("k") == 0
    e = e.select(*keys, "k", "b", "j", F.when(is_row, F.col("_r")).otherwise((h % F.col("_n") + 1).cast("int")).alias("_r"), F.when(is_row, F.struct("_v", "_p")).alias("_x"))
    named = w.orderBy("_r", "k").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("_x", F.last("_x", ignorenulls=True).over(named)).where("k > 0").select(*keys, "k", "b", "j", "_x._v", "_x._p")
    votes = e.groupBy(*keys, "k", "b", "_p").agg(F.count("*").alias("c"), F.min("j").alias("j"), F.min_by("_v", "j").alias("v"))
    # most votes, then first drawn, in one number: both are below a group's rows, which row_number counts in 32 bits
    rank = (F.col("k") - F.col("c")) * F.lit(1 << 32) + F.col("j")
    won = votes.groupBy(*keys, "k", "b").agg(F.min_by("v", rank).alias("v"))
    m = won.groupBy(*keys, "k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    two = F.array(F.struct(at("/mean").alias("metric"), F.col("m").alias("value")), F.struct(at("/std").alias("metric"), F.col("s").alias("value")))
    return m.select(*keys, F.explode(two).alias("x")).select(*keys, "x.metric", "x.value")


def validation(rows: DataFrame, source: str, group: str, value: str, order: str, pred: str | None = None, draws: int = 0, seed: str = "42", only: tuple[str, ...] = ("mean", "std", "best", "worst", "maj")) -> DataFrame:
    """source, metric, value: the mean of :func:`group_metrics` over a source's groups that have the metric."""
    return group_metrics(rows, [source, group], value, order, pred, draws, seed, only).groupBy(source, "metric").agg(F.avg("value").alias("value"))


def named(metrics: DataFrame, source: str, var: str = "var") -> DataFrame:
    """name, value: core metrics are mean, maj and best at the largest n of acc (else reward); the others are aux."""
    w = Window.partitionBy(source)
    has_acc = F.max((F.col(var) == "acc").cast("int")).over(w) == 1
    n = F.regexp_extract("metric", "@([0-9]+)", 1).cast("long")
    top = F.max(n).over(Window.partitionBy(source, var))
    core = (F.col(var) == F.when(has_acc, F.lit("acc")).otherwise(F.lit("reward"))) & F.col("metric").rlike("^(mean|maj|best)") & (n == top)
    return metrics.select(F.concat_ws("/", F.when(core, F.lit("val-core")).otherwise(F.lit("val-aux")), source, var, "metric").alias("name"), "value")


def reduced(metrics: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """One value a name: its maximum if the name has "max", its minimum if "min", else the mean."""
    c = F.when(F.col(name).contains("max"), F.max(value)).when(F.col(name).contains("min"), F.min(value)).otherwise(F.avg(value))
    return metrics.groupBy(name).agg(c.alias(value))


def _three(name: str, c: Column) -> list[Column]:
    return [F.avg(c).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max"), F.min(c).alias(f"{name}_min")]


def data_metrics(rows: DataFrame, max_len: int, max_prompt: int, keys: list[str]) -> DataFrame:
    """rows(score, reward, resp_len, prompt_len[, turns, tools]): mean, max, min of each; scores and rewards over rows that were not aborted (length 0), lengths over all rows and over those; clip and aborted ratios."""
    alive = F.col("resp_len") > 0
    n, q = F.col("resp_len").cast("double"), F.col("prompt_len").cast("double")
    some = [c for c in ("turns", "tools") if c in rows.columns]
    return rows.groupBy(*keys).agg(
        *_three("score", F.when(alive, F.col("score"))), *_three("reward", F.when(alive, F.col("reward"))),
        *_three("length", n), F.avg((F.col("resp_len") == max_len).cast("double")).alias("clip_ratio"),
        *_three("alive_length", F.when(alive, n)), F.avg(F.when(alive, (F.col("resp_len") == max_len).cast("double"))).alias("alive_clip_ratio"),
        F.avg((~alive).cast("double")).alias("aborted_ratio"),
        *_three("prompt", q), F.avg((F.col("prompt_len") == max_prompt).cast("double")).alias("prompt_clip_ratio"),
        *(x for c in some for x in _three(c, F.col(c).cast("double"))),
    )


def token_metrics(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """tokens(advantage, returns, value, mask): mean, max, min of each on valid tokens, and the explained variance."""
    t = tokens.where("mask = 1")
    ev = 1 - F.var_samp(F.col("returns") - F.col("value")) / (F.var_samp("returns") + F.lit(1e-5))
    return t.groupBy(*keys).agg(*(x for c in ("advantage", "returns", "value") for x in _three(c, F.col(c))), ev.alias("explained_variance"))


def preference_metrics(rows: DataFrame, pairs: DataFrame, max_len: int, max_prompt: int, key: str) -> DataFrame:
    """One row a key: rows(score, reward, resp_len, prompt_len) as they are; pairs(chosen_lp, rejected_lp, ref_chosen_lp, ref_rejected_lp): mean log-probabilities and logits, the policy's log ratio minus the reference's."""
    n, q = F.col("resp_len").cast("double"), F.col("prompt_len").cast("double")
    a = rows.groupBy(key).agg(
        *_three("score", F.col("score")), *_three("reward", F.col("reward")), *_three("length", n), F.avg((n == max_len).cast("double")).alias("clip_ratio"),
        *_three("prompt", q), F.avg((q == max_prompt).cast("double")).alias("prompt_clip_ratio"),
    )
    logit = (F.col("chosen_lp") - F.col("rejected_lp")) - (F.col("ref_chosen_lp") - F.col("ref_rejected_lp"))
    b = pairs.groupBy(key).agg(F.avg(logit).alias("logits"), F.avg("chosen_lp").alias("chosen_lp"), F.avg("rejected_lp").alias("rejected_lp"))
    return a.join(b, key, "left")


def evaluation_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """results(correct, has_final, invalid, turn_count, coverage): figures for the keys and their totals."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return results.rollup(*keys).agg(F.count("*").alias("n"), share("correct").alias("accuracy"), share("has_final").alias("answer_rate"), share("invalid").alias("invalid_rate"), share("turn_count").alias("turns"), share("coverage").alias("coverage"))


def imbalance(rows: DataFrame, step: str, order: str, length: str, k: int) -> DataFrame:
    """step; least, most, gap of the length sums of k contiguous chunks, balanced_least and balanced_most of the k parts of :func:`balanced`, and mean. order: an id that is one within the step."""
    r = ranked_within(rows.select(step, order, length), step, [F.col(order)], "_i", "_n")
    chunk = r.groupBy(step, F.floor(F.col("_i") * k / F.col("_n")).alias("_p")).agg(F.sum(length).alias("_s"))
    before = chunk.groupBy(step).agg(F.min("_s").alias("least"), F.max("_s").alias("most"), (F.max("_s") - F.min("_s")).alias("gap"), (F.sum("_s") / k).alias("mean"))
    parts = balanced(rows, step, order, length, k).select(F.col("step").alias(step), F.col("row").alias(order), "part")
    part = parts.hint("merge").join(rows.select(step, order, length), [step, order]).groupBy(step, "part").agg(F.sum(length).alias("_s"))
    # a step of fewer rows than parts leaves some empty
    after = part.groupBy(step).agg(F.when(F.count("*") < k, 0).otherwise(F.min("_s")).alias("balanced_least"), F.max("_s").alias("balanced_most"))
    return before.hint("merge").join(after, step)


def pair_accuracy(rows: DataFrame, group: str, row: str, score: str, label: str) -> DataFrame:
    """group, accuracy: over all pairs of a group's rows, the share that the score orders as the label does, weighted by the labels' gap; .5 without a gap. A pair of equal scores counts for the order of ``row``.

    Labels have few values: each row meets each label of its group once, not each row. Right pairs are
    those whose lower label stands before the higher one in the order of (score, row).
    """
    a = rows.select(group, F.col(row).alias("_i"), F.col(score).alias("_s"), F.col(label).alias("_l"))
    each = a.groupBy(group, F.col("_l").alias("_m")).agg(F.count("*").alias("_c"))
    d = a.hint("merge").join(each, group)
    before = F.count_if(F.col("_l") == F.col("_m")).over(Window.partitionBy(group, "_m").orderBy("_s", "_i").rowsBetween(Window.unboundedPreceding, 0))
    gap = F.greatest(F.col("_l") - F.col("_m"), F.lit(0.0))
    t = d.withColumns({"_ok": gap * before, "_all": gap * F.col("_c")}).groupBy(group).agg(F.sum("_ok").alias("_ok"), F.sum("_all").alias("_all"))
    return t.select(group, F.when(F.col("_all") == 0, 0.5).otherwise(F.col("_ok") / F.nullif(F.col("_all"), F.lit(0.0))).alias("accuracy"))
