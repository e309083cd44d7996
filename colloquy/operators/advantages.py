"""Group-relative advantages: DataFrame in, DataFrame with the new column out.

Group statistics are windows over the group's key. Global moments are a one-row aggregate
crossed with the rows, never a window without partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.folds import scan
from colloquy.functions.numeric import EPS, masked_mean

Estimator = Callable[..., DataFrame]
_ESTIMATORS: dict[str, Estimator] = {}


def register_estimator(name: str) -> Callable[[Estimator], Estimator]:
    """Advantage estimators by name; a name taken by another function is an error."""

    def put(f: Estimator) -> Estimator:
        if _ESTIMATORS.setdefault(name, f) is not f:
            raise ValueError(f"estimator {name!r} is registered already")
        return f

    return put


def estimator(name: str) -> Estimator:
    if name not in _ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}; known: {sorted(_ESTIMATORS)}")
    return _ESTIMATORS[name]


def with_global(df: DataFrame, **aggs: Column) -> DataFrame:
    """df with one-row aggregates of itself as columns."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(k) for k, c in aggs.items()))))


def whiten_weighted(df: DataFrame, value: str, weight: str, out: str) -> DataFrame:
    """Whitening over tokens done a row at a time: a row stands for ``weight`` tokens of one value."""
    d = with_global(df, _n=F.sum(weight), _m=F.sum(F.col(value) * F.col(weight)) / (F.sum(weight) + F.lit(1e-8)))
    d = d.crossJoin(F.broadcast(d.agg((F.sum(F.col(weight) * F.pow(F.col(value) - F.col("_m"), 2)) / (F.sum(weight) + F.lit(1e-8)) * F.sum(weight) / (F.sum(weight) - 1)).alias("_v"))))
    return d.withColumn(out, (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + F.lit(1e-8))).drop("_n", "_m", "_v")


@register_estimator("grpo")
def grpo(df: DataFrame, group: str = "uid", score: str = "score", norm: bool = True, eps: float = EPS) -> DataFrame:
    """(s - mean) / (sample std + eps) in the group; a group of one has mean 0 and std 1."""
    w = Window.partitionBy(group)
    n, mean = F.count("*").over(w), F.avg(score).over(w)
    centred = F.when(n == 1, F.col(score)).otherwise(F.col(score) - mean)
    std = F.when(n == 1, F.lit(1.0)).otherwise(F.stddev_samp(score).over(w))
    return df.withColumn("advantage", centred / (std + eps) if norm else centred)


@register_estimator("passk")
def passk(df: DataFrame, group: str = "uid", score: str = "score", tie: str = "sample_id", norm: bool = True, eps: float = EPS) -> DataFrame:
    """The best row gets best minus second best (over std); the others 0. Groups of one have no rows here; see :func:`too_small`."""
    w = Window.partitionBy(group)
    order = w.orderBy(F.desc(score), tie)
    gap = F.col(score) - F.lead(score).over(order)
    d = df.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(order), "_gap": gap, "_std": F.stddev_samp(score).over(w)}).where("_n > 1")
    value = F.col("_gap") / (F.col("_std") + eps) if norm else F.col("_gap")
    return d.withColumn("advantage", F.when(F.col("_k") == 1, value).otherwise(F.lit(0.0))).drop("_n", "_k", "_gap", "_std")


def too_small(df: DataFrame, group: str = "uid", least: int = 2) -> DataFrame:
    """Groups with fewer rows than an estimator needs."""
    return df.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") < least)


@register_estimator("reinforce_pp_baseline")
def reinforce_pp_baseline(df: DataFrame, group: str = "uid", score: str = "score", length: str = "resp_len") -> DataFrame:
    """Group-centred score, whitened over all tokens."""
    w = Window.partitionBy(group)
    d = df.withColumn("_c", F.when(F.count("*").over(w) == 1, F.col(score)).otherwise(F.col(score) - F.avg(score).over(w)))
    return whiten_weighted(d, "_c", length, "advantage").drop("_c")


@register_estimator("rloo")
def rloo(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    """n / (n - 1) * (s - mean); a group of one keeps s."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    return df.withColumn("advantage", F.when(n == 1, F.col(score)).otherwise(n / F.nullif(n - 1, F.lit(0)) * (F.col(score) - F.avg(score).over(w))))


@register_estimator("opo")
def opo(df: DataFrame, group: str = "uid", score: str = "score", length: str = "resp_len") -> DataFrame:
    """Score minus the length-weighted mean; a group of one has baseline 0."""
    w = Window.partitionBy(group)
    base = F.sum(F.col(score) * F.col(length)).over(w) / F.sum(length).over(w)
    return df.withColumn("advantage", F.col(score) - F.when(F.count("*").over(w) == 1, F.lit(0.0)).otherwise(base))


@register_estimator("gpg")
def gpg(df: DataFrame, group: str = "uid", score: str = "score", f_norm: float = 1.0) -> DataFrame:
    """(rows / rows with a score) * (s - mean) / f_norm; a group of one has mean 0."""
    w = Window.partitionBy(group)
    d = with_global(df, _a=F.count("*") / F.greatest(F.count_if(F.col(score) != 0), F.lit(1)))
    mean = F.when(F.count("*").over(w) == 1, F.lit(0.0)).otherwise(F.avg(score).over(w))
    return d.withColumn("advantage", F.col("_a") * (F.col(score) - mean) / f_norm).drop("_a")


@register_estimator("remax")
def remax(tokens: DataFrame, row: str = "sample_id", pos: str = "pos", reward: str = "reward", mask: str = "mask", baseline: str = "baseline") -> DataFrame:
    """Reverse cumulative reward minus the row's baseline, on unmasked tokens; one row a token."""
    back = Window.partitionBy(row).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    d = tokens.withColumn("returns", F.sum(F.col(reward) * F.col(mask)).over(back))
    return d.withColumn("advantage", F.col("returns") - F.col(baseline) * F.col(mask))


def _backwards(rows: Column, zero: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """:func:`scan` from right to left, the values in the array's own order."""
    return F.reverse(scan(F.reverse(rows), zero, step, "double"))


@register_estimator("reinforce_pp")
def reinforce_pp(arrays: DataFrame, gamma: float = 1.0) -> DataFrame:
    """arrays(reward, mask): returns array; a token with mask 0 resets the running return after it."""

    def step(a: Column, x: Column) -> tuple[dict[str, Column], Column]:
        g = x["reward"] + gamma * a["run"]
        return {"run": g * x["mask"]}, g

    return arrays.withColumn("returns", _backwards(F.arrays_zip("reward", "mask"), {"run": F.lit(0.0)}, step))


@register_estimator("gae")
def gae(arrays: DataFrame, gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    """arrays(reward, value, mask): advantage and returns arrays before whitening. Masked tokens carry the next valid state and show its advantage."""

    def step(a: Column, x: Column) -> tuple[dict[str, Column], Column]:
        on = x["mask"] > 0
        g = F.when(on, x["reward"] + gamma * a["nv"] - x["value"] + gamma * lam * a["g"]).otherwise(a["g"])
        return {"nv": F.when(on, x["value"]).otherwise(a["nv"]), "g": g}, g

    d = arrays.withColumn("advantage", _backwards(F.arrays_zip("reward", "value", "mask"), {"nv": F.lit(0.0), "g": F.lit(0.0)}, step))
    return d.withColumn("returns", F.zip_with("advantage", "value", lambda a, v: a + v))


@register_estimator("prime_rloo")
def prime_rloo(tokens: DataFrame, dense: float = 5.0, outcome: float = 5.0, group: str = "uid", seq: str = "sample_id") -> DataFrame:
    """tokens(uid, sample_id, pos, mask, reward, acc): returns and advantage from two reward sources, one a token and one (acc) at a sequence's last valid token.

    Each source is centred leave-one-out: n / (n - 1) * r minus the sum of the group's sequence
    means over n - 1, on its own tokens; a group of one keeps r. The weighted sum is accumulated
    from the end and whitened.
    """
    per = tokens.groupBy(group, seq).agg(masked_mean(F.col("reward"), F.col("mask")).alias("_mean"), F.max("acc").alias("_acc"), F.max(F.when(F.col("mask") != 0, F.col("pos"))).alias("_last"))
    w = Window.partitionBy(group)
    per = per.withColumns({"_n": F.count("*").over(w), "_dense": F.sum("_mean").over(w), "_outcome": F.sum("_acc").over(w)})
    d = tokens.join(per, [group, seq])
    n = F.col("_n")
    centred = lambda r, total: F.when(n == 1, r).otherwise(r * n / F.nullif(n - 1, F.lit(0)) - total / F.nullif(n - 1, F.lit(0)))
    reward = F.when(F.col("mask") != 0, dense * centred(F.col("reward"), F.col("_dense"))).otherwise(F.lit(0.0))
    reward = reward + F.when(F.col("pos") == F.col("_last"), outcome * centred(F.col("_acc"), F.col("_outcome"))).otherwise(F.lit(0.0))
    back = Window.partitionBy(seq).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("returns", F.sum(reward).over(back)).drop("_mean", "_acc", "_last", "_n", "_dense", "_outcome")
    return whiten_weighted(d, "returns", "mask", "advantage")


TERMINAL = ("diagnose", "answer", "final_answer")


@register_estimator("turn")
def turn_advantage(turns: DataFrame, alpha: float = 0.5, terminal_coef: float = 1.2, eps: float = EPS, norm: bool = True, group: str = "uid", position: str = "turn_id") -> DataFrame:
    """turns(uid, episode_id, turn_id, action, reward, outcome) -> turn_advantage.

    Ask turns are normalised among the same turn of a group's episodes, outcomes among the
    group's episodes; groups of one give 0, and so does a group with one episode.
    """
    ask = ~F.col("action").isin(*TERMINAL)
    by_turn = Window.partitionBy(group, position, ask)
    n = F.count("*").over(by_turn)
    centred = F.col("reward") - F.avg("reward").over(by_turn)
    a_turn = F.when(ask & (n > 1), centred / (F.stddev_samp("reward").over(by_turn) + eps) if norm else centred).otherwise(F.lit(0.0))
    episodes = turns.groupBy(group, "episode_id").agg(F.max("outcome").alias("outcome"))
    by_group = Window.partitionBy(group)
    m = F.count("*").over(by_group)
    c2 = F.col("outcome") - F.avg("outcome").over(by_group)
    a_diag = F.when(m > 1, c2 / (F.stddev_samp("outcome").over(by_group) + eps) if norm else c2).otherwise(F.lit(0.0))
    episodes = episodes.select(group, "episode_id", a_diag.alias("_diag"), (m == 1).alias("_single"))
    d = turns.withColumn("_turn", a_turn).join(episodes, [group, "episode_id"])
    value = F.when(F.col("_single"), F.lit(0.0)).when(ask, F.col("_diag") + alpha * F.col("_turn")).otherwise(terminal_coef * F.col("_diag"))
    return d.withColumn("turn_advantage", value).drop("_turn", "_diag", "_single")


def turn_or_outcome(rows: DataFrame, **params: float) -> DataFrame:
    """:func:`turn_advantage` where rows have turns, else :func:`grpo` over the outcomes, as a log without turns has one row a response."""
    if "turn_id" in rows.columns and "action" in rows.columns:
        return turn_advantage(rows, **params)
    return grpo(rows, score="outcome", norm=bool(params.get("norm", True))).withColumnRenamed("advantage", "turn_advantage")


def softmean(beta: float, x: Column) -> Column:
    """Aggregate: ln(mean(exp(beta * x))) / beta, the mean for beta 0. Needs exp(beta * x) in range; see :func:`softmean_by` for the stable form."""
    return F.avg(x) if beta == 0 else F.ln(F.avg(F.exp(F.lit(beta) * x))) / beta


def softmean_by(df: DataFrame, group: str, x: str, beta: float) -> DataFrame:
    """group, softmean, with the group's largest value taken out before the exponential."""
    w = Window.partitionBy(group)
    d = df.select(group, F.col(x).alias("_x"), F.max(x).over(w).alias("_top"))
    return d.groupBy(group).agg(F.avg("_x").alias("softmean") if beta == 0 else (F.ln(F.avg(F.exp(beta * (F.col("_x") - F.col("_top"))))) / beta + F.first("_top")).alias("softmean"))
