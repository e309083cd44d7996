"""Per-token statistics of logged policies: values only, no gradients. Token tables have a row for each token."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.numeric import hash_key, masked_mean
from colloquy.operators.advantages import with_global
from colloquy.operators.datasets import ranked

Diagnostics = Callable[..., DataFrame]
_DIAGNOSTICS: dict[str, Diagnostics] = {}


def register_diagnostics(name: str) -> Callable[[Diagnostics], Diagnostics]:
    """Policy diagnostics by name; a name taken by another function is an error."""

    def put(f: Diagnostics) -> Diagnostics:
        if _DIAGNOSTICS.setdefault(name, f) is not f:
            raise ValueError(f"diagnostics {name!r} are registered already")
        return f

    return put


def diagnostics(name: str) -> Diagnostics:
    if name not in _DIAGNOSTICS:
        raise ValueError(f"unknown diagnostics {name!r}; known: {sorted(_DIAGNOSTICS)}")
    return _DIAGNOSTICS[name]


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def kl(kind: str, lp: Column, ref: Column) -> Column:
    """KL estimate of a token: k1 (kl), abs, k2 (mse), k3 (low_var_kl, clamped)."""
    if kind in ("kl", "k1"):
        return lp - ref
    if kind == "abs":
        return F.abs(lp - ref)
    if kind in ("mse", "k2"):
        return 0.5 * F.pow(lp - ref, 2)
    if kind in ("low_var_kl", "k3"):
        d = clamp(ref - lp, -20, 20)
        return clamp(F.exp(d) - d - 1, -10, 10)
    raise ValueError(f"unknown KL estimate {kind!r}")


def aggregate_loss(tokens: DataFrame, value: Column, mode: str, seq: str = "sample_id", mask: str = "mask", length: int | None = None) -> DataFrame:
    """One row, loss: token-mean, seq-mean-token-sum, seq-mean-token-mean or seq-mean-token-sum-norm (over ``length``, the padded one)."""
    m = F.col(mask)
    if mode == "token-mean":
        return tokens.agg(masked_mean(value, m).alias("loss"))
    by_seq = tokens.groupBy(seq).agg(F.sum(value * m).alias("s"), F.sum(m).alias("n"), F.count("*").alias("len"))
    if mode == "seq-mean-token-sum":
        return by_seq.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return by_seq.agg(F.avg(F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return by_seq.agg((F.sum("s") / (F.lit(length) if length else F.max("len"))).alias("loss"))
    raise ValueError(f"unknown mode {mode!r}")


@register_diagnostics("vanilla")
def policy(tokens: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """loss, clip_fraction, approx_kl, lower_clip_fraction of tokens(old_lp, new_lp, advantage, mask)."""
    a, m = F.col("advantage"), F.col("mask")
    d = clamp(F.col("new_lp") - F.col("old_lp"), -20, 20)
    ratio = F.exp(d)
    plain, clipped = -a * ratio, -a * clamp(ratio, 1 - low, 1 + high)
    most = F.greatest(plain, clipped)
    loss = F.when(a < 0, F.least(-a * dual, most)).otherwise(most)
    lower = ((most > -a * dual) & (a < 0)).cast("double")
    return tokens.groupBy(*keys).agg(
        masked_mean(loss, m).alias("loss"), masked_mean((clipped > plain).cast("double"), m).alias("clip_fraction"),
        masked_mean(-d, m).alias("approx_kl"), masked_mean(lower, m).alias("lower_clip_fraction"),
    )


@register_diagnostics("sequence")
def sequence_ratio(tokens: DataFrame, low: float = 0.2, high: float = 0.2, seq: str = "sample_id") -> DataFrame:
    """Per sequence the length-normalised ratio, and whether it is outside the clip range."""
    m = F.col("mask")
    log_ratio = F.least(F.sum((F.col("new_lp") - F.col("old_lp")) * m) / F.greatest(F.sum(m), F.lit(1)), F.lit(10.0))
    d = tokens.groupBy(seq).agg(F.exp(log_ratio).alias("ratio"))
    return d.withColumn("clipped", (F.col("ratio") < 1 - low) | (F.col("ratio") > 1 + high))


@register_diagnostics("geometric")
def geometric_ratio(tokens: DataFrame, clip: float = 0.4, seq: str = "sample_id") -> DataFrame:
    """Per sequence the geometric mean of token ratios, each clipped in log space on the side that its advantage allows."""
    m, a = F.col("mask"), F.col("advantage")
    d = F.col("new_lp") - F.col("old_lp")
    sign = F.signum(a)
    low = F.least(sign * d, sign * clamp(d, -clip, clip)) * sign
    return tokens.groupBy(seq).agg(F.exp(F.sum(low * m) / (F.sum(m) + F.lit(1e-8))).alias("ratio"))


@register_diagnostics("value")
def value_loss(tokens: DataFrame, clip: float = 0.5) -> DataFrame:
    """loss and clip_fraction of tokens(pred, value, returns, mask)."""
    p, v, r = F.col("pred"), F.col("value"), F.col("returns")
    plain, clipped = F.pow(p - r, 2), F.pow(F.greatest(F.least(p, v + clip), v - clip) - r, 2)
    m = F.col("mask")
    return tokens.agg((0.5 * masked_mean(F.greatest(plain, clipped), m)).alias("loss"), masked_mean((clipped > plain).cast("double"), m).alias("clip_fraction"))


@register_diagnostics("gpg")
def gpg_loss(tokens: DataFrame, mode: str = "token-mean", seq: str = "sample_id") -> DataFrame:
    """loss of tokens(new_lp, advantage, mask): minus log-probability times advantage."""
    return aggregate_loss(tokens, -F.col("new_lp") * F.col("advantage"), mode, seq)


def covariance(tokens: DataFrame) -> DataFrame:
    """Valid tokens with cov, the product of what advantage and new_lp are above their means, to nine places (a sum's order may change the last bits of a mean)."""
    v = with_global(tokens.where("mask = 1"), _a=F.avg("advantage"), _l=F.avg("new_lp"), _n=F.count("*"))
    return v.withColumn("cov", F.round((F.col("advantage") - F.col("_a")) * (F.col("new_lp") - F.col("_l")), 9)).drop("_a", "_l")


def kl_cov(tokens: DataFrame, ratio: float = 0.0002, seq: str = "sample_id") -> DataFrame:
    """The share of valid tokens (one at least) with the largest covariance: their number from the global count, their choice by a distributed order."""
    k = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") * ratio))
    return ranked(covariance(tokens), [F.desc("cov"), F.col(seq), F.col("pos")], "_r").where(F.col("_r") < k).drop("_r", "_n")


def clip_cov(tokens: DataFrame, low: float = 1.0, high: float = 5.0, ratio: float = 0.0002, clip: float = 0.2, seed: str = "9", seq: str = "sample_id") -> DataFrame:
    """A hash-chosen share of the valid tokens (one at least), from those whose covariance lies between low and high and that clipping leaves alone."""
    a, r = F.col("advantage"), F.exp(clamp(F.col("new_lp") - F.col("old_lp"), -20, 20))
    clipped = -a * clamp(r, 1 - clip, 1 + clip) > -a * r
    k = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") * ratio))
    band = covariance(tokens).where((F.col("cov") > low) & (F.col("cov") < high) & ~clipped).withColumn("_h", hash_key(seed, seq, "pos"))
    return ranked(band, [F.col("_h"), F.col(seq), F.col("pos")], "_r").where(F.col("_r") < k).drop("_r", "_n", "_h")


def mismatches(tokens: DataFrame, a: str, b: str, seq: str = "sample_id") -> DataFrame:
    """seq, n_different: valid tokens of a sequence whose ids differ."""
    return tokens.groupBy(seq).agg(F.count_if((F.col("mask") == 1) & ~F.col(a).eqNullSafe(F.col(b))).alias("n_different"))


def agreement(tokens: DataFrame, a: str, b: str) -> DataFrame:
    """Largest, mean and deviation of the probability gap of two policies on valid tokens, and their correlation."""
    t = tokens.where("mask = 1").select(F.exp(a).alias("p"), F.exp(b).alias("q"))
    gap = F.abs(F.col("p") - F.col("q"))
    return t.agg(F.max(gap).alias("gap_max"), F.avg(gap).alias("gap_mean"), F.stddev_samp(gap).alias("gap_std"), F.corr("p", "q").alias("pearson"))


def explained_variance(tokens: DataFrame) -> DataFrame:
    """1 - var(returns - value) / (var(returns) + 1e-5) on valid tokens."""
    t = tokens.where("mask = 1")
    return t.agg((1 - F.var_samp(F.col("returns") - F.col("value")) / (F.var_samp("returns") + F.lit(1e-5))).alias("explained_variance"))


def spans(tokens: DataFrame, seq: str = "sample_id") -> DataFrame:
    """Runs of mask 1 as turns: seq, turn_id, start, end, length, is_final."""
    from pyspark.sql import Window

    w = Window.partitionBy(seq)
    on = tokens.where("mask = 1").withColumn("_g", F.col("pos") - F.row_number().over(w.orderBy("pos")))
    runs = on.groupBy(seq, "_g").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    k = F.row_number().over(w.orderBy("start")) - 1
    d = runs.withColumn("turn_id", k.cast("long"))
    return d.select(seq, "turn_id", "start", "end", (F.col("end") - F.col("start") + 1).alias("length"), (F.col("turn_id") == F.max("turn_id").over(w)).alias("is_final"))


def gaps(tokens: DataFrame, seq: str = "sample_id") -> DataFrame:
    """Runs of mask 0 between turns (a later token has mask 1): seq, start, end."""
    from pyspark.sql import Window

    w = Window.partitionBy(seq)
    last = F.max(F.when(F.col("mask") == 1, F.col("pos"))).over(w)
    off = tokens.withColumn("_last", last).where("mask = 0 AND pos < _last").withColumn("_g", F.col("pos") - F.row_number().over(w.orderBy("pos")))
    return off.groupBy(seq, "_g").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).drop("_g")


def spread(tokens: DataFrame, turns: DataFrame, value: str, seq: str = "sample_id") -> DataFrame:
    """Each token with its turn's value, 0 outside turns. Turns give their positions, so the join has equal keys only."""
    at = turns.select(seq, F.explode(F.sequence("start", "end")).alias("pos"), value)
    return tokens.hint("merge").join(at, [seq, "pos"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def eos_mask(ids: Column, eos: list[int]) -> Column:
    """1 up to and with the first end token."""
    hit = F.array_min(F.filter(F.transform(ids, lambda t, i: F.when(t.isin(*eos), i)), lambda i: i.isNotNull()))
    return F.transform(ids, lambda t, i: F.when(hit.isNull() | (i <= hit), 1).otherwise(0))


def fit(ids: Column, length: int, pad: int, side: str = "right", cut: str = "right") -> Column:
    """Exactly ``length`` ids: padded at ``side``; cut at the left, right, middle, or an error."""
    n = F.size(ids)
    half = length // 2
    if cut == "left":
        short = F.slice(ids, n - length + 1, F.lit(length))
    elif cut == "right":
        short = F.slice(ids, 1, length)
    elif cut == "middle":
        short = F.concat(F.slice(ids, 1, half), F.slice(ids, n - (length - half) + 1, F.lit(length - half)))
    elif cut == "error":
        short = F.raise_error(F.lit("longer than the limit")).cast("array<bigint>")
    else:
        raise ValueError(f"unknown cut {cut!r}")
    fill = F.array_repeat(F.lit(pad).cast("long"), F.greatest(length - n, F.lit(0)))
    return F.when(n > length, short).otherwise(F.concat(fill, ids) if side == "left" else F.concat(ids, fill))


def preference_loss(kind: str, beta: float, chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column) -> Column:
    """sigmoid: -ln(sigmoid(beta * x)), in the form that doesn't overflow; ipo: (x - 1 / (2 beta))^2."""
    x = (chosen - rejected) - (ref_chosen - ref_rejected)
    if kind == "sigmoid":
        z = -beta * x
        return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    if kind == "ipo":
        return F.pow(x - 1 / (2 * beta), 2)
    raise ValueError(f"unknown loss {kind!r}")
