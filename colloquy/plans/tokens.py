"""Token-log statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.numeric import masked_mean, r6
from colloquy.operators import scoring
from colloquy.operators import tokens as K
from colloquy.operators.advantages import with_global
from colloquy.plans.base import query
from colloquy.sources.views import view

L = ("token_logs",)
_MM = "sum(CASE WHEN mask <> 0 THEN ({0}) * mask ELSE 0.0 END) / (sum(mask) + 1e-8)"


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "token_logs")
    return t.withColumns({"returns": F.col("reward") + F.col("value"), "advantage": F.col("reward") - 0.05})


def _mm(x: str) -> str:
    return _MM.format(x)


@query("d14", "SELECT round(1 - var_samp(reward + value - value) / (var_samp(reward + value) + 1e-5), 6) + 0.0 AS explained_variance FROM token_logs WHERE mask = 1", L)
def d14(spark: SparkSession, sf: str) -> DataFrame:
    return K.explained_variance(_logs(spark, sf)).select(r6("explained_variance").alias("explained_variance"))


@query("d25", f"SELECT uid, round(sum(reward * mask), 6) + 0.0 AS masked_sum, round({_mm('reward')}, 6) + 0.0 AS masked_mean FROM token_logs GROUP BY uid", L)
def d25(spark: SparkSession, sf: str) -> DataFrame:
    return _logs(spark, sf).groupBy("uid").agg(r6(F.sum(F.col("reward") * F.col("mask"))).alias("masked_sum"), r6(masked_mean(F.col("reward"), F.col("mask"))).alias("masked_mean"))


@query(
    "d26",
    f"""WITH s AS (SELECT sample_id, sum(reward * mask) AS s, sum(mask) AS n, count(*) AS len FROM token_logs GROUP BY 1)
SELECT 'token-mean' AS mode, round({_mm('reward')}, 6) + 0.0 AS loss FROM token_logs UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 6) + 0.0 FROM s
UNION ALL SELECT 'seq-mean-token-mean', round(avg(s / nullif(n, 0)), 6) + 0.0 FROM s UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) / max(len), 6) + 0.0 FROM s""",
    L,
)
def d26(spark: SparkSession, sf: str) -> DataFrame:
    t = _logs(spark, sf)
    out = None
    for mode in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"):
        one = K.aggregate_loss(t, F.col("reward"), mode).select(F.lit(mode).alias("mode"), r6("loss").alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "d27",
    "SELECT round(max(abs(p - q)), 6) + 0.0 AS gap_max, round(avg(abs(p - q)), 6) + 0.0 AS gap_mean, round(stddev_samp(abs(p - q)), 6) + 0.0 AS gap_std, round(corr(p, q), 6) + 0.0 AS pearson FROM (SELECT exp(old_lp) AS p, exp(new_lp) AS q FROM token_logs WHERE mask = 1) t",
    L,
)
def d27(spark: SparkSession, sf: str) -> DataFrame:
    a = K.agreement(_logs(spark, sf), "old_lp", "new_lp")
    return a.select(*(r6(c).alias(c) for c in a.columns))


_KL = "greatest(least(ref_lp - new_lp, 20), -20)"


@query(
    "h27",
    f"""SELECT sample_id, pos, round(new_lp - ref_lp, 6) + 0.0 AS k1, round(abs(new_lp - ref_lp), 6) + 0.0 AS abs, round(0.5 * power(new_lp - ref_lp, 2), 6) + 0.0 AS k2,
round(greatest(least(exp({_KL}) - {_KL} - 1, 10), -10), 6) + 0.0 AS k3 FROM token_logs""",
    L,
)
def h27(spark: SparkSession, sf: str) -> DataFrame:
    return _logs(spark, sf).select("sample_id", "pos", *(r6(K.kl(k, F.col("new_lp"), F.col("ref_lp"))).alias(k) for k in ("k1", "abs", "k2", "k3")))


@query(
    "h34",
    """SELECT sample_id, pos, round(greatest(-0.1 * x, 0) + ln(1 + exp(-abs(0.1 * x))), 6) + 0.0 AS sigmoid, round(power(x - 5, 2), 6) + 0.0 AS ipo FROM (SELECT sample_id, pos, (new_lp - old_lp) - (ref_lp - old_lp) AS x FROM token_logs) t""",
    L,
)
def h34(spark: SparkSession, sf: str) -> DataFrame:
    c = [F.col(x) for x in ("new_lp", "old_lp", "ref_lp", "old_lp")]
    return _logs(spark, sf).select("sample_id", "pos", r6(K.preference_loss("sigmoid", 0.1, *c)).alias("sigmoid"), r6(K.preference_loss("ipo", 0.1, *c)).alias("ipo"))


_RUNS = """o AS (SELECT *, pos - row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS g FROM token_logs WHERE mask = 1),
r AS (SELECT sample_id, min(pos) AS start, max(pos) AS "end" FROM o GROUP BY sample_id, g),
k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY start) - 1 AS turn_id FROM r)"""


@query("e17", f'WITH {_RUNS} SELECT sample_id, turn_id, start, "end", "end" - start + 1 AS length, turn_id = max(turn_id) OVER (PARTITION BY sample_id) AS is_final FROM k', L)
def e17(spark: SparkSession, sf: str) -> DataFrame:
    return K.spans(_logs(spark, sf))


@query(
    "e18",
    """WITH l AS (SELECT *, max(pos) FILTER (WHERE mask = 1) OVER (PARTITION BY sample_id) AS last FROM token_logs),
o AS (SELECT sample_id, pos, pos - row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS g FROM l WHERE mask = 0 AND pos < last)
SELECT sample_id, min(pos) AS start, max(pos) AS "end" FROM o GROUP BY sample_id, g""",
    L,
)
def e18(spark: SparkSession, sf: str) -> DataFrame:
    return K.gaps(_logs(spark, sf))


@query("e11", f'WITH {_RUNS} SELECT t.sample_id, t.pos, round(coalesce((k.turn_id + 1) / 4.0, 0), 6) + 0.0 AS value FROM token_logs t LEFT JOIN k ON k.sample_id = t.sample_id AND t.pos BETWEEN k.start AND k."end"', L)
def e11(spark: SparkSession, sf: str) -> DataFrame:
    t = _logs(spark, sf)
    turns = K.spans(t).withColumn("turn_value", (F.col("turn_id") + 1) / 4.0)
    return K.spread(t, turns, "turn_value").select("sample_id", "pos", r6("turn_value").alias("value"))


@query("e21", "SELECT sample_id, pos, CAST(greatest(sum(mask) OVER (PARTITION BY sample_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1, 0) AS BIGINT) AS position_id FROM token_logs", L)
def e21(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("sample_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return _logs(spark, sf).select("sample_id", "pos", F.greatest(F.sum("mask").over(w) - 1, F.lit(0)).cast("long").alias("position_id"))


@query(
    "e22",
    "SELECT sample_id, pos, CASE WHEN coalesce(sum(CASE WHEN mask = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS response_mask FROM token_logs",
    L,
)
def e22(spark: SparkSession, sf: str) -> DataFrame:
    """Token 0 ends a response here."""
    x = F.sort_array(F.collect_list(F.struct("pos", "mask")))
    d = _logs(spark, sf).groupBy("sample_id").agg(x.alias("x")).select("sample_id", F.col("x.pos").alias("pos"), K.eos_mask(F.col("x.mask"), [0]).alias("m"))
    return d.select("sample_id", F.explode(F.arrays_zip("pos", "m")).alias("t")).select("sample_id", "t.pos", F.col("t.m").alias("response_mask"))


@query(
    "h24",
    """WITH a AS (SELECT sample_id, list(pos ORDER BY pos) AS ids FROM token_logs GROUP BY 1)
SELECT sample_id, array_to_string(CASE WHEN len(ids) > 4 THEN list_concat(ids[1:2], ids[len(ids) - 1:len(ids)]) ELSE list_concat(list_transform(range(4 - len(ids)), lambda x: 9), ids) END, ' ') AS ids FROM a""",
    L,
)
def h24(spark: SparkSession, sf: str) -> DataFrame:
    d = _logs(spark, sf).groupBy("sample_id").agg(F.sort_array(F.collect_list("pos")).alias("ids"))
    return d.select("sample_id", F.concat_ws(" ", K.fit(F.col("ids"), 4, 9, side="left", cut="middle").cast("array<string>")).alias("ids"))


_COV = """WITH v AS (SELECT *, reward - 0.05 AS advantage, least(greatest(new_lp - old_lp, -20), 20) AS d FROM token_logs WHERE mask = 1),
m AS (SELECT avg(advantage) AS a, avg(new_lp) AS l, greatest(1, CAST(floor(count(*) * 0.002) AS BIGINT)) AS k FROM v),
c AS (SELECT sample_id, pos, round((advantage - a) * (new_lp - l), 9) AS cov, k, -advantage * greatest(least(exp(d), 1.2), 0.8) > -advantage * exp(d) AS clipped FROM v, m)"""


@query("f9", _COV + " SELECT sample_id, pos FROM c QUALIFY row_number() OVER (ORDER BY cov DESC, sample_id, pos) <= k", L)
def f9(spark: SparkSession, sf: str) -> DataFrame:
    return K.kl_cov(_logs(spark, sf), 0.002).select("sample_id", "pos")


@query("f9_clip", _COV + " SELECT sample_id, pos FROM c WHERE cov > 0.001 AND cov < 0.01 AND NOT clipped QUALIFY row_number() OVER (ORDER BY md5('9|' || CAST(sample_id AS VARCHAR) || '|' || CAST(pos AS VARCHAR)), sample_id, pos) <= k", L)
def f9_clip(spark: SparkSession, sf: str) -> DataFrame:
    return K.clip_cov(_logs(spark, sf), 0.001, 0.01, 0.002).select("sample_id", "pos")


@query("i7", "SELECT sample_id, round(least(-(resp_len - 60) / 36.0, 0), 6) + 0.0 AS penalty FROM rollouts", ("rollouts",))
def i7(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "rollouts").select("sample_id", r6(scoring.overlong_penalty(F.col("resp_len"), 96, 36, 1.0)).alias("penalty"))


@query("i8", "SELECT sample_id, round(CASE WHEN score < 50 THEN least(-0.6, -1 + (step - 2) / 2.0 * 0.1) ELSE 1 END, 6) + 0.0 AS shaped FROM rollouts", ("rollouts",))
def i8(spark: SparkSession, sf: str) -> DataFrame:
    score = F.when(F.col("score") < 50, F.lit(-1.0)).otherwise(F.lit(1.0))
    return view(spark, sf, "rollouts").select("sample_id", r6(scoring.tool_shaped(score, F.col("step"))).alias("shaped"))


@query(
    "i9",
    f"""SELECT uid, round({_mm('new_lp - ref_lp')}, 6) + 0.0 AS mean_kl, round(sum((reward - 0.1 * (new_lp - ref_lp)) * mask), 6) + 0.0 AS total_reward FROM token_logs GROUP BY uid""",
    L,
)
def i9(spark: SparkSession, sf: str) -> DataFrame:
    k = K.kl("k1", F.col("new_lp"), F.col("ref_lp"))
    return _logs(spark, sf).groupBy("uid").agg(r6(masked_mean(k, F.col("mask"))).alias("mean_kl"), r6(F.sum((F.col("reward") - 0.1 * k) * F.col("mask"))).alias("total_reward"))


_PG = """WITH t AS (SELECT uid, mask, reward - 0.05 AS a, greatest(least(new_lp - old_lp, 20), -20) AS d FROM token_logs),
p AS (SELECT *, -a * exp(d) AS p1, -a * greatest(least(exp(d), 1.2), 0.8) AS p2 FROM t), m AS (SELECT *, greatest(p1, p2) AS pm FROM p)"""


@query(
    "i10",
    _PG
    + f""" SELECT uid, round({_mm('CASE WHEN a < 0 THEN least(-a * 3.0, pm) ELSE pm END')}, 6) + 0.0 AS loss, round({_mm('CASE WHEN p2 > p1 THEN 1.0 ELSE 0.0 END')}, 6) + 0.0 AS clip_fraction,
round({_mm('-d')}, 6) + 0.0 AS approx_kl, round({_mm('CASE WHEN pm > -a * 3.0 AND a < 0 THEN 1.0 ELSE 0.0 END')}, 6) + 0.0 AS lower_clip_fraction FROM m GROUP BY uid""",
    L,
)
def i10(spark: SparkSession, sf: str) -> DataFrame:
    d = K.diagnostics("vanilla")(_logs(spark, sf), keys=("uid",))
    return d.select("uid", *(r6(c).alias(c) for c in d.columns[1:]))


@query(
    "i11",
    """SELECT sample_id, round(exp(x), 6) + 0.0 AS ratio, exp(x) < 0.8 OR exp(x) > 1.2 AS clipped FROM (SELECT sample_id, least(sum((new_lp - old_lp) * mask) / greatest(sum(mask), 1), 10) AS x FROM token_logs GROUP BY 1) t""",
    L,
)
def i11(spark: SparkSession, sf: str) -> DataFrame:
    return K.diagnostics("sequence")(_logs(spark, sf)).select("sample_id", r6("ratio").alias("ratio"), "clipped")


@query(
    "i11_geometric",
    """WITH t AS (SELECT sample_id, mask, new_lp - old_lp AS d, sign(reward - 0.05) AS s FROM token_logs)
SELECT sample_id, round(exp(sum(least(s * d, s * greatest(least(d, 0.4), -0.4)) * s * mask) / (sum(mask) + 1e-8)), 6) + 0.0 AS ratio FROM t GROUP BY 1""",
    L,
)
def i11_geometric(spark: SparkSession, sf: str) -> DataFrame:
    return K.diagnostics("geometric")(_logs(spark, sf)).select("sample_id", r6("ratio").alias("ratio"))


@query(
    "i12",
    f"""WITH t AS (SELECT mask, power(reward - (reward + value), 2) AS p1, power(greatest(least(reward, value + 0.02), value - 0.02) - (reward + value), 2) AS p2 FROM token_logs)
SELECT round(0.5 * ({_mm('greatest(p1, p2)')}), 6) + 0.0 AS loss, round({_mm('CASE WHEN p2 > p1 THEN 1.0 ELSE 0.0 END')}, 6) + 0.0 AS clip_fraction FROM t""",
    L,
)
def i12(spark: SparkSession, sf: str) -> DataFrame:
    d = K.diagnostics("value")(_logs(spark, sf).withColumn("pred", F.col("reward")), clip=0.02)
    return d.select(r6("loss").alias("loss"), r6("clip_fraction").alias("clip_fraction"))


@query("i12_gpg", f"SELECT round({_mm('-new_lp * (reward - 0.05)')}, 6) + 0.0 AS loss FROM token_logs", L)
def i12_gpg(spark: SparkSession, sf: str) -> DataFrame:
    return K.diagnostics("gpg")(_logs(spark, sf)).select(r6("loss").alias("loss"))


@query("d27_ids", "SELECT sample_id, count(*) FILTER (WHERE mask = 1 AND pos % 7 <> CASE WHEN reward > 0.05 THEN pos % 5 ELSE pos % 7 END) AS n_different FROM token_logs GROUP BY 1", L)
def d27_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of two runs that part where the reward is high."""
    t = _logs(spark, sf).withColumns({"a": F.col("pos") % 7, "b": F.when(F.col("reward") > 0.05, F.col("pos") % 5).otherwise(F.col("pos") % 7)})
    return K.mismatches(t, "a", "b").select("sample_id", "n_different")


@query(
    "d13_tokens",
    """SELECT uid, round(avg(reward - 0.05), 6) + 0.0 AS advantage_mean, round(max(reward - 0.05), 6) + 0.0 AS advantage_max, round(min(reward - 0.05), 6) + 0.0 AS advantage_min,
round(avg(reward + value), 6) + 0.0 AS returns_mean, round(max(reward + value), 6) + 0.0 AS returns_max, round(min(reward + value), 6) + 0.0 AS returns_min,
round(avg(value), 6) + 0.0 AS value_mean, round(max(value), 6) + 0.0 AS value_max, round(min(value), 6) + 0.0 AS value_min,
round(1 - var_samp(reward + value - value) / (var_samp(reward + value) + 1e-5), 4) + 0.0 AS explained_variance FROM token_logs WHERE mask = 1 GROUP BY 1""",
    L,
)
def d13_tokens(spark: SparkSession, sf: str) -> DataFrame:
    from colloquy.functions.numeric import r4
    from colloquy.operators.metrics import token_metrics

    m = token_metrics(_logs(spark, sf), ["uid"])
    return m.select("uid", *((r4 if c == "explained_variance" else r6)(c).alias(c) for c in m.columns[1:]))
