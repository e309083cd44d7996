"""Evaluation metrics (B18, C14-C22, D5, D12-D24, A17, A19, F11, F16, H18 callers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.numeric import r4, r6
from colloquy.operators import metrics as M
from colloquy.operators.datasets import ranked_within
from colloquy.plans.base import query
from colloquy.plans.text import _SCORED
from colloquy.sources.views import table, view

R = ("rollouts",)


def _rolls(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "rollouts")


_GM = """WITH d AS (SELECT data_source, uid, score AS v, sample_id AS o, pred AS p, row_number() OVER (PARTITION BY data_source, uid ORDER BY score, sample_id) AS i, count(*) OVER (PARTITION BY data_source, uid) AS n FROM rollouts),
k AS (SELECT DISTINCT n, k FROM (SELECT n, unnest(list_append(list_filter(list_transform(range(1, 40), lambda x: CAST(power(2, x) AS BIGINT)), lambda x: x < n), n)) AS k FROM (SELECT DISTINCT n FROM d WHERE n > 1) t) u),
e AS (SELECT d.*, k.k, power(CAST(i AS DOUBLE) / d.n, k) - power(CAST(i - 1 AS DOUBLE) / d.n, k) AS pb, power(CAST(d.n - i + 1 AS DOUBLE) / d.n, k) - power(CAST(d.n - i AS DOUBLE) / d.n, k) AS pw FROM d JOIN k ON d.n = k.n),
m AS (SELECT data_source, uid, k, sum(pb * v) AS b1, sum(pb * v * v) AS b2, sum(pw * v) AS w1, sum(pw * v * v) AS w2 FROM e GROUP BY 1, 2, 3),
vt AS (SELECT data_source, uid, n, p, count(*) AS c, min(o) AS o, arg_min(v, o) AS v FROM d WHERE n > 1 GROUP BY 1, 2, 3, 4),
mj AS (SELECT data_source, uid, n, v FROM vt QUALIFY row_number() OVER (PARTITION BY data_source, uid ORDER BY c DESC, o) = 1),
g AS (SELECT data_source, uid, 'mean@' || CAST(count(*) AS VARCHAR) AS metric, avg(v) AS value FROM d GROUP BY 1, 2
  UNION ALL SELECT data_source, uid, 'std@' || CAST(count(*) AS VARCHAR), stddev_pop(v) FROM d GROUP BY 1, 2 HAVING count(*) > 1
  UNION ALL SELECT data_source, uid, 'best@' || CAST(k AS VARCHAR) || '/mean', b1 FROM m UNION ALL SELECT data_source, uid, 'best@' || CAST(k AS VARCHAR) || '/std', sqrt(greatest(b2 - b1 * b1, 0)) FROM m
  UNION ALL SELECT data_source, uid, 'worst@' || CAST(k AS VARCHAR) || '/mean', w1 FROM m UNION ALL SELECT data_source, uid, 'worst@' || CAST(k AS VARCHAR) || '/std', sqrt(greatest(w2 - w1 * w1, 0)) FROM m
  UNION ALL SELECT data_source, uid, 'maj@' || CAST(n AS VARCHAR) || '/mean', v FROM mj)
"""
#: Votes among rows drawn with replacement: draws by hash, ties to the pred drawn first.
_DRAWS = 8
_MAJ = f""", rr AS (SELECT *, row_number() OVER (PARTITION BY data_source, uid ORDER BY o) AS r FROM d WHERE n > 1),
dw AS (SELECT g0.data_source, g0.uid, k.k, b.b, j.j, CAST(('0x' || substr(md5(concat_ws('|', '42', g0.data_source, g0.uid, CAST(k.k AS VARCHAR), CAST(b.b AS VARCHAR), CAST(j.j AS VARCHAR))), 1, 8)) AS BIGINT) % g0.n + 1 AS r
  FROM (SELECT DISTINCT data_source, uid, n FROM d WHERE n > 1) g0 JOIN k ON k.n = g0.n AND k.k < g0.n, range({_DRAWS}) b(b), range(64) j(j) WHERE j.j < k.k),
dv AS (SELECT dw.data_source, dw.uid, k, b, p, count(*) AS c, min(j) AS j, arg_min(v, j) AS v FROM dw JOIN rr ON rr.data_source = dw.data_source AND rr.uid = dw.uid AND rr.r = dw.r GROUP BY 1, 2, 3, 4, 5),
dm AS (SELECT data_source, uid, k, avg(v) AS m, stddev_pop(v) AS s FROM (SELECT * FROM dv QUALIFY row_number() OVER (PARTITION BY data_source, uid, k, b ORDER BY c DESC, j) = 1) t GROUP BY 1, 2, 3),
g2 AS (SELECT * FROM g UNION ALL SELECT data_source, uid, 'maj@' || CAST(k AS VARCHAR) || '/mean', m FROM dm UNION ALL SELECT data_source, uid, 'maj@' || CAST(k AS VARCHAR) || '/std', s FROM dm)
"""


@query("d16", _GM + "SELECT data_source, metric, round(avg(value), 4) + 0.0 AS value FROM g WHERE metric LIKE 'mean%' OR metric LIKE 'std%' GROUP BY 1, 2", R)
def d16(spark: SparkSession, sf: str) -> DataFrame:
    v = M.validation(_rolls(spark, sf), "data_source", "uid", "score", "sample_id", only=("mean", "std"))
    return v.select("data_source", "metric", r4("value").alias("value"))


@query("d17", _GM + "SELECT data_source, uid, metric, round(value, 4) + 0.0 AS value FROM g WHERE metric LIKE 'best%' OR metric LIKE 'worst%'", R)
def d17(spark: SparkSession, sf: str) -> DataFrame:
    v = M.group_metrics(_rolls(spark, sf), ["data_source", "uid"], "score", "sample_id", only=("best", "worst"))
    return v.select("data_source", "uid", "metric", r4("value").alias("value"))


@query("d18", _GM + _MAJ + "SELECT data_source, metric, round(avg(value), 4) + 0.0 AS value FROM g2 WHERE metric LIKE 'maj%' GROUP BY 1, 2", R)
def d18(spark: SparkSession, sf: str) -> DataFrame:
    v = M.validation(_rolls(spark, sf), "data_source", "uid", "score", "sample_id", "pred", draws=_DRAWS, only=("maj",))
    return v.select("data_source", "metric", r4("value").alias("value"))


@query(
    "d19",
    _GM
    + """, s AS (SELECT data_source, CASE WHEN data_source = 'src_a' THEN 'acc' ELSE 'reward' END AS var, metric, avg(value) AS value FROM g GROUP BY 1, 2, 3),
t AS (SELECT *, CAST(regexp_extract(metric, '@([0-9]+)', 1) AS BIGINT) AS n FROM s), x AS (SELECT *, max(n) OVER (PARTITION BY data_source, var) AS top FROM t)
SELECT CASE WHEN regexp_matches(metric, '^(mean|maj|best)') AND n = top THEN 'val-core/' ELSE 'val-aux/' END || data_source || '/' || var || '/' || metric AS name, round(value, 4) + 0.0 AS value FROM x""",
    R,
)
def d19(spark: SparkSession, sf: str) -> DataFrame:
    v = M.validation(_rolls(spark, sf), "data_source", "uid", "score", "sample_id", "pred").withColumn("var", F.when(F.col("data_source") == "src_a", "acc").otherwise("reward"))
    return M.named(v, "data_source").select("name", r4("value").alias("value"))


@query(
    "d20",
    """SELECT name, round(CASE WHEN contains(name, 'max') THEN max(score) WHEN contains(name, 'min') THEN min(score) ELSE avg(score) END, 6) + 0.0 AS value
FROM (SELECT CASE step % 3 WHEN 0 THEN 'score_max' WHEN 1 THEN 'score_min' ELSE 'score' END || '/' || data_source AS name, score FROM rollouts) t GROUP BY name""",
    R,
)
def d20(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("step") % 3
    name = F.concat_ws("/", F.when(k == 0, "score_max").when(k == 1, "score_min").otherwise("score"), "data_source")
    return M.reduced(_rolls(spark, sf).select(name.alias("name"), F.col("score").alias("value"))).select("name", r6("value").alias("value"))


def _three(name: str, x: str, where: str = "") -> str:
    of = f" FILTER (WHERE {where})" if where else ""
    return ", ".join(f"round(CAST({f}({x}){of} AS DOUBLE), 6) + 0.0 AS {name}_{tail}" for f, tail in (("avg", "mean"), ("max", "max"), ("min", "min")))


_BATCH = "SELECT * REPLACE (resp_len - 1 AS resp_len), score - 0.1 * resp_len AS reward, 1 + sample_id % 40 AS prompt_len, 1 + sample_id % 6 AS turns, sample_id % 3 AS tools FROM rollouts"


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("sample_id")
    return _rolls(spark, sf).withColumns({"reward": F.col("score") - 0.1 * F.col("resp_len"), "prompt_len": 1 + k % 40, "turns": 1 + k % 6, "tools": k % 3, "resp_len": F.col("resp_len") - 1})


@query(
    "d13",
    f"""SELECT step, {_three('score', 'score', 'resp_len > 0')}, {_three('reward', 'reward', 'resp_len > 0')}, {_three('length', 'resp_len')}, {_three('alive_length', 'resp_len', 'resp_len > 0')},
round(avg(CASE WHEN resp_len = 96 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS clip_ratio, round(avg(CASE WHEN resp_len = 96 THEN 1.0 ELSE 0.0 END) FILTER (WHERE resp_len > 0), 6) + 0.0 AS alive_clip_ratio, round(avg(CASE WHEN resp_len > 0 THEN 0.0 ELSE 1.0 END), 6) + 0.0 AS aborted_ratio,
{_three('prompt', 'prompt_len')}, round(avg(CASE WHEN prompt_len = 40 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS prompt_clip_ratio, {_three('turns', 'turns')}, {_three('tools', 'tools')} FROM ({_BATCH}) t GROUP BY step""",
    R,
)
def d13(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of rows by step; those of tokens are d13_tokens."""
    m = M.data_metrics(_batch(spark, sf), 96, 40, ["step"])
    return m.select("step", *(r6(c).alias(c) for c in m.columns[1:]))


@query("b18", "SELECT sample_id, score FROM rollouts WHERE resp_len - 1 > 0", R)
def b18(spark: SparkSession, sf: str) -> DataFrame:
    return _rolls(spark, sf).where("resp_len - 1 > 0").select("sample_id", "score")


@query(
    "d15",
    """SELECT step, CAST(sum(resp_len) AS BIGINT) AS n_tokens, round(sum(score) / sum(resp_len), 6) + 0.0 AS time_per_token, round(sum(resp_len) / (max(score) * 8), 4) + 0.0 AS throughput FROM rollouts GROUP BY step""",
    R,
)
def d15(spark: SparkSession, sf: str) -> DataFrame:
    """Scores stand for seconds, eight workers."""
    return _rolls(spark, sf).groupBy("step").agg(
        F.sum("resp_len").alias("n_tokens"),
        r6(F.sum("score") / F.sum("resp_len")).alias("time_per_token"),
        r4(F.sum("resp_len") / (F.max("score") * 8)).alias("throughput"),
    )


@query("d21", f"SELECT data_source, round(avg(CAST({_SCORED} AS DOUBLE)), 6) + 0.0 AS score FROM responses GROUP BY 1", ("responses",))
def d21(spark: SparkSession, sf: str) -> DataFrame:
    from colloquy.operators.scoring import score_by_source

    r = view(spark, sf, "responses")
    return r.withColumn("score", score_by_source()).groupBy("data_source").agg(r6(F.avg("score")).alias("score"))


@query(
    "d22",
    """WITH f AS (SELECT * FROM tree_nodes QUALIFY row_number() OVER (PARTITION BY tree_id, level ORDER BY node_id) = 1)
SELECT level, round(avg(critic_value), 6) + 0.0 AS mean, round(stddev_pop(critic_value), 6) + 0.0 AS std FROM f GROUP BY GROUPING SETS ((), (level))""",
    ("tree_nodes",),
)
def d22(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("tree_id", "level").orderBy("node_id")
    f = view(spark, sf, "tree_nodes").withColumn("k", F.row_number().over(w)).where("k = 1")
    return f.groupingSets([[], ["level"]], "level").agg(r6(F.avg("critic_value")).alias("mean"), r6(F.stddev_pop("critic_value")).alias("std"))


@query("d23", "SELECT step, arg_max(sample_id, (score, -sample_id)) AS slowest, max(score) AS seconds FROM rollouts GROUP BY step", R)
def d23(spark: SparkSession, sf: str) -> DataFrame:
    return _rolls(spark, sf).groupBy("step").agg(F.max_by("sample_id", F.struct("score", -F.col("sample_id"))).alias("slowest"), F.max("score").alias("seconds"))


@query(
    "d5",
    "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) + 0.0 AS percent FROM events GROUP BY event_type",
)
def d5(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("event_type", "n", r4(100.0 * F.col("n") / F.col("t")).alias("percent"))


@query(
    "c14",
    """WITH k AS (SELECT uid, sample_id, score, row_number() OVER (PARTITION BY uid ORDER BY sample_id) AS slot FROM rollouts QUALIFY count(*) OVER (PARTITION BY uid) >= 2),
t AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, slot) AS r FROM k WHERE slot <= 2)
SELECT uid, max(sample_id) FILTER (WHERE r = 1) AS chosen, max(sample_id) FILTER (WHERE r = 2) AS rejected FROM t GROUP BY uid""",
    R,
)
def c14(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("uid")
    d = _rolls(spark, sf).withColumns({"slot": F.row_number().over(w.orderBy("sample_id")), "n": F.count("*").over(w)}).where("n >= 2 AND slot <= 2")
    d = d.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "slot")))
    return d.groupBy("uid").agg(F.max(F.when(F.col("r") == 1, F.col("sample_id"))).alias("chosen"), F.max(F.when(F.col("r") == 2, F.col("sample_id"))).alias("rejected"))


_ACC = "CASE WHEN pred = 'click' THEN 1.0 WHEN pred = 'view' THEN 0.5 ELSE 0.0 END"


def _acc():
    return F.when(F.col("pred") == "click", 1.0).when(F.col("pred") == "view", 0.5).otherwise(0.0)


@query(
    "c15",
    f"""WITH a AS (SELECT uid, sample_id, score, {_ACC} AS acc FROM rollouts),
p AS (SELECT a.uid, abs(a.acc - b.acc) AS gap, CASE WHEN (a.score > b.score) = (a.acc > b.acc) THEN 1.0 ELSE 0.0 END AS ok FROM a JOIN a b ON a.uid = b.uid AND a.sample_id < b.sample_id),
s AS (SELECT uid, sum(gap) AS g, sum(ok * gap) AS k FROM p GROUP BY uid)
SELECT u.uid, round(CASE WHEN coalesce(g, 0) = 0 THEN 0.5 ELSE k / g END, 6) + 0.0 AS accuracy FROM (SELECT DISTINCT uid FROM rollouts) u LEFT JOIN s ON s.uid = u.uid""",
    R,
)
def c15(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of a group, counted without making them."""
    a = _rolls(spark, sf).select("uid", "sample_id", "score", _acc().alias("acc"))
    return M.pair_accuracy(a, "uid", "sample_id", "score", "acc").select("uid", r6("accuracy").alias("accuracy"))


@query(
    "c22",
    f"""WITH a AS (SELECT uid, sample_id, score, {_ACC} AS acc FROM rollouts),
o AS (SELECT a.uid, a.sample_id, avg(b.score) AS other FROM a LEFT JOIN a b ON a.uid = b.uid AND ((a.acc > 0 AND b.acc < a.acc) OR (a.acc <= 0 AND b.acc > a.acc)) GROUP BY 1, 2),
w AS (SELECT uid, sample_id, count(*) OVER (PARTITION BY uid) * power(cume_dist() OVER (PARTITION BY uid ORDER BY score), count(*) OVER (PARTITION BY uid) - 1) AS weight FROM a)
SELECT o.uid, o.sample_id, round(coalesce(other, 0), 6) + 0.0 AS other, round(weight, 6) + 0.0 AS weight FROM o JOIN w ON o.uid = w.uid AND o.sample_id = w.sample_id""",
    R,
)
def c22(spark: SparkSession, sf: str) -> DataFrame:
    """Labels have few values, so sums by (group, label) take the place of a join of all pairs."""
    a = _rolls(spark, sf).select("uid", "sample_id", "score", _acc().alias("acc"))
    by = a.groupBy("uid", F.col("acc").alias("acc_2")).agg(F.sum("score").alias("s"), F.count("*").alias("c"))
    lower, higher = (F.col("acc") > 0) & (F.col("acc_2") < F.col("acc")), (F.col("acc") <= 0) & (F.col("acc_2") > F.col("acc"))
    pos = Window.partitionBy("uid")
    labels = a.select("uid", "acc").distinct().join(by, "uid").where(lower | higher).groupBy("uid", "acc").agg((F.sum("s") / F.sum("c")).alias("other"))
    n = F.count("*").over(pos)
    d = a.withColumn("weight", n * F.pow(F.cume_dist().over(pos.orderBy("score")), n - 1)).join(labels, ["uid", "acc"], "left")
    return d.select("uid", "sample_id", r6(F.coalesce("other", F.lit(0.0))).alias("other"), r6("weight").alias("weight"))


@query(
    "d28",
    f"SELECT step, round(avg(CASE WHEN sign(score - 50) = sign(2 * {_ACC} - 1) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM rollouts GROUP BY step",
    R,
)
def d28(spark: SparkSession, sf: str) -> DataFrame:
    hit = (F.signum(F.col("score") - 50) == F.signum(2 * _acc() - 1)).cast("double")
    return _rolls(spark, sf).groupBy("step").agg(r6(F.avg(hit)).alias("accuracy"))


@query("a17", "SELECT step, metric, round(value, 6) + 0.0 AS value FROM (SELECT step, avg(score) AS score_mean, max(resp_len)::DOUBLE AS length_max FROM rollouts GROUP BY step) t UNPIVOT (value FOR metric IN (score_mean, length_max))", R)
def a17(spark: SparkSession, sf: str) -> DataFrame:
    wide = _rolls(spark, sf).groupBy("step").agg(F.avg("score").alias("score_mean"), F.max("resp_len").alias("length_max"))
    return M.long(wide, ["step"]).select("step", "metric", r6("value").alias("value"))


@query("a19", "SELECT uid, CAST(to_json(list(pred ORDER BY sample_id)) AS VARCHAR) AS responses FROM rollouts GROUP BY uid", R)
def a19(spark: SparkSession, sf: str) -> DataFrame:
    x = F.sort_array(F.collect_list(F.struct("sample_id", "pred")))
    return _rolls(spark, sf).groupBy("uid").agg(F.to_json(F.transform(x, lambda r: r["pred"])).alias("responses"))


@query("f11", "SELECT data_source, sample_id FROM rollouts QUALIFY row_number() OVER (PARTITION BY data_source ORDER BY sample_id) <= 4", R)
def f11(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("data_source").orderBy("sample_id")
    return _rolls(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 4").select("data_source", "sample_id")


@query("f16", "SELECT step, sample_id, CAST(row_number() OVER (PARTITION BY step ORDER BY score DESC, sample_id) AS INTEGER) AS place FROM rollouts WHERE contains(pred, 'i')", R)
def f16(spark: SparkSession, sf: str) -> DataFrame:
    r = _rolls(spark, sf).where(F.col("pred").contains("i")).select("step", "sample_id", "score")
    return ranked_within(r, "step", [F.desc("score"), F.col("sample_id")]).select("step", "sample_id", (F.col("rank") + 1).cast("int").alias("place"))


@query(
    "d24",
    """WITH RECURSIVE r AS (SELECT step, resp_len, row_number() OVER (PARTITION BY step ORDER BY sample_id) - 1 AS k, count(*) OVER (PARTITION BY step) AS n FROM rollouts),
c AS (SELECT step, k * 4 // n AS part, sum(resp_len) AS tokens, max(resp_len) AS longest FROM r GROUP BY 1, 2),
l AS (SELECT step, resp_len AS x, count(*) AS n FROM rollouts GROUP BY 1, 2),
f AS (SELECT step, CAST(-x AS BIGINT) AS s, CAST(row_number() OVER (PARTITION BY step ORDER BY x) - 1 AS BIGINT) AS t, CAST(CASE n % 4 WHEN 1 THEN [x, 0, 0, 0] WHEN 2 THEN [x, x, 0, 0] ELSE [x, x, x, 0] END AS BIGINT[]) AS v FROM l WHERE n % 4 > 0),
h AS (SELECT step, list({'s': s, 't': t, 'v': v} ORDER BY s, t) AS h, count(*) AS tick FROM f GROUP BY 1
  UNION ALL SELECT step, list_sort(list_append(h[3:], {'s': v[4] - v[1], 't': tick, 'v': v})), tick + 1
  FROM (SELECT step, h, tick, list_reverse_sort([h[1].v[1] + h[2].v[4], h[1].v[2] + h[2].v[3], h[1].v[3] + h[2].v[2], h[1].v[4] + h[2].v[1]]) AS v FROM h WHERE len(h) > 1) m),
w AS (SELECT step, sum(n // 4 * x) AS whole FROM l GROUP BY 1),
b AS (SELECT w.step, whole + coalesce(h[1].v[4], 0) AS balanced_least, whole + coalesce(h[1].v[1], 0) AS balanced_most FROM w LEFT JOIN (SELECT step, h FROM h WHERE len(h) = 1) e ON e.step = w.step),
a AS (SELECT step, min(tokens) AS least, max(tokens) AS most, sum(tokens) / 4 AS mean, max(longest) AS longest FROM c GROUP BY 1)
SELECT a.step, CAST(least AS BIGINT) AS least, CAST(most AS BIGINT) AS most, CAST(most - least AS BIGINT) AS gap, CAST(balanced_least AS BIGINT) AS balanced_least, CAST(balanced_most AS BIGINT) AS balanced_most, round(mean, 6) + 0.0 AS mean,
  balanced_most - balanced_least <= longest AS within, mean BETWEEN balanced_least AND balanced_most AS around FROM a JOIN b ON b.step = a.step""",
    R,
)
def d24(spark: SparkSession, sf: str) -> DataFrame:
    """Before and after parts are balanced by length (whole rounds, then the two sets of widest spread joined until one is left): afterwards the sums differ by the longest row at most, and lie around the mean."""
    r = _rolls(spark, sf)
    d = M.imbalance(r, "step", "sample_id", "resp_len", 4).hint("merge").join(r.groupBy("step").agg(F.max("resp_len").alias("longest")), "step")
    within, around = F.col("balanced_most") - F.col("balanced_least") <= F.col("longest"), F.col("mean").between(F.col("balanced_least"), F.col("balanced_most"))
    return d.select("step", "least", "most", "gap", "balanced_least", "balanced_most", r6("mean").alias("mean"), within.alias("within"), around.alias("around"))
