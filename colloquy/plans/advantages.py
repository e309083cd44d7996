"""Group-relative advantages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.numeric import r6
from colloquy.operators import advantages as A
from colloquy.operators import trees
from colloquy.plans.base import query
from colloquy.sources.views import view

R = ("rollouts",)
_W = "OVER (PARTITION BY uid)"


def _out(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*(keys or ("uid", "sample_id")), r6("advantage").alias("advantage"))


def _sql(expr: str, where: str = "") -> str:
    return f"SELECT uid, sample_id, round({expr}, 6) + 0.0 AS advantage FROM rollouts {where}"


@query("e1", _sql(f"CASE WHEN count(*) {_W} = 1 THEN score / (1 + 1e-6) ELSE (score - avg(score) {_W}) / (stddev_samp(score) {_W} + 1e-6) END"), R)
def e1(spark: SparkSession, sf: str) -> DataFrame:
    return _out(A.grpo(view(spark, sf, "rollouts")))


@query("e1_plain", _sql(f"CASE WHEN count(*) {_W} = 1 THEN score ELSE score - avg(score) {_W} END"), R)
def e1_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _out(A.estimator("grpo")(view(spark, sf, "rollouts"), norm=False))


@query(
    "e2",
    """SELECT uid, sample_id, round(CASE WHEN k = 1 THEN gap / (sd + 1e-6) ELSE 0.0 END, 6) + 0.0 AS advantage FROM (
  SELECT *, count(*) OVER (PARTITION BY uid) AS n, row_number() OVER (PARTITION BY uid ORDER BY score DESC, sample_id) AS k,
         score - lead(score) OVER (PARTITION BY uid ORDER BY score DESC, sample_id) AS gap, stddev_samp(score) OVER (PARTITION BY uid) AS sd FROM rollouts) t
WHERE n > 1""",
    R,
)
def e2(spark: SparkSession, sf: str) -> DataFrame:
    return _out(A.passk(view(spark, sf, "rollouts")))


@query(
    "e3",
    """WITH c AS (SELECT uid, sample_id, resp_len, CASE WHEN count(*) OVER (PARTITION BY uid) = 1 THEN score ELSE score - avg(score) OVER (PARTITION BY uid) END AS c FROM rollouts),
m AS (SELECT sum(c * resp_len) / (sum(resp_len) + 1e-8) AS m FROM c),
v AS (SELECT sum(resp_len * (c - m) * (c - m)) / (sum(resp_len) + 1e-8) * sum(resp_len) / (sum(resp_len) - 1) AS v FROM c, m)
SELECT uid, sample_id, round((c - m) / sqrt(v + 1e-8), 6) + 0.0 AS advantage FROM c, m, v""",
    R,
)
def e3(spark: SparkSession, sf: str) -> DataFrame:
    return _out(A.reinforce_pp_baseline(view(spark, sf, "rollouts")))


@query("e4", _sql(f"CASE WHEN count(*) {_W} = 1 THEN score ELSE CAST(count(*) {_W} AS DOUBLE) / (count(*) {_W} - 1) * (score - avg(score) {_W}) END"), R)
def e4(spark: SparkSession, sf: str) -> DataFrame:
    return _out(A.rloo(view(spark, sf, "rollouts")))


@query("e5", _sql(f"score - CASE WHEN count(*) {_W} = 1 THEN 0.0 ELSE sum(score * resp_len) {_W} / sum(resp_len) {_W} END"), R)
def e5(spark: SparkSession, sf: str) -> DataFrame:
    return _out(A.opo(view(spark, sf, "rollouts")))


@query(
    "e6",
    f"""WITH g AS (SELECT CAST(count(*) AS DOUBLE) / greatest(count(*) FILTER (WHERE score <> 0), 1) AS a FROM rollouts)
SELECT uid, sample_id, round(a * (score - CASE WHEN count(*) {_W} = 1 THEN 0.0 ELSE avg(score) {_W} END), 6) + 0.0 AS advantage FROM rollouts, g""",
    R,
)
def e6(spark: SparkSession, sf: str) -> DataFrame:
    return _out(A.gpg(view(spark, sf, "rollouts")))


@query(
    "e7",
    """SELECT sample_id, pos, round(sum(reward * mask) OVER (PARTITION BY sample_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) - 0.03 * mask, 6) + 0.0 AS advantage FROM token_logs""",
    ("token_logs",),
)
def e7(spark: SparkSession, sf: str) -> DataFrame:
    return _out(A.remax(view(spark, sf, "token_logs").withColumn("baseline", F.lit(0.03))), "sample_id", "pos")


def _arrays(df: DataFrame) -> DataFrame:
    """One row a sample, arrays in token order."""
    x = F.sort_array(F.collect_list(F.struct("pos", "reward", "value", F.col("mask").cast("double").alias("mask"))))
    d = df.groupBy("sample_id").agg(x.alias("x"))
    return d.select("sample_id", *(F.col(f"x.{c}").alias(c) for c in ("pos", "reward", "value", "mask")))


def _tokens(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("sample_id", F.explode(F.arrays_zip("pos", "mask", *cols)).alias("t")).select("sample_id", "t.pos", "t.mask", *(f"t.{c}" for c in cols))


_WHITE = """m AS (SELECT sum(x * mask) / (sum(mask) + 1e-8) AS m FROM t), v AS (SELECT sum(mask * (x - m) * (x - m)) / (sum(mask) + 1e-8) * sum(mask) / (sum(mask) - 1) AS v FROM t, m)"""


@query(
    "e8",
    """WITH b AS (SELECT sample_id, pos, reward, CAST(mask AS DOUBLE) AS mask, coalesce(lead(mask) OVER (PARTITION BY sample_id ORDER BY pos), 0) AS go FROM token_logs),
i AS (SELECT *, sum(1 - go) OVER (PARTITION BY sample_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS island FROM b),
t AS (SELECT sample_id, pos, mask, sum(reward) OVER (PARTITION BY sample_id, island ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS x FROM i),
"""
    + _WHITE
    + """
SELECT sample_id, pos, round(x, 6) + 0.0 AS returns, round((x - m) / sqrt(v + 1e-8) * mask, 6) + 0.0 AS advantage FROM t, m, v""",
    ("token_logs",),
)
def e8(spark: SparkSession, sf: str) -> DataFrame:
    t = _tokens(A.reinforce_pp(_arrays(view(spark, sf, "token_logs"))), "returns")
    w = A.whiten_weighted(t, "returns", "mask", "advantage")
    return w.select("sample_id", "pos", r6("returns").alias("returns"), r6(F.col("advantage") * F.col("mask")).alias("advantage"))


@query(
    "e9",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS k,
                  reward + coalesce(lead(value) OVER (PARTITION BY sample_id ORDER BY pos), 0) - value AS d FROM token_logs WHERE mask = 1),
g AS (SELECT sample_id, pos, sum(power(0.95, k) * d) OVER (PARTITION BY sample_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) / power(0.95, k) AS g FROM s),
t AS (SELECT l.sample_id, l.pos, CAST(l.mask AS DOUBLE) AS mask, l.value,
             coalesce(first_value(g.g IGNORE NULLS) OVER (PARTITION BY l.sample_id ORDER BY l.pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS x
      FROM token_logs l LEFT JOIN g ON l.sample_id = g.sample_id AND l.pos = g.pos),
"""
    + _WHITE
    + """
SELECT sample_id, pos, round(x + value, 6) + 0.0 AS returns, round((x - m) / sqrt(v + 1e-8), 6) + 0.0 AS advantage FROM t, m, v""",
    ("token_logs",),
)
def e9(spark: SparkSession, sf: str) -> DataFrame:
    t = _tokens(A.gae(_arrays(view(spark, sf, "token_logs"))).withColumnRenamed("advantage", "x"), "x", "returns")
    w = A.whiten_weighted(t, "x", "mask", "advantage")
    return w.select("sample_id", "pos", r6("returns").alias("returns"), r6("advantage").alias("advantage"))


@query(
    "e10",
    """WITH t AS (SELECT uid, episode_id, turn_id, action, CASE WHEN action = 'diagnose' THEN 0.0 ELSE length(fact) % 3 / 2.0 END AS reward FROM episode_turns),
o AS (SELECT uid, episode_id, sum(reward) AS outcome FROM t GROUP BY uid, episode_id),
d AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY uid) > 1 THEN (outcome - avg(outcome) OVER (PARTITION BY uid)) / (stddev_samp(outcome) OVER (PARTITION BY uid) + 1e-6) ELSE 0.0 END AS diag,
             count(*) OVER (PARTITION BY uid) = 1 AS single FROM o),
a AS (SELECT *, CASE WHEN action <> 'diagnose' AND count(*) OVER (PARTITION BY uid, turn_id, action = 'diagnose') > 1
                     THEN (reward - avg(reward) OVER (PARTITION BY uid, turn_id, action = 'diagnose')) / (stddev_samp(reward) OVER (PARTITION BY uid, turn_id, action = 'diagnose') + 1e-6) ELSE 0.0 END AS turn FROM t)
SELECT a.episode_id, a.turn_id, round(CASE WHEN single THEN 0.0 WHEN action = 'diagnose' THEN 1.2 * diag ELSE diag + 0.5 * turn END, 6) + 0.0 AS turn_advantage
FROM a JOIN d ON a.uid = d.uid AND a.episode_id = d.episode_id""",
    ("episode_turns",),
)
def e10(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "episode_turns")
    t = t.withColumn("reward", F.when(F.col("action") == "diagnose", F.lit(0.0)).otherwise(F.length("fact") % 3 / 2.0))
    out = A.turn_advantage(t.withColumn("outcome", F.sum("reward").over(Window.partitionBy("uid", "episode_id"))))
    return out.select("episode_id", "turn_id", r6("turn_advantage").alias("turn_advantage"))


@query("e12", "SELECT uid, sample_id, round(CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - m) / (s + 1e-6) END, 6) + 0.0 AS advantage FROM (SELECT uid, sample_id, score, count(*) OVER w AS n, avg(score) OVER w AS m, stddev_samp(score) OVER w AS s FROM rollouts WINDOW w AS (PARTITION BY uid)) t", R)
def e12(spark: SparkSession, sf: str) -> DataFrame:
    """A log without turns: the outcome's advantage."""
    d = A.turn_or_outcome(view(spark, sf, "rollouts").withColumnRenamed("score", "outcome"))
    return d.select("uid", "sample_id", r6("turn_advantage").alias("advantage"))


@query(
    "e13",
    """WITH l AS (SELECT sample_id, sample_id % 300 AS uid, pos, mask, reward, CAST(sample_id % 2 AS DOUBLE) AS acc FROM token_logs),
q AS (SELECT uid, sample_id, sum(reward * mask) / (sum(mask) + 1e-8) AS mean, max(acc) AS acc, max(CASE WHEN mask <> 0 THEN pos END) AS last FROM l GROUP BY 1, 2),
g AS (SELECT *, count(*) OVER w AS n, sum(mean) OVER w AS sm, sum(acc) OVER w AS sa FROM q WINDOW w AS (PARTITION BY uid)),
c AS (SELECT l.sample_id, l.pos, l.mask,
  CASE WHEN l.mask <> 0 THEN 5 * CASE WHEN n = 1 THEN l.reward ELSE l.reward * n / (n - 1) - sm / (n - 1) END ELSE 0 END
  + CASE WHEN l.pos = g.last THEN 5 * CASE WHEN n = 1 THEN g.acc ELSE g.acc * n / (n - 1) - sa / (n - 1) END ELSE 0 END AS r FROM l JOIN g ON g.sample_id = l.sample_id),
t AS (SELECT sample_id, pos, CAST(mask AS DOUBLE) AS mask, sum(r) OVER (PARTITION BY sample_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS x FROM c),
"""
    + _WHITE
    + """
SELECT sample_id, pos, round(x, 6) + 0.0 AS returns, round((x - m) / sqrt(v + 1e-8), 6) + 0.0 AS advantage FROM t, m, v""",
    ("token_logs",),
)
def e13(spark: SparkSession, sf: str) -> DataFrame:
    """Leave-one-out on token rewards and on the outcome at the last valid token, accumulated from the end, whitened."""
    t = view(spark, sf, "token_logs").withColumns({"uid": F.col("sample_id") % 300, "acc": (F.col("sample_id") % 2).cast("double")})
    d = A.prime_rloo(t)
    return d.select("sample_id", "pos", r6("returns").alias("returns"), r6("advantage").alias("advantage"))


@query(
    "e14",
    """WITH t AS (SELECT sample_id, pos, sum(reward) OVER (PARTITION BY sample_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS r FROM token_logs),
m AS (SELECT max(abs(r)) AS m FROM t)
SELECT sample_id, pos, round(r / m, 6) + 0.0 AS advantage FROM t, m""",
    ("token_logs",),
)
def e14(spark: SparkSession, sf: str) -> DataFrame:
    back = Window.partitionBy("sample_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    d = A.with_global(view(spark, sf, "token_logs").withColumn("r", F.sum("reward").over(back)), m=F.max(F.abs("r")))
    return _out(d.withColumn("advantage", F.col("r") / F.col("m")), "sample_id", "pos")


_TREE = """WITH RECURSIVE kids AS (SELECT tree_id, parent_id AS node_id, count(*) AS kids FROM tree_nodes WHERE parent_id IS NOT NULL GROUP BY 1, 2),
up AS (
  SELECT tree_id, node_id, parent_id, CAST(action_reward AS DOUBLE) AS r, CAST(0 AS DOUBLE) AS got, CAST(1 AS DOUBLE) AS weight FROM tree_nodes WHERE is_terminal
  UNION ALL
  SELECT u.tree_id, n.node_id, n.parent_id, CAST(n.action_reward AS DOUBLE), u.got + u.r, u.weight / k.kids
  FROM up u JOIN tree_nodes n ON n.tree_id = u.tree_id AND n.node_id = u.parent_id JOIN kids k ON k.tree_id = n.tree_id AND k.node_id = n.node_id),
v AS (SELECT tree_id, node_id, sum(weight * got) AS v, count(*) AS visits FROM up GROUP BY 1, 2)
"""


@query(
    "e15",
    _TREE
    + """SELECT n.tree_id, n.node_id, round(v.v, 6) + 0.0 AS value, CAST(v.visits AS BIGINT) AS visits,
       round(CASE WHEN n.parent_id IS NULL THEN NULL WHEN k.kids = 1 THEN n.action_reward + n.critic_value - p.critic_value ELSE n.action_reward + v.v - pv.v END / greatest(v.visits, 1), 6) + 0.0 AS advantage
FROM tree_nodes n JOIN v ON n.tree_id = v.tree_id AND n.node_id = v.node_id
LEFT JOIN tree_nodes p ON p.tree_id = n.tree_id AND p.node_id = n.parent_id
LEFT JOIN v pv ON pv.tree_id = n.tree_id AND pv.node_id = n.parent_id
LEFT JOIN kids k ON k.tree_id = n.tree_id AND k.node_id = n.parent_id""",
    ("tree_nodes",),
)
def e15(spark: SparkSession, sf: str) -> DataFrame:
    t = trees.backup(view(spark, sf, "tree_nodes"))
    return t.select("tree_id", "node_id", r6("value").alias("value"), "visits", r6("advantage").alias("advantage"))


@query(
    "e16",
    """WITH k AS (SELECT *, var_pop(critic_value) OVER w AS v, avg(critic_value) OVER w AS q, count(*) OVER w AS n, row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY md5(concat('7|', CAST(tree_id AS VARCHAR), '|', CAST(node_id AS VARCHAR)))) AS k
  FROM tree_nodes WHERE parent_id IS NOT NULL WINDOW w AS (PARTITION BY tree_id, parent_id)),
g AS (SELECT DISTINCT tree_id, parent_id, level - 1 AS pl, v FROM k WHERE n > 1),
s AS (SELECT pl, avg(v) AS m, stddev_pop(v) AS s FROM g WHERE pl % 2 = 0 GROUP BY 1), a AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM g),
z AS (SELECT k.*, p.critic_value AS pc, CASE WHEN s.m IS NOT NULL THEN (v - s.m) / (s.s + 1e-7) ELSE (v - a.m) / (a.s + 1e-7) END AS z,
  CAST(('0x' || substr(md5(concat('7u|', CAST(k.tree_id AS VARCHAR), '|', CAST(k.parent_id AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0 AS u
  FROM k JOIN tree_nodes p ON p.tree_id = k.tree_id AND p.node_id = k.parent_id LEFT JOIN s ON s.pl = p.level, a)
SELECT tree_id, node_id FROM z WHERE NOT (n > 1 AND 0.3 * z + 0.7 * abs(pc - q) < 0.1 AND u < 0.9) OR k = 1""",
    ("tree_nodes",),
)
def e16(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of every other level; the rest take those of all levels."""
    n = view(spark, sf, "tree_nodes")
    stats = trees.sibling_statistics(n).where("level IS NULL OR level % 2 = 0")
    return trees.prune_siblings(n, threshold=0.1, stats=stats).select("tree_id", "node_id")


@query(
    "d29",
    """SELECT uid, round(ln(avg(exp(0.5 * (score - top)))) / 0.5 + max(top), 6) + 0.0 AS softmean FROM (SELECT uid, score, max(score) OVER (PARTITION BY uid) AS top FROM rollouts) t GROUP BY uid""",
    R,
)
def d29(spark: SparkSession, sf: str) -> DataFrame:
    return A.softmean_by(view(spark, sf, "rollouts"), "uid", "score", 0.5).select("uid", r6("softmean").alias("softmean"))
