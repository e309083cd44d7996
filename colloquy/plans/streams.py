"""Streams (J1-J8). Tests compare stream and batch forms; queries with SQL are the batch forms or whole-input runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.numeric import r4, r6
from colloquy.plans.base import query
from colloquy.sources.cache import cut, shared_dir
from colloquy.sources.views import table, view
from colloquy.streaming import steps, windows

R = ("rollouts",)


def _tmp(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query("j1", "SELECT sample_id, score, step FROM rollouts", R)
def j1(spark: SparkSession, sf: str) -> DataFrame:
    """Step dumps written as JSON lines and read back as a stream."""
    path = _tmp(spark)
    view(spark, sf, "rollouts").select("sample_id", "score", "step").repartition(4, "step").write.json(path)
    return steps.run(steps.read_steps(spark, path, "sample_id long, score double, step long"), _tmp(spark))


_POINTS = "p AS (SELECT data_source AS name, step, avg(score) AS x FROM rollouts GROUP BY 1, 2)"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "rollouts").groupBy(F.col("data_source").alias("name"), "step").agg(F.avg("score").alias("x"))


@query(
    "j2",
    f"""WITH RECURSIVE {_POINTS}, k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY step) AS k FROM p),
e AS (SELECT name, step, k, x AS value FROM k WHERE k = 1 UNION ALL SELECT k.name, k.step, k.k, 0.4 * k.x + 0.6 * e.value FROM e JOIN k ON k.name = e.name AND k.k = e.k + 1)
SELECT name, step, round(value, 6) + 0.0 AS value FROM e""",
    R,
)
def j2(spark: SparkSession, sf: str) -> DataFrame:
    return steps.ewma(_points(spark, sf)).select("name", "step", r6("value").alias("value"))


@query(
    "j3",
    f"""WITH {_POINTS}, m AS (SELECT name, step, 1 + greatest(least(x / 30 - 1, 0.2), -0.2) * 10 / 100.0 AS m FROM p)
SELECT name, step, round(0.05 * exp(sum(ln(m)) OVER (PARTITION BY name ORDER BY step ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS coef FROM m""",
    R,
)
def j3(spark: SparkSession, sf: str) -> DataFrame:
    p = _points(spark, sf).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("step", F.col("x").alias("kl"), F.lit(10).alias("n")))).alias("p"))
    return p.select("name", F.explode(steps.adaptive_kl(F.col("p"), 0.05, 30.0, 100.0)).alias("e")).select("name", "e.step", r6("e.coef").alias("coef"))


@query(
    "j3_stream",
    f"""WITH {_POINTS}, k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY step) - 1 AS k FROM p), m AS (SELECT name, k, 1 + greatest(least(x / 30 - 1, 0.2), -0.2) * 10 / 100.0 AS m FROM k)
SELECT name, k AS step, round(0.05 * exp(sum(ln(m)) OVER (PARTITION BY name ORDER BY k ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS coef FROM m""",
    R,
)
def j3_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The controller over a stream of points that arrive in no order."""
    path = _tmp(spark)
    k = (F.row_number().over(Window.partitionBy("name").orderBy("step")) - 1).cast("long")
    _points(spark, sf).select("name", k.alias("step"), F.col("x").alias("kl"), F.lit(10.0).alias("n")).repartition(4, F.md5(F.col("step").cast("string"))).write.json(path)
    d = steps.run(steps.adaptive_kl_stream(steps.read_steps(spark, path, "name string, step long, kl double, n double"), 0.05, 30.0, 100.0), _tmp(spark))
    return d.where("kind = 'value'").select("name", "step", r6("value").alias("coef"))


@query(
    "j2_late",
    f"""WITH {_POINTS}, k AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY step) - 1 AS k FROM p), n AS (SELECT name, max(k) AS last FROM k GROUP BY 1)
SELECT name, kind, CASE kind WHEN 'value' THEN last - 1 WHEN 'again' THEN 1 ELSE 2 END AS n FROM n, (VALUES ('value'), ('lost'), ('late'), ('again')) v(kind)""",
    R,
)
def j2_late(spark: SparkSession, sf: str) -> DataFrame:
    """What a stream says of steps that don't come in order: steps 1 and 2 are lost when six others have waited for them, come late, and step 3 comes again."""
    path = _tmp(spark)
    k = (F.row_number().over(Window.partitionBy("name").orderBy("step")) - 1).cast("long")
    p = cut(_points(spark, sf).select("name", k.alias("step"), "x"))
    # a file a batch, by name
    for i, part in enumerate((p.where("step <> 1 AND step <> 2"), p.where("step = 2"), p.where("step = 1 OR step = 3"))):
        part.coalesce(1).write.json(f"{path}/{i}")
    stream = spark.readStream.schema("name string, step long, x double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(path)
    d = steps.run(steps.ewma_stream(stream, max_wait=5), _tmp(spark))
    return d.groupBy("name", "kind").agg(F.count("*").alias("n"))


@query(
    "j4",
    """WITH k AS (SELECT uid, step FROM rollouts GROUP BY uid, step HAVING stddev_pop(score) > 0 OR count(*) = 1), m AS (SELECT uid, min(step) AS step FROM k GROUP BY uid)
SELECT uid, step FROM m QUALIFY row_number() OVER (ORDER BY step, uid) <= 64""",
    R,
)
def j4(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of a step that pass gather over a stream's batches until there are 64."""
    path = _tmp(spark)
    view(spark, sf, "rollouts").select("uid", "score", "step").repartition(4, "step").write.json(path)
    return steps.gather_groups(steps.read_steps(spark, path, "uid string, score double, step long", files_per_batch=1000), _tmp(spark), 64, max_batches=8)


@query("j5", "SELECT sample_id, score, step FROM rollouts WHERE score >= 50", R)
def j5(spark: SparkSession, sf: str) -> DataFrame:
    """A data set that grows by each batch's rows that pass."""
    path, out = _tmp(spark), _tmp(spark)
    view(spark, sf, "rollouts").select("sample_id", "score", "step").repartition(4, "step").write.json(path)
    steps.grow(steps.read_steps(spark, path, "sample_id long, score double, step long", files_per_batch=2), out, F.col("score") >= 50)
    return spark.read.schema("sample_id long, score double, step long").parquet(f"{out}/rows").select("sample_id", "score", "step")


@query(
    "j7",
    """WITH f AS (SELECT episode_id, count(*) AS n, min(CASE WHEN action = 'diagnose' THEN turn_id END) AS d FROM episode_turns GROUP BY 1)
SELECT episode_id, least(coalesce(d + 1, n), 6) AS turns, CASE WHEN d + 1 <= 6 THEN 1.0 ELSE -2.0 END::DOUBLE AS outcome FROM f WHERE d IS NOT NULL OR n >= 6""",
    ("episode_turns",),
)
def j7(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes from a stream of turns, six at most; each gives one row when it ends."""
    path = _tmp(spark)
    view(spark, sf, "episode_turns").select("episode_id", "turn_id", "action").repartition(4, "episode_id").write.json(path)
    return steps.run(steps.episodes(steps.read_steps(spark, path, "episode_id string, turn_id long, action string", files_per_batch=1000), 6), _tmp(spark))


@query("j8_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total, max(value) AS most FROM events GROUP BY 1, 2")
def j8_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    d = windows.tumbling(table(spark, sf, "events"), "ts", "1 hour", ["event_type"], "value")
    return d.select("start", "event_type", "n", r4("total").alias("total"), "most")


@query(
    "j8_sliding",
    """SELECT start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM (
  SELECT event_type, value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) t GROUP BY 1, 2""",
)
def j8_sliding(spark: SparkSession, sf: str) -> DataFrame:
    d = windows.sliding(table(spark, sf, "events"), "ts", "1 hour", "30 minutes", ["event_type"], "value")
    return d.select("start", "event_type", "n", r4("total").alias("total"))


@query(
    "j8_session",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM s GROUP BY user_id, s""",
)
def j8_session(spark: SparkSession, sf: str) -> DataFrame:
    d = windows.sessions(table(spark, sf, "events"), "ts", "2 hours", ["user_id"], "value")
    return d.select("user_id", "start", "n", r4("total").alias("total"))


@query("j6", "SELECT uid, round(avg(score), 6) + 0.0 AS difficulty, row_number() OVER (ORDER BY round(avg(score), 6), uid) - 1 AS place FROM rollouts GROUP BY uid", R)
def j6(spark: SparkSession, sf: str) -> DataFrame:
    """Curriculum: difficulties that a stream of results keeps up to date, and prompts in their order."""
    from colloquy.operators.datasets import ranked

    path = _tmp(spark)
    view(spark, sf, "rollouts").select("uid", "score").repartition(4, "uid").write.json(path)
    d = steps.difficulty_stream(steps.read_steps(spark, path, "uid string, score double", files_per_batch=2), _tmp(spark)).select("uid", r6("difficulty").alias("difficulty"))
    return ranked(d, [F.col("difficulty"), F.col("uid")], "place")


