"""Filters, samples, orders, balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.numeric import r6
from colloquy.operators import datasets as DS
from colloquy.operators import sampling as S
from colloquy.plans.base import query
from colloquy.sources.views import table, view

R = ("rollouts",)


def _rolls(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "rollouts")


def _h(seed: str, col: str) -> str:
    return f"md5('{seed}|' || CAST({col} AS VARCHAR))"


@query("b13", "SELECT uid, sample_id FROM (SELECT *, stddev_pop(score) OVER (PARTITION BY uid) AS s, count(*) OVER (PARTITION BY uid) AS n FROM rollouts) t WHERE s > 0 OR n = 1", R)
def b13(spark: SparkSession, sf: str) -> DataFrame:
    return S.informative(_rolls(spark, sf)).select("uid", "sample_id")


@query(
    "b14",
    """WITH g AS (SELECT uid, avg(score) BETWEEN 30 AND 70 AND max(resp_len) < 89 AS ok FROM rollouts GROUP BY uid),
r AS (SELECT uid FROM g QUALIFY row_number() OVER (ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, uid) <= (SELECT count(*) // 2 FROM g))
SELECT uid, sample_id FROM rollouts WHERE uid IN (SELECT uid FROM r)""",
    R,
)
def b14(spark: SparkSession, sf: str) -> DataFrame:
    return S.band_sample(_rolls(spark, sf), "uid", "score", "resp_len", 30, 70, 90, 2.0).select("uid", "sample_id")


@query("c16", "SELECT 1000 AS draws, 1000 AS answered, true AS inside, true AS heavier FROM (SELECT count(*) FROM rollouts) t", R)
def c16(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of 1000 draws: each finds one row, whose weight is above 0, and the rows drawn weigh more than rows do on average."""
    d = S.weights(_rolls(spark, sf).select("sample_id", "score"), "pow", 2.0)
    got = S.resample(d, "sample_id", "weight", 1000, "5")
    mean = F.broadcast(d.agg(F.avg("weight").alias("mean")))
    g = got.crossJoin(mean).agg(F.count("*").cast("int").alias("draws"), F.count_distinct("draw").cast("int").alias("answered"), F.bool_and(F.col("weight") > 0).alias("inside"), (F.avg("weight") > F.max("mean")).alias("heavier"))
    return g


@query(
    "c16_draws",
    """WITH w AS (SELECT sample_id, power(abs(score), 2) AS w FROM rollouts), c AS (SELECT sample_id, w, sum(w) OVER (ORDER BY sample_id ROWS UNBOUNDED PRECEDING) AS hi, sum(w) OVER () AS t FROM w),
u AS (SELECT i AS draw, CAST(('0x' || substr(md5('5|' || CAST(i AS VARCHAR)), 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM range((SELECT count(*) FROM rollouts)) r(i))
SELECT draw, sample_id FROM u JOIN c ON u.u >= (hi - w) / t AND u.u < hi / t""",
    R,
)
def c16_draws(spark: SparkSession, sf: str) -> DataFrame:
    """As many draws as rows."""
    d = S.weights(_rolls(spark, sf).select("sample_id", "score"), "pow", 2.0)
    return S.resample(d, "sample_id", "weight", d.count(), "5").select("draw", "sample_id")


@query("f18", "SELECT sample_id, round(power(abs(score), 2), 6) + 0.0 AS pow, CASE WHEN score IN ((SELECT max(score) FROM rollouts), (SELECT min(score) FROM rollouts)) THEN 1.0::DOUBLE ELSE 0.0 END AS max_min FROM rollouts", R)
def f18(spark: SparkSession, sf: str) -> DataFrame:
    d = S.weights(_rolls(spark, sf), "pow", 2.0).withColumnRenamed("weight", "pow")
    return S.weights(d, "max_min").select("sample_id", r6("pow").alias("pow"), F.col("weight").alias("max_min"))


@query("f2", f"SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY {_h('42', 'sample_id')}, sample_id) <= (SELECT greatest(CAST(floor(count(*) * 0.1) AS BIGINT), 1) FROM rollouts) THEN 'val' ELSE 'train' END AS split FROM rollouts", R)
def f2(spark: SparkSession, sf: str) -> DataFrame:
    return DS.ratio_split(_rolls(spark, sf).select("sample_id"), "sample_id", 0.1, "42").select("sample_id", "split")


@query(
    "f5",
    f"""WITH a AS (SELECT sample_id, pred FROM rollouts WHERE data_source = 'src_a' QUALIFY row_number() OVER (ORDER BY {_h('80', 'sample_id')}, sample_id) <= round_even((SELECT count(*) FROM rollouts WHERE data_source = 'src_a') * 0.5, 0)),
b AS (SELECT sample_id, pred FROM rollouts WHERE data_source = 'src_b' QUALIFY row_number() OVER (ORDER BY {_h('81', 'sample_id')}, sample_id) <= round_even((SELECT count(*) FROM rollouts WHERE data_source = 'src_b') * 0.25, 0))
SELECT * FROM a UNION ALL SELECT * FROM b""",
    R,
)
def f5(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda s: _rolls(spark, sf).where(F.col("data_source") == s).select("sample_id", "pred")
    return DS.mix([(part("src_a"), 0.5), (part("src_b"), 0.25)], "sample_id", "8")


@query(
    "f6",
    f"""SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_size <= 5 THEN 0 ELSE 1 END AS f FROM part) t ORDER BY f, {_h('9', 'p_partkey')}, p_partkey LIMIT 60""",
)
def f6(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return DS.fill_sample(p.where("p_size <= 5").select("p_partkey"), p.where("p_size > 5").select("p_partkey"), "p_partkey", 60, "9")


@query("f7", f"SELECT event_id FROM events WHERE event_type = 'click' ORDER BY {_h('6', 'event_id')}, event_id LIMIT 25")
def f7(spark: SparkSession, sf: str) -> DataFrame:
    return DS.sample_n(table(spark, sf, "events").where("event_type = 'click'").select("event_id"), "event_id", 25, "6")


@query("f8", "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) <= (SELECT count(*) * 3 // 4 FROM events) THEN 'head' ELSE 'tail' END AS part FROM events")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id")
    n = F.broadcast(e.agg(F.floor(F.count("*") * 3 / 4).alias("n")))
    return DS.ranked(e, [F.col("event_id")]).crossJoin(n).select("event_id", F.when(F.col("rank") < F.col("n"), "head").otherwise("tail").alias("part"))


@query("f10", "SELECT sample_id FROM rollouts ORDER BY uid, sample_id LIMIT 512", R)
def f10(spark: SparkSession, sf: str) -> DataFrame:
    return DS.first_n(_rolls(spark, sf).select("uid", "sample_id"), [F.col("uid"), F.col("sample_id")], 512).select("sample_id")


@query("f10_half", "SELECT sample_id FROM rollouts QUALIFY row_number() OVER (ORDER BY uid, sample_id) <= (SELECT count(*) // 2 FROM rollouts)", R)
def f10_half(spark: SparkSession, sf: str) -> DataFrame:
    """A batch as large as half of the table."""
    r = _rolls(spark, sf).select("uid", "sample_id")
    return DS.first_n(r, [F.col("uid"), F.col("sample_id")], r.count() // 2).select("sample_id")


@query("f12", "SELECT row_number() OVER (ORDER BY score, sample_id) - 1 AS pos, sample_id FROM rollouts", R)
def f12(spark: SparkSession, sf: str) -> DataFrame:
    """The order to move rows to, by a distributed exact rank."""
    return DS.ranked(_rolls(spark, sf).select("sample_id", "score"), [F.col("score"), F.col("sample_id")]).select(F.col("rank").alias("pos"), "sample_id")


@query(
    "f15",
    "SELECT CAST(e AS INTEGER) AS epoch, sample_id, row_number() OVER (PARTITION BY e ORDER BY md5('2|' || CAST(e AS VARCHAR) || '|' || CAST(sample_id AS VARCHAR)), sample_id) - 1 AS place FROM rollouts, range(2) r(e)",
    R,
)
def f15(spark: SparkSession, sf: str) -> DataFrame:
    return S.epoch_order(_rolls(spark, sf).select("sample_id"), "sample_id", 2, "2", 64).select("epoch", "sample_id", "place")


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of 512 rows, as many as the table gives."""
    return _rolls(spark, sf).withColumn("step", F.floor(F.col("sample_id") / 512))


@query("f13", "SELECT CAST(sample_id // 512 AS BIGINT) AS step, count(*) AS n, CAST(sum(resp_len) AS BIGINT) AS total, true AS balanced FROM rollouts GROUP BY 1", R)
def f13(spark: SparkSession, sf: str) -> DataFrame:
    """Four parts a step; they hold every row once, and their sums differ by less than the longest row."""
    r = _steps(spark, sf)
    parts = S.balanced(r, "step", "sample_id", "resp_len", 4).withColumnRenamed("row", "sample_id")
    s = parts.hint("merge").join(r.select("step", "sample_id", "resp_len"), ["step", "sample_id"]).groupBy("step", "part").agg(F.count("*").alias("n"), F.sum("resp_len").alias("s"), F.max("resp_len").alias("longest"))
    return s.groupBy("step").agg(F.sum("n").alias("n"), F.sum("s").alias("total"), (F.max("s") - F.min("s") <= F.max("longest")).alias("balanced"))


@query("f13_whole", "SELECT count(*) AS n, CAST(sum(resp_len) AS BIGINT) AS total, true AS balanced, count(*) - count(*) % 8 AS n_equal, true AS equal_counts, true AS equal_balanced FROM rollouts", R)
def f13_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The whole table in eight parts, and all but its last few rows in eight parts of as many rows each."""
    r = _rolls(spark, sf).select("sample_id", "resp_len")
    n = F.broadcast(r.agg((F.count("*") - F.count("*") % 8).alias("_n")))
    some = DS.ranked(r, [F.col("sample_id")]).crossJoin(n).where("rank < _n").select("sample_id", "resp_len")

    def sums(rows: DataFrame, equal: bool) -> DataFrame:
        parts = S.balanced(rows, None, "sample_id", "resp_len", 8, equal).select(F.col("row").alias("sample_id"), "part")
        g = parts.hint("merge").join(rows, "sample_id").groupBy("part").agg(F.count("*").alias("n"), F.sum("resp_len").alias("s"), F.max("resp_len").alias("longest"))
        return g.agg(F.sum("n").alias("n"), F.sum("s").alias("total"), (F.max("s") - F.min("s") <= F.max("longest")).alias("balanced"), (F.max("n") == F.min("n")).alias("same"))

    a, b = sums(r, False), sums(some, True)
    return a.select("n", "total", "balanced").crossJoin(F.broadcast(b.select(F.col("n").alias("n_equal"), F.col("same").alias("equal_counts"), F.col("balanced").alias("equal_balanced"))))


@query(
    "f13_serpentine",
    """WITH r AS (SELECT sample_id, row_number() OVER (ORDER BY resp_len DESC, sample_id) - 1 AS k FROM rollouts)
SELECT sample_id, CAST(CASE WHEN (k // 8) % 2 = 0 THEN k % 8 ELSE 7 - k % 8 END AS INTEGER) AS part FROM r""",
    R,
)
def f13_serpentine(spark: SparkSession, sf: str) -> DataFrame:
    return S.serpentine(_rolls(spark, sf).select("sample_id", "resp_len"), "resp_len", "sample_id", 8).select("sample_id", "part")


@query(
    "f14",
    """SELECT CAST(sample_id // 512 AS BIGINT) AS step, count(*) AS n, CAST(sum(resp_len) AS BIGINT) AS total, CAST(ceil(ceil(sum(resp_len) / 2048.0) / 2) * 2 AS BIGINT) AS batches, true AS within, true AS heavy_first, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS places FROM rollouts GROUP BY 1""",
    R,
)
def f14(spark: SparkSession, sf: str) -> DataFrame:
    """Batches a step, an even number: every row once, about equal sums, the heaviest first, and places that restore the order."""
    r = _steps(spark, sf)
    b = S.micro_batches(r, "step", "sample_id", "resp_len", 2048, divisor=2).withColumnRenamed("row", "sample_id")
    d = b.hint("merge").join(r.select("step", "sample_id", "resp_len"), ["step", "sample_id"]).groupBy("step", "batch").agg(F.count("*").alias("n"), F.sum("resp_len").alias("s"), F.sum(F.col("resp_len") * F.col("resp_len")).alias("w"), F.sum("place").alias("p"))
    later = F.lead("w").over(Window.partitionBy("step").orderBy("batch"))
    d = d.withColumn("down", F.coalesce(later <= F.col("w"), F.lit(True)))
    return d.groupBy("step").agg(F.sum("n").alias("n"), F.sum("s").alias("total"), F.count("*").alias("batches"), (F.max("s") <= 2048).alias("within"), F.bool_and("down").alias("heavy_first"), F.sum("p").alias("places"))


@query("f15_sequential", "SELECT CAST(e AS INTEGER) AS epoch, sample_id, row_number() OVER (PARTITION BY e ORDER BY sample_id) - 1 AS place FROM rollouts, range(2) r(e)", R)
def f15_sequential(spark: SparkSession, sf: str) -> DataFrame:
    return S.epoch_order(_rolls(spark, sf).select("sample_id"), "sample_id", 2, "2", 64, by=[F.col("sample_id")]).select("epoch", "sample_id", "place")


@query("f15_curriculum", "SELECT CAST(e AS INTEGER) AS epoch, sample_id, row_number() OVER (PARTITION BY e ORDER BY d, sample_id) - 1 AS place FROM (SELECT sample_id, round(avg(score) OVER (PARTITION BY uid), 6) AS d FROM rollouts) t, range(2) r(e)", R)
def f15_curriculum(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts by their difficulty so far."""
    r = _rolls(spark, sf)
    d = r.select("uid", "sample_id").hint("merge").join(r.groupBy("uid").agg(F.round(F.avg("score"), 6).alias("difficulty")), "uid").drop("uid")
    return S.epoch_order(d, "sample_id", 2, "2", 64, by=[F.col("difficulty"), F.col("sample_id")]).select("epoch", "sample_id", "place")
