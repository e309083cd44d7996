"""Step-ordered streams: logs as a source, statistics and controllers that evolve a step at a time.

Event time doesn't exist here; order is the step. State keeps the next step it waits for
and, a row each, the steps that came early. Such streams need Spark's RocksDB state store
(:func:`keyed_state`; :func:`run` sees to it).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.functions.folds import scan
from colloquy.operators.datasets import first_n

ALPHA = 0.4


def read_steps(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A folder that gets a JSON-lines file a step, as an append-only source."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state by key on each executor's disk, with what they change in their checkpoint; the session's own store comes back after."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old) if old else spark.conf.unset(_PROVIDER)


def run(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Everything there is now, through a checkpointed parquet sink; returns the sink as a table."""
    with keyed_state(stream.sparkSession):
        sink = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/checkpoint")
        sink.trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def ewma_fold(points: Column, alpha: float = ALPHA) -> Column:
    """array<struct<step, x>> in order -> array<struct<step, value>>: the first x seeds, NaN and null leave the value."""

    def step(a: Column, p: Column) -> tuple[dict[str, Column], Column]:
        x = F.nanvl(p["x"], F.lit(None).cast("double"))
        v = F.when(x.isNull(), a["v"]).when(a["v"].isNull(), x).otherwise(alpha * x + (1 - alpha) * a["v"])
        return {"v": v}, F.struct(p["step"].alias("step"), v.alias("value"))

    return scan(points, {"v": F.lit(None).cast("double")}, step, "struct<step:bigint,value:double>")


def ewma(df: DataFrame, name: str = "name", step: str = "step", x: str = "x", alpha: float = ALPHA) -> DataFrame:
    """Batch form: name, step, value. A name has one point a step."""
    p = F.sort_array(F.collect_list(F.struct(F.col(step).cast("long").alias("step"), F.col(x).cast("double").alias("x"))))
    return df.groupBy(name).agg(p.alias("p")).select(name, F.explode(ewma_fold(F.col("p"), alpha)).alias("e")).select(name, "e.step", "e.value")


def ewma_stream(stream: DataFrame, first_step: int = 0, alpha: float = ALPHA, max_wait: int = 256) -> DataFrame:
    """Stream form of :func:`ewma` on stream(name, step, x): name, step, value, kind, as :class:`InOrder` gives them."""

    def update(value: float | None, x: list[float | None]) -> float | None:
        return value if x[0] is None else x[0] if value is None else alpha * x[0] + (1 - alpha) * value

    return _stateful(stream, InOrder(update, None, first_step, ["x"], max_wait), ["x"])


def _next_coef(v, kl, n, target: float, horizon: float, limit: float):
    return v * (1 + max(min(kl / target - 1, limit), -limit) * n / horizon)


def adaptive_kl(points: Column, start: float, target: float, horizon: float, limit: float = 0.2) -> Column:
    """array<struct<step, kl, n>> in order -> array<struct<step, coef>>: the coefficient after each step, moved by the clipped relative error."""

    def step(a: Column, p: Column) -> tuple[dict[str, Column], Column]:
        error = F.greatest(F.least(p["kl"] / target - 1, F.lit(limit)), F.lit(-limit))
        v = a["v"] * (1 + error * p["n"] / horizon)
        return {"v": v}, F.struct(p["step"].alias("step"), v.alias("coef"))

    return scan(points, {"v": F.lit(start)}, step, "struct<step:bigint,coef:double>")


class InOrder(StatefulProcessor):
    """name, step, value, kind for each step of a key, in order, whatever order they come in.

    Steps that come early are rows of a map in the key's state, which are written and read one by one; when more than
    ``max_wait`` of them wait for missing steps, those are given up, so a lost step cannot stop a stream. Nothing goes
    unsaid: kind is ``value``; ``lost`` for a step that is given up, with the value that stands; ``late`` for one that comes after
    that; ``again`` for one that has been there (the first counts). The state is the next step, the value, at
    most ``max_wait`` waiting steps, and the steps that are lost and have not come.
    """

    def __init__(self, update: Callable[[Any, list[float | None]], Any], start: Any, first_step: int, columns: list[str], max_wait: int):
        self.update, self.start, self.first_step, self.columns, self.max_wait = update, start, first_step, columns, max_wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "want long, value double, waiting long")
        self.early = handle.getMapState("early", "step long", ", ".join(f"{c} double" for c in self.columns))
        self.lost = handle.getMapState("lost", "step long", "since long")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        want, value, waiting = self.at.get() if self.at.exists() else (self.first_step, self.start, 0)
        new, out = {}, []
        for pdf in rows:
            for step, *x in pdf[["step", *self.columns]].itertuples(index=False):
                step = int(step)
                if step < want:
                    late = self.lost.containsKey((step,))
                    if late:
                        self.lost.removeKey((step,))
                    out.append((key[0], step, value, "late" if late else "again"))
                elif step in new or waiting and self.early.containsKey((step,)):
                    out.append((key[0], step, value, "again"))
                else:
                    new[step] = tuple(None if pd.isna(v) else float(v) for v in x)
        while new or waiting:
            if want in new:
                x = new.pop(want)
            elif waiting and self.early.containsKey((want,)):
                x, waiting = tuple(self.early.getValue((want,))), waiting - 1
                self.early.removeKey((want,))
            elif len(new) + waiting > self.max_wait:
                ready = min([*new, *((k[0] for k in self.early.keys()) if waiting else ())])
                for step in range(want, ready):
                    self.lost.updateValue((step,), (want,))
                    out.append((key[0], step, value, "lost"))
                want = ready
                continue
            else:
                break
            value = self.update(value, x)
            out.append((key[0], want, value, "value"))
            want += 1
        for step, x in new.items():
            self.early.updateValue((step,), x)
        self.at.update((want, value, waiting + len(new)))
        yield pd.DataFrame(out, columns=["name", "step", "value", "kind"])

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, processor: StatefulProcessor, columns: list[str]) -> DataFrame:
    rows = stream.select("name", F.col("step").cast("long").alias("step"), *(F.col(c).cast("double").alias(c) for c in columns))
    return rows.groupBy("name").transformWithStateInPandas(statefulProcessor=processor, outputStructType="name string, step long, value double, kind string", outputMode="append", timeMode="none")


def adaptive_kl_stream(stream: DataFrame, start: float, target: float, horizon: float, limit: float = 0.2, first_step: int = 0, max_wait: int = 256) -> DataFrame:
    """Stream form of :func:`adaptive_kl` on stream(name, step, kl, n): name, step, value, kind, as :class:`InOrder` gives them."""
    update = lambda v, x: _next_coef(v, x[0], x[1], target, horizon, limit)
    return _stateful(stream, InOrder(update, start, first_step, ["kl", "n"], max_wait), ["kl", "n"])


def gather_groups(stream: DataFrame, path: str, target: int, max_batches: int, group: str = "uid", step: str = "step", metric: str = "score") -> DataFrame:
    """Each batch's groups whose metric varies (or of one row) are kept, with their first step, until there are ``target`` of them; the first by (step, group) count. More batches than ``max_batches`` without reaching it are an error.

    A batch writes the groups that are new with it to a folder of its own, so a batch tried again is not counted
    twice, a group that comes in several batches counts at the first, and how many there are is a sum of the files' counts.
    """
    spark, schema = stream.sparkSession, f"{group} string, {step} long, batch long"

    def have() -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/rows").drop("batch")

    def put(df: DataFrame, batch: int) -> None:
        before = spark.read.schema(schema).parquet(f"{path}/rows").where(F.col("batch") < batch) if batch else None
        if batch and before.count() >= target:  # of the files' own counts
            return
        if batch >= max_batches:
            raise RuntimeError(f"{max_batches} batches gave fewer than {target} groups")
        g = df.groupBy(F.col(group).cast("string").alias(group)).agg(F.stddev_pop(metric).alias("s"), F.count("*").alias("n"), F.min(step).cast("long").alias(step))
        g = g.where("s > 0 OR n = 1").select(group, step)
        g = g.join(before.select(group), group, "left_anti") if batch else g
        g.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = have()
    if got.count() < target:
        raise RuntimeError(f"the stream ended with fewer than {target} groups")
    return first_n(got, [F.col(step), F.col(group)], target)


def difficulty_stream(stream: DataFrame, path: str, group: str = "uid", metric: str = "score") -> DataFrame:
    """Curriculum: group, difficulty (mean of the metric over all batches so far), n. Each batch adds its sums in a folder of its own."""

    def put(df: DataFrame, batch: int) -> None:
        df.groupBy(group).agg(F.sum(metric).alias("s"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    d = stream.sparkSession.read.schema(f"{group} string, s double, n long").parquet(f"{path}/rows")
    return d.groupBy(group).agg((F.sum("s") / F.sum("n")).alias("difficulty"), F.sum("n").alias("n"))


def grow(stream: DataFrame, path: str, keep: Column) -> None:
    """Append each batch's rows that pass to a table, once a batch even if it is tried again: a batch has its own folder."""

    def put(df: DataFrame, batch: int) -> None:
        df.where(keep).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


FINAL = ("diagnose", "answer", "final_answer")


#: Keys of the state of :func:`episodes`.
BUCKETS = 1 << 12


class Episodes(StatefulProcessor):
    """See :func:`episodes`. The key is a bucket of episodes; its open ones are written anew with each batch that has turns of it, marks of done ones are appended and read."""

    def __init__(self, max_turns: int, reward_final: float, reward_timeout: float, idle_ms: int | None):
        self.max_turns, self.reward_final, self.reward_timeout, self.idle_ms = max_turns, reward_final, reward_timeout, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "episode_id string, turns long, at long")
        # without a time to live they stay, so that late turns never open an episode again
        self.done = handle.getListState("done", "episode_id string", ttlDurationMs=self.idle_ms) if self.idle_ms else handle.getListState("done", "episode_id string")

    def _keep(self, open_: dict[str, tuple[int, int]]) -> None:
        self.open.put([(e, *x) for e, x in open_.items()]) if open_ else self.open.clear()
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if open_:
                self.handle.registerTimer(min(at for _, at in open_.values()) + self.idle_ms)

    def _rows(self, ended: list[tuple[str, int, float]]) -> pd.DataFrame:
        return pd.DataFrame(ended, columns=["episode_id", "turns", "outcome"])

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came: dict[str, list[tuple[int, str]]] = {}  # a batch's turns by episode
        for pdf in rows:
            for e, *turn in zip(pdf["episode_id"].tolist(), pdf["turn_id"].tolist(), pdf["action"].tolist(), strict=True):
                came.setdefault(e, []).append(tuple(turn))
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else 0
        open_, done, ended = {e: (n, at) for e, n, at in self.open.get()}, {e for (e,) in self.done.get()}, []
        for e, turns in came.items():
            if e in done:
                continue
            seen = open_.pop(e, (0, 0))[0]
            for _, action in sorted(turns, key=lambda t: (t[0] is None or t[0] != t[0], t[0])):
                seen += 1
                if action in FINAL or seen >= self.max_turns:
                    ended.append((e, seen, self.reward_final if action in FINAL else self.reward_timeout))
                    break
            else:
                open_[e] = (seen, now)
        self._keep(open_)
        if ended:
            self.done.appendList([(e,) for e, _, _ in ended])
            yield self._rows(ended)

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() - self.idle_ms
        open_ = {e: (n, at) for e, n, at in self.open.get()}
        self._keep({e: x for e, x in open_.items() if x[1] > due})
        quiet = [(e, n, self.reward_timeout) for e, (n, at) in open_.items() if at <= due]
        if quiet:
            yield self._rows(quiet)

    def close(self) -> None:
        pass


def episodes(stream: DataFrame, max_turns: int, reward_final: float = 1.0, reward_timeout: float = -2.0, idle_ms: int | None = None) -> DataFrame:
    """stream(episode_id, turn_id, action) -> episode_id, turns, outcome, once an episode: at its final action, or when its turns have run out, or when nothing came for ``idle_ms``.

    An open episode's state is a number and a time; one that is done leaves a mark, which lives for ``idle_ms``, so that
    late turns don't open it again. Without ``idle_ms`` there is no timer, and marks stay. Episodes are many and short, and
    each call of the state is a trip to the store, so the state's key is one of BUCKETS buckets of episodes: trips don't grow with the episodes.
    """
    rows = stream.select(F.pmod(F.xxhash64("episode_id"), F.lit(BUCKETS)).alias("bucket"), "episode_id", F.col("turn_id").cast("long").alias("turn_id"), "action")
    processor = Episodes(max_turns, reward_final, reward_timeout, idle_ms)
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType="episode_id string, turns long, outcome double", outputMode="append", timeMode="processingTime" if idle_ms else "none")
