"""Event-time windows; the same functions run on tables and on streams, where late rows are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _agg(df: DataFrame, w, keys: list[str], value: str) -> DataFrame:
    g = df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "most")


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    return _agg(df.withWatermark(ts, late), F.window(ts, size), keys, value)


def sliding(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    return _agg(df.withWatermark(ts, late), F.window(ts, size, slide), keys, value)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    return _agg(df.withWatermark(ts, late), F.session_window(ts, gap), keys, value)
