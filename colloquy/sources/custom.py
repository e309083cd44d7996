"""A user's own classes as data sets and samplers.

A data set is a class of Spark's Python data source interface, or a plain class with a
``schema``, ``partitions()`` and ``rows(part)``, which is wrapped as one: its parts are read side by
side by Spark's tasks, and the class travels to them by value, so it may come from a file
(:func:`colloquy.operators.scoring.from_file`). A sampler is a class whose ``key(rows)`` gives each row of a pandas
frame the number that it is taken by; Spark sorts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from colloquy.operators.datasets import ranked


def _wrapped(cls: type) -> type:
    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.data = cls(options)

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(p) for p in self.data.partitions()]

        def read(self, partition: InputPartition) -> Iterator[Any]:
            return iter(self.data.rows(partition.value))

    class Source(DataSource):
        @classmethod
        def name(cls_) -> str:
            return f"colloquy_{cls.__name__}_{uuid.uuid4().hex[:8]}".lower()

        def schema(self) -> str:
            return cls.schema

        def reader(self, schema: Any) -> DataSourceReader:
            return Reader(dict(self.options))

    return Source


def dataset(spark: SparkSession, cls: type, **options: Any) -> DataFrame:
    """The rows of a user's data set. Options reach the class as texts; keys are case-insensitive and arrive in lower case.

    A plain class has ``schema`` (DDL), ``__init__(options)``, ``partitions()`` (a list of what can be pickled) and
    ``rows(part)`` (tuples or Arrow batches). A part is read by one task and again by another if that is
    lost, so it must give the same rows each time. Anything else is a TypeError.
    """
    if not isinstance(cls, type):
        raise TypeError("a data set is a class")
    source = cls
    if not issubclass(cls, DataSource):
        if lacks := [k for k in ("schema", "partitions", "rows") if not hasattr(cls, k)]:
            raise TypeError(f"data set {cls.__name__} has no {', '.join(lacks)}")
        source = _wrapped(cls)
    name = source.name()
    named = type(source.__name__, (source,), {"name": classmethod(lambda _: name)})
    spark.dataSource.register(named)
    return spark.read.format(name).options(**options).load()


def sampled(df: DataFrame, sampler: type, key: str, *columns: str, out: str = "place", **options: Any) -> DataFrame:
    """df with each row's place, from 0, in the order of a user's sampler: by what ``sampler(**options).key(rows)`` gives for a frame of ``columns``, ties by ``key``; a row without a number comes last.

    The sampler sees batches of rows, so a row's number may hang on that row alone.
    """
    if not callable(getattr(sampler, "key", None)):
        raise TypeError(f"sampler {getattr(sampler, '__name__', sampler)!r} has no key()")

    @F.pandas_udf("double")
    def number(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(sampler(**options).key(rows)).astype("float64")

    d = df.withColumn("__s", F.nanvl(number(F.struct(*columns)), F.lit(None).cast("double")))
    return ranked(d, [F.asc_nulls_last("__s"), F.col(key)], out).drop("__s")
