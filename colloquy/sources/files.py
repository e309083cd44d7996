"""Sources and sinks: JSON lines, parquet, split fan-out, safe rewrites, step dumps, manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_jsonl_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines): a line that isn't an object of the schema keeps its text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select("value", F.from_json("value", full, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.where(bad).select("value")


def read_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet tables together; columns that one lacks are null."""
    out = spark.read.parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out


def nested(df: DataFrame, keys: list[str]) -> Column:
    """The value under nested keys; an array with one element gives the element."""
    c: Column = F.col(keys[0])
    kind = df.schema[keys[0]].dataType
    for k in [*keys[1:], None]:
        if isinstance(kind, T.ArrayType):
            c, kind = F.when(F.size(c) == 1, F.get(c, F.lit(0))), kind.elementType
        if k is not None:
            c, kind = c[k], kind[k].dataType
    return c


def as_json_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON strings."""
    flat = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, flat) else F.col(f.name) for f in df.schema.fields))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder a split, as parquet and as JSON lines; a split is read by its folder."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/parquet")
    df.write.mode("overwrite").partitionBy(split).json(f"{path}/jsonl")


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A parquet table changed in place: written beside it first, so that no plan reads what it overwrites, then moved over it."""
    staged = f"{path.rstrip('/')}.staged"
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(staged)
    jvm = spark._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{staged} could not be moved to {path}")
    return spark.read.parquet(path)


def without_nan(df: DataFrame) -> DataFrame:
    return df.select(*(F.nanvl(f.name, F.lit(None)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields))


def dump_steps(df: DataFrame, path: str, step: str = "step") -> None:
    """One folder a step of JSON lines, NaN as null; steps written before stay."""
    without_nan(df).write.mode("append").partitionBy(step).json(path)


def append_named(df: DataFrame, path: str, name: str) -> None:
    df.withColumn("name", F.lit(name)).write.mode("append").partitionBy("name").parquet(path)


def flattened(df: DataFrame, sep: str = "/") -> DataFrame:
    """Structs as columns with joined names."""

    def walk(schema: T.StructType, at: list[str]) -> list[Column]:
        out = []
        for f in schema.fields:
            path = [*at, f.name]
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, path)
            else:
                c = F.col(path[0])
                for p in path[1:]:
                    c = c[p]
                out.append(c.alias(sep.join(path)))
        return out

    return df.select(*walk(df.schema, []))


def manifest(df: DataFrame, split: str, source: str, answer: str, facts: str) -> DataFrame:
    """Counts and least, most and mean number of facts by split, by split and source, and by split and answer, in one pass."""
    n = F.size(facts)
    return df.groupingSets([[split], [split, source], [split, answer]], split, source, answer).agg(
        F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean")
    )
