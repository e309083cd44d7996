"""Reading tables, and cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of this process only for a local master where that is unset, as in tests."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-colloquy-"))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: no lineage, real sizes, safe if executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._colloquy_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._colloquy_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sealed(docs: DataFrame) -> DataFrame:
    """doc_id, no_id, text without nulls: Arrow hands a long column with nulls to pandas as doubles, which changes ids above 2**53."""
    doc = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc, F.lit(0)).alias("doc_id"), doc.isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"))


def opened(df: DataFrame) -> DataFrame:
    """df with the nulls of doc_id back in place of no_id."""
    return df.select(*(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id") if c == "doc_id" else c for c in df.columns if c != "no_id"))


def width(spark: SparkSession) -> int:
    """Partitions for an explicit repartition by key: as many as a shuffle has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c):
    """A-Z only, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
