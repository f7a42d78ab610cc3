"""Shared storage: lineage is cut by tables in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that may be broadcast; its size is counted first.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a temporary folder only where it is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        where = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, with its file system's scheme, deleted when the session's file systems close."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = system.makeQualified(target)
    system.deleteOnExit(target)
    return target.toString()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, so that later steps depend on files only."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a settled table is proven to fit a broadcast."""
    return df.count() <= limit // row_bytes


def keep_ids(df: DataFrame, ids: DataFrame, how: str, column: str = "doc_id") -> DataFrame:
    """Semi or anti join on a settled id list: broadcast within its checked size, shuffled beyond."""
    return df.join(F.broadcast(ids) if small(ids, 40) else ids, column, how)


def first_copies(docs: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """docs without the later copies: rows whose id is not the smallest of any key.

    keyed (settled): doc_id and key. Only the list of copies moves, never the texts,
    while it is within the broadcast limit. Rows with a null doc_id stay.
    """
    first = keyed.groupBy(key).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("_n"))
    many = first.filter("_n > 1").select(key, F.col("doc_id").alias("_first"))
    first_of_many = many.select(F.col("_first").alias("doc_id")).distinct()
    later = keyed.join(many, key).filter(F.col("doc_id") != F.col("_first")).select("doc_id").distinct()
    # an id that repeats with another text may be a first copy elsewhere: it is read again
    once = first.filter("_n = 1").select("doc_id").distinct()
    later = settle(later.join(first_of_many, "doc_id", "left_anti").join(once, "doc_id", "left_anti"), "copies")
    return keep_ids(docs, later, "left_anti")
