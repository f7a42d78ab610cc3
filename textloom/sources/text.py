"""Text in and out: lines, whole files, bytes, table columns, and directories that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """Rows (value) of text files, one for each line; files are split between tasks."""
    return spark.read.option("lineSep", separator).text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, value), one for each whole file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, content) with the bytes of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_table(spark: SparkSession, path: str, *columns: str, format: str = "parquet") -> DataFrame:
    """The named columns of a table; only they are read."""
    df = spark.read.format(format).load(path)
    return df.select(*columns) if columns else df


def stream_table(spark: SparkSession, path: str, schema, format: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """A stream of the rows of files that appear in a directory."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def write_lines(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """Text files with a line for each value that is not null."""
    df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", format: str = "parquet") -> None:
    df.write.mode(mode).format(format).save(path)
