"""A training-data pipeline over the documents table: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontam, secrets, ssjoin, store, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts; it learns from the labels of the documents that it is given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_documents(docs, labels, keep=True)
    return scored.filter("predicted = 0").select(*COLUMNS)


def with_row_key(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with `row`, which no two rows share, and the (settled) rows for which it is not the doc_id.

    Rows without an id and rows that repeat one get numbers that are no ids.
    """
    again = store.settle(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"), "again")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.monotonically_increasing_id()
    if high is None or high < 1 << 62:
        number = number + ((high or 0) + 1)
    elif low > -(1 << 62):
        number = F.lit(min(low, 0) - 1) - number
    else:
        raise ValueError("doc_id leaves no room for row keys")
    odd = docs.filter("doc_id is null").unionByName(store.keep_ids(docs, again, "left_semi").select(*docs.columns))
    odd = store.settle(odd.withColumn("row", number), "odd_rows")
    own = store.keep_ids(docs.filter("doc_id is not null"), again, "left_anti")
    return own.select(*docs.columns, F.col("doc_id").cast("long").alias("row")).unionByName(odd), odd


def by_row(keyed: DataFrame) -> DataFrame:
    """The texts with the row key as doc_id."""
    return keyed.select(F.col("row").alias("doc_id"), "text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents, the one with the smallest id (rows without one come last); blank
    documents are linked to nothing."""
    keyed, odd = with_row_key(docs.select(*COLUMNS))
    groups = store.settle(ssjoin.similarity_classes(by_row(keyed)).select(F.col("doc_id").alias("row"), "component_id"), "groups")
    # the members of groups are few beside the documents, so their keys are what moves
    linked = store.settle(groups.filter("row <> component_id"), "linked")
    heads = linked.select(F.col("component_id").alias("row"), "component_id").distinct()
    members = linked.unionByName(heads).join(odd.select("row", F.col("doc_id").alias("id"), F.lit(True).alias("is_odd")), "row", "left")
    members = members.withColumn("id", F.when(F.col("is_odd"), F.col("id")).otherwise(F.col("row"))).withColumn("order", F.struct(F.col("id").isNull(), "id", "row"))
    first = members.groupBy("component_id").agg(F.min("order").alias("first"))
    later = store.settle(members.select("row").join(first.select(F.col("first.row").alias("row")), "row", "left_anti"), "later")
    return store.keep_ids(keyed, later, "left_anti", "row").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed, _ = with_row_key(docs.select(*COLUMNS))
    found = store.settle(decontam.contaminated(by_row(keyed), benchmark).select(F.col("doc_id").alias("row")).distinct(), "contaminated")
    return store.keep_ids(keyed, found, "left_anti", "row").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars to match."""
    keyed, _ = with_row_key(docs.select(*COLUMNS))
    own = keyed.withColumnRenamed("doc_id", "own_id").withColumnRenamed("row", "doc_id")
    masked = secrets.redact(own, secrets.scan_secrets(by_row(keyed))).drop("doc_id").withColumnRenamed("own_id", "doc_id")
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids; a text that does not survive the round trip would be an error."""
    import public_tokenizers

    coded = bpe.encode_decode(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"))
    checked = F.when(F.col("decoded") == F.coalesce("text", F.lit("")), F.col("ids")).otherwise(F.raise_error(F.lit("decoding does not give the text back")))
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", checked.alias("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("bpe", tokenize),
]

#: The toxicity model and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.settle(stage(spark, docs, sf_dir), name)
    return docs
