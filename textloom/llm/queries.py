"""The registered queries of this subpackage: thin forms that derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ssjoin import similarity_classes

    return similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


ORACLES["op8_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM words
), classes AS (
  SELECT s, min(doc_id) AS class_id FROM sets WHERE len(s) > 0 GROUP BY s
), members AS (
  SELECT class_id, len(s) AS n, unnest(s) AS g FROM classes
), links AS (
  SELECT a.class_id AS x, b.class_id AS y FROM members a JOIN members b ON a.g = b.g AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(x, y) AS (
  SELECT class_id, class_id FROM classes UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), components AS (
  SELECT x AS class_id, min(y) AS component_id FROM reach GROUP BY x
), counts AS (
  SELECT x AS class_id, count(*) AS n_links FROM links GROUP BY x
)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id, coalesce(classes.class_id, sets.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN components ON classes.class_id = components.class_id LEFT JOIN counts ON classes.class_id = counts.class_id
"""


@query
def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets, span_digests

    return span_digests(scan_secrets(table(spark, sf_dir, "documents")))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@query
def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences, summary

    return summary(scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"), 10)


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))
