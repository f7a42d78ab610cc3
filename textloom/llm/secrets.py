"""Secret scans with an incremental ledger of content-addressed blobs.

Every row of the scanned table is a version of a path; its text is a blob, named by its
SHA-256. The ledger records which rule versions have scanned which blob and what they
found. A scan reads only the texts of blobs that lack a current rule version, one copy of
each, appends to the ledger and joins its findings back to every path with that blob.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .store import first_copies, keep_ids, new_path, settle, small


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a match counts if `value` (a group) has at least `least` characters."""

    kind: str
    version: int
    pattern: str
    value: int = 0
    least: int = 1
    any_case: bool = False
    #: Text that every match contains, if any: texts without it are not searched.
    needle: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        if self.needle and self.needle not in text:
            return []
        found = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0)).finditer(text)
        return [m.span() for m in found if len(m[self.value]) >= self.least]


#: The base kinds, in the order that breaks ties, then the kinds added to them.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", value=2, least=6, any_case=True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=20, needle="AKIA"),
    # runs are maximal, so asking for 24 at once finds the same ones
    Rule("hex", 1, r"[0-9a-f]{24,}", least=24),
)
RULES = (
    *BASE,
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", needle="-----BEGIN "),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needle="eyJ"),
    Rule("host_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", needle="gh"),
)

LEDGER = "blob binary, done array<string>, found array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _scan(docs: DataFrame, rules: tuple[Rule, ...], order: dict[str, int]) -> DataFrame:
    """Ledger rows for the texts of docs (blob, text)."""
    names = [r.name for r in rules]

    def run(batches):
        for batch in batches:
            for at, n in textkit.blocks(batch.column(1).cast(pa.large_string())):
                found = []
                for text in batch.column(1).slice(at, n).to_pylist():
                    text = text or ""
                    found.append(sorted(({"start": s, "rank": order[r.kind], "kind": r.kind, "end": e} for r in rules for s, e in r.spans(text)), key=lambda x: (x["start"], x["rank"])))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())]))
                yield pa.record_batch([batch.column(0).slice(at, n), pa.array([names] * n, pa.list_(pa.string())), pa.array(found, kind)], names=["blob", "done", "found"])

    return docs.mapInArrow(run, LEDGER)


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every row of docs (doc_id, text; other columns are ignored).

    ledger: path of the ledger table, created where it is missing; None uses a new one in
    the shared folder. Returns one row per input row: doc_id, blob and found, an array of
    (start, rank, kind, end) in code points, end exclusive, sorted by start, then by the
    order of the rules. A null text is the empty blob. Rows with equal texts, a repeated
    id or a null id each get their own result; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = {r.kind: k for k, r in enumerate(rules)}
    names = [r.name for r in rules]
    blob = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    paths = settle(docs.select("doc_id", blob.alias("blob")), "paths")
    ledger = ledger or new_path(spark, "ledger")
    known = _read(spark, ledger)
    if known is None:
        fresh = first_copies(docs, paths, "blob").select(blob.alias("blob"), "text")
        _scan(fresh, rules, order).write.mode("append").parquet(ledger)
    else:
        done = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("done"))).alias("done"))
        lacking = F.array_except(F.array(*map(F.lit, names)), F.coalesce("done", F.array().cast("array<string>")))
        first = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
        todo = settle(first.join(done, "blob", "left").select("doc_id", "blob", F.array_join(lacking, ",").alias("lacking")).filter("lacking <> ''"), "todo")
        # as many sets of rules at most as the rules have had versions
        for row in todo.select("lacking").distinct().collect():
            wanted = todo.filter(F.col("lacking") == row.lacking).select("doc_id", F.col("blob").alias("_blob"))
            some = keep_ids(docs, settle(wanted.select("doc_id").distinct(), "wanted"), "left_semi").unionByName(docs.filter("doc_id is null"))
            some = some.select(blob.alias("blob"), "text")
            some = some.join(wanted.select(F.col("_blob").alias("blob")).distinct(), "blob", "left_semi")
            _scan(some, tuple(r for r in rules if r.name in row.lacking.split(",")), order).write.mode("append").parquet(ledger)
    current = spark.read.schema(LEDGER).parquet(ledger)
    # only kinds whose rule version is current; copies scanned twice give equal spans
    kept = F.filter("found", lambda x: F.exists("done", lambda d: F.array_contains(F.array(*map(F.lit, names)), d) & (F.split_part(d, F.lit("@"), F.lit(1)) == x["kind"])))
    found = current.select("blob", kept.alias("found")).filter(F.size("found") > 0)
    found = found.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))).alias("found"))
    found = settle(found.select("blob", F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))).alias("found")), "found")
    side = F.broadcast(found) if small(found, 400) else found
    none = F.array().cast(found.schema["found"].dataType)
    return paths.join(side, "blob", "left").select("doc_id", "blob", F.coalesce("found", none).alias("found"))


def _read(spark, path: str) -> DataFrame | None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def redact(docs: DataFrame, findings: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with each found span of its text replaced; overlapping spans are replaced as one.

    findings: doc_id and found as of scan_secrets, one row for each id (rows whose id is
    null or repeats with another text must have been given ids before).
    """
    some = settle(findings.filter(F.size("found") > 0).select("doc_id", F.transform("found", lambda x: F.struct(x["start"], x["end"])).alias("_found")).dropDuplicates(["doc_id"]), "redactions")
    joined = docs.join(F.broadcast(some) if small(some, 400) else some, "doc_id", "left")
    # the text is rebuilt between the spans: (built so far, end of the last span)
    text, zero = F.col("text"), F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, x):
        first, last = x["col1"], x["col2"]
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (F.greatest(first, acc["at"]) - acc["at"]).cast("int"))
        return F.struct(F.when(first < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], piece, F.lit(mask))).alias("out"), F.greatest(last, acc["at"]).alias("at"))

    spans = F.transform("_found", lambda x: F.struct(x["start"].cast("long").alias("col1"), x["end"].cast("long").alias("col2")))
    done = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return joined.withColumn("text", F.when(F.col("_found").isNull(), text).otherwise(done)).select(*docs.columns)


def span_digests(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans and all spans as text."""
    kinds = [r.kind for r in base]
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, kinds), F.sha2(text(F.filter("found", lambda x: x["kind"].isin(kinds))), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
