"""Registered queries: programs over the driver's tables, each with SQL that states the same result."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.chunked import join_chunks, run_chunked, split_chunks
from textloom.operators.program import compile_program
from textloom.streaming.transducer import collect_outputs, run_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def keep(fn):
        name = fn.__name__.removeprefix("_")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def _column(name: str, program: str, source: str, key: str, value, sql: str, engine: str = "auto", **options) -> None:
    """A query that applies a program to one expression of a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = value() if callable(value) else F.col(value)
        return table(spark, sf_dir, source).select(key, compile_program(program, **options).column(made, engine).alias("out"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"SELECT {key}, {sql} AS out FROM {source}"


def _both(name: str, *args, **options) -> None:
    """The query, and its twin in which every stage runs in the kernel."""
    _column(name, *args, **options)
    _column(f"kernel_{name}", *args, engine="kernel", **options)


ROT = " | ".join(f'~/{a}/ "{b}"' for a, b in zip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM", strict=True))
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
TURNED = "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM"

_column("identity_copy", "main := /./*", "documents", "doc_id", "text", "text")
_both("map_rot13", f"main := ({ROT} | /./)*", "documents", "doc_id", "text", f"translate(text, '{LETTERS}', '{TURNED}')")
_column("map_flip", 'main := (~/a/ "b" | ~/b/ "a" | /./)*', "documents", "doc_id", "text", "translate(text, 'ab', 'ba')")
_both("quote_words", 'main := ("\\"" /[a-zA-Z]+/ "\\"" | /./)*', "documents", "doc_id", "text", r"""regexp_replace(text, '[a-zA-Z]+', '"\0"', 'g')""")
_both(
    "highlight_tokens",
    'main := ("<n>" /[0-9]+/ "</n>" | "<w>" /[A-Z][a-z]+/ "</w>" | ~/\\|/ "&vert;" | /./)*',
    "documents",
    "doc_id",
    "text",
    r"""array_to_string(list_transform(regexp_extract_all(text, '(?s)[0-9]+|[A-Z][a-z]+|\||.'), lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN '<n>' || t || '</n>' WHEN regexp_full_match(t, '[A-Z][a-z]+') THEN '<w>' || t || '</w>' WHEN t = '|' THEN '&vert;' ELSE t END), '')""",
)
_column("extract_tags", "main := (/<[^>]*>/ | ~/./)*", "pages", "page_id", "html", "array_to_string(regexp_extract_all(html, '<[^>]*>'), '')")
_column("strip_scripts", "main := (~/<script>.*?<\\/script>/ | /./)*", "pages", "page_id", "html", "regexp_replace(html, '(?s)<script>.*?</script>', '', 'g')", engine="kernel")
_both("group_digits", 'main := /[0-9]{1,3}/ ("," /[0-9]{3}/)*', "orders", "o_orderkey", lambda: (F.col("o_orderkey") * 1234567).cast("string"), "format('{:,}', o_orderkey * 1234567)")
_both(
    "timestamp_fields",
    'main := "{\\"year\\":\\"" /[0-9]{4}/ "\\",\\"month\\":\\"" ~/-/ /[0-9]{2}/ "\\",\\"day\\":\\"" ~/-/ /[0-9]{2}/ "\\",\\"hour\\":\\"" ~/ / /[0-9]{2}/ "\\"}" ~/:.*/',
    "events",
    "event_id",
    lambda: F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
    r"""regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S'), '^([0-9]{4})-([0-9]{2})-([0-9]{2}) ([0-9]{2}):.*$', '{"year":"\1","month":"\2","day":"\3","hour":"\4"}')""",
)


def _row():
    return F.concat_ws(",", "c_custkey", "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment", F.lit("x"), F.lit("y"))


_ROW = "concat_ws(',', c_custkey, c_name, c_nationkey, c_mktsegment, 'x', 'y')"
_both("csv_keep_cols", 'main := ~/[^,\\n]*,/ /[^,\\n]*/ "\\t" ~/,[^,\\n]*,[^,\\n]*,/ /[^,\\n]*/ ~/,[^,\\n]*/', "customer", "c_custkey", _row, f"concat_ws(chr(9), string_split({_ROW}, ',')[2], string_split({_ROW}, ',')[5])")
_both("csv_drop_first", "main := ~/[^,\\n]*,/ /.*/", "customer", "c_custkey", _row, f"array_to_string(list_slice(string_split({_ROW}, ','), 2, 6), ',')")
_both("csv_drop_odd", "main := ~/[^,]*,/ /[^,]*/ (~/,[^,]*/ /,[^,]*/)*", "customer", "c_custkey", _row, f"array_to_string(list_filter(string_split({_ROW}, ','), lambda x, i: i % 2 = 0), ',')")
_both("row_to_json", 'main := "{\\"id\\":\\"" /[^,\\n]*/ "\\",\\"name\\":\\"" ~/,/ /[^,\\n]*/ "\\",\\"nation\\":\\"" ~/,/ /[^,\\n]*/ "\\"}" ~/,.*/', "customer", "c_custkey", _row, """concat('{"id":"', c_custkey, '","name":"', c_name, '","nation":"', c_nationkey, '"}')""")
_both("json_to_csv", 'main := ~/\\{"k": / /[0-9]+/ ~/\\}/ ","', "events", "event_id", "props", "json_extract_string(props, '$.k') || ','")
_both("json_to_sql", 'main := "(" ~/[^0-9]*/ /[0-9]+/ ~/[^0-9]*/ ")"', "events", "event_id", "props", "'(' || json_extract_string(props, '$.k') || ')'")
_both(
    "url_parts",
    'main := "scheme=" /[a-z]+/ ~/:\\/\\// ";host=" /[^\\/:]+/ ~/(:[0-9]+)?/ ";path=" /.*/',
    "pages",
    "page_id",
    "url",
    r"""'scheme=' || regexp_extract(url, '^([a-z]+)://([^/:]+)(:[0-9]+)?(.*)$', 1) || ';host=' || regexp_extract(url, '^([a-z]+)://([^/:]+)(:[0-9]+)?(.*)$', 2) || ';path=' || regexp_extract(url, '^([a-z]+)://([^/:]+)(:[0-9]+)?(.*)$', 4)""",
)
_column("email_extract", 'main := (/[A-Za-z0-9._]+@[A-Za-z0-9.]+/ "\\n" | ~/./)*', "documents", "doc_id", "text", "array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+'), lambda m: m || chr(10)), '')")
_column("drop_lines", "main := (~/Th[^\\n]*\\n/ | /[^\\n]*\\n/)*", "documents", "doc_id", lambda: F.concat("text", F.lit("\n")), "array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l: NOT starts_with(l, 'Th')), lambda l: l || chr(10)), '')", engine="kernel")
_both("keep_lines", "main := ((/[^\\n]*[.]/ | ~/[^\\n]*/) /\\n/)*", "documents", "doc_id", lambda: F.concat("text", F.lit("\n")), "array_to_string(list_transform(string_split(text, chr(10)), lambda l: (CASE WHEN ends_with(l, '.') THEN l ELSE '' END) || chr(10)), '')")
_both("swap_two_lines", "main := a@/[^\\n]*\\n/ b@/[^\\n]*\\n/ !b !a /.*/", "documents", "doc_id", "text", r"""CASE WHEN regexp_full_match(text, '(?s)[^\n]*\n[^\n]*\n.*') THEN regexp_replace(text, '(?s)^([^\n]*\n)([^\n]*\n)(.*)$', '\2\1\3') END""")
_column("reverse_entries", 'main := (e@/[^ ]* / [acc <- e acc])* last@/[^ ]+/ !last " " !acc', "part", "p_partkey", "p_name", "array_to_string(list_reverse(string_split(p_name, ' ')), ' ') || ' '")
_column("bucket_letters", 'main := (~/a/ [as += "a"] | ~/e/ [es += "e"] | ~/./)* !as !es', "documents", "doc_id", "text", "repeat('a', len(regexp_extract_all(text, 'a'))::BIGINT) || repeat('e', len(regexp_extract_all(text, 'e'))::BIGINT)")
_both("pipeline_three", 'start: strip >> join >> quote\nstrip := (~/[0-9]+/ | /./)*\njoin := (~/\\n/ "|" | /./)*\nquote := ("<" /[A-Z]+/ ">" | /./)*', "documents", "doc_id", "text", r"""regexp_replace(replace(regexp_replace(text, '[0-9]+', '', 'g'), chr(10), '|'), '[A-Z]+', '<\0>', 'g')""")
_both("reject_to_null", "main := /[A-Z][a-z]*#00000[0-9]*[05]/", "customer", "c_custkey", "c_name", "CASE WHEN regexp_full_match(c_name, '[A-Z][a-z]*#00000[0-9]*[05]') THEN c_name END")
_both("copy_or_drop_last", "main := /.*/ ~/./", "customer", "c_custkey", "c_name", "substr(c_name, 1, length(c_name) - 1)")
_column("parity_choice", 'main := (~/e/ ~other ~/e/ "E" ~other | ~/x/)* | odd\nodd := /[^e]*e/ rest\nrest := /[^e]*e[^e]*e/ rest | /[^e]*/\nother := /[^e]*/', "part", "p_partkey", "p_name", "CASE WHEN length(p_name) = 0 THEN '' WHEN len(regexp_extract_all(p_name, 'e')) % 2 = 1 THEN p_name WHEN regexp_full_match(p_name, 'x*(e[^e]*e[^ex]*x*)*') THEN repeat('E', (len(regexp_extract_all(p_name, 'e')) / 2)::BIGINT) END")
_column("last_byte_decides", 'main := (~/[a-m]/ "l" | ~/[^a-m]/ "h")* ~/[0-4]/ "!" | (~/[a-m]/ "0" | ~/[^a-m]/ "1")*', "customer", "c_custkey", "c_name", "CASE WHEN regexp_full_match(c_name, '.*[0-4]') THEN regexp_replace(regexp_replace(substr(c_name, 1, length(c_name) - 1), '[^a-m]', 'H', 'g'), '[a-m]', 'l', 'g').replace('H', 'h') || '!' ELSE regexp_replace(regexp_replace(c_name, '[^a-m]', '1', 'g'), '[a-m]', '0', 'g') END")
_column("number_lines", 'main := ("NN: " /[^\\n]*\\n/)*', "documents", "doc_id", lambda: F.concat("text", F.lit("\n")), r"""array_to_string(list_transform(string_split(text, chr(10)), lambda l: 'NN: ' || l || chr(10)), '')""")
_column("rewrite_attribute", 'main := (/href="/ url@/[^"]*/ "/go?u=" !url /"/ | /./)*', "pages", "page_id", "html", r"""regexp_replace(html, 'href="([^"]*)"', 'href="/go?u=\1"', 'g')""")
_column("mask_numbers", 'main := (/[0-9]/ (~/[0-9]/ "*")* | /./)*', "customer", "c_custkey", "c_name", "regexp_extract(c_name, '^([^0-9]*[0-9])', 1) || repeat('*', (length(c_name) - length(regexp_extract(c_name, '^([^0-9]*[0-9])', 1)))::BIGINT)")
_column("code_points", 'main := ("[" /[à-ÿ]+/ "]" | /./)*', "documents", "doc_id", "text", r"regexp_replace(text, '[à-ÿ]+', '[\0]', 'g')")
_column("keyword_choice", 'main := "sql:" /BUILDING|MACHINERY/ | "other:" /[A-Z]+/', "customer", "c_custkey", "c_mktsegment", "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'sql:' || c_mktsegment ELSE 'other:' || c_mktsegment END")
_column("stacked_fallback", 'main := "mail " /[a-z]+@[a-z]+/ | "malformed: " /.*/', "customer", "c_custkey", "c_name", "CASE WHEN regexp_full_match(c_name, '[a-z]+@[a-z]+') THEN 'mail ' || c_name ELSE 'malformed: ' || c_name END")
_column("copied_register", "main := a@/[^#]*/ ~/#/ !a /[0-9]*/ !a", "customer", "c_custkey", "c_name", "string_split(c_name, '#')[1] || string_split(c_name, '#')[2] || string_split(c_name, '#')[1]", copying=True)
_column("moved_register", "main := a@/[^#]*/ ~/#/ !a /[0-9]*/ !a", "customer", "c_custkey", "c_name", "replace(c_name, '#', '')")


@query("SELECT c_custkey, regexp_full_match(c_name, 'Customer#[0-9]{9}') AS ok FROM customer")
def validate_full(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", compile_program("main := /Customer#[0-9]{9}/").accepts("c_name").alias("ok"))


@query("SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)")
def explode_lines(spark, sf_dir):
    lines = F.posexplode(F.split("text", "\n", -1))
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("pos", "line")).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query("SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE regexp_full_match(line, '[A-Z][^,]*[.]')")
def email_filter(spark, sf_dir):
    """Records that a program accepts, as rows."""
    lines = F.posexplode(F.split("text", "\n", -1))
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("pos", "line"))
    return rows.filter(compile_program("main := /[A-Z][^,]*[.]/").accepts("line")).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query("SELECT conv_id, turn, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next_text FROM conversations")
def shift_records(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lead("text").over(order).alias("next_text"))


@query("SELECT doc_id, list_max(list_transform(string_split(text, ' '), lambda w: length(w)))::BIGINT AS longest, len(string_split(text, ' '))::BIGINT AS words FROM documents")
def fold_registers(spark, sf_dir):
    zero = F.struct(F.lit(0).cast("long").alias("longest"), F.lit(0).cast("long").alias("words"))
    fold = F.aggregate(F.split("text", " ", -1), zero, lambda acc, w: F.struct(F.greatest(acc["longest"], F.char_length(w).cast("long")).alias("longest"), (acc["words"] + 1).alias("words")))
    return table(spark, sf_dir, "documents").select("doc_id", fold.alias("f")).select("doc_id", "f.longest", "f.words")


@query("SELECT doc_id, len(regexp_extract_all(text, 'the|of'))::BIGINT AS n_en, len(regexp_extract_all(text, 'der|und'))::BIGINT AS n_de, len(regexp_extract_all(text, 'que|las'))::BIGINT AS n_es FROM documents")
def motif_counts(spark, sf_dir):
    count = lambda motif: F.regexp_count("text", F.lit(motif)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", count("the|of").alias("n_en"), count("der|und").alias("n_de"), count("que|las").alias("n_es"))


@query("SELECT doc_id, len(regexp_extract_all(text, 'the|of'))::BIGINT AS n FROM documents")
def kernel_motif_counts(spark, sf_dir):
    """Unary counting by a program: a mark for each motif, nothing for the rest."""
    program = compile_program('main := (~/the|of/ "1" | ~/./)*')
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length(program.column("text", "kernel")).cast("long").alias("n"))


_DICTIONARY = {"the": "le", "of": "de", "and": "et", "der": "el", "und": "y", "que": "dass"}


@query(
    "WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents), d(k, v) AS (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in _DICTIONARY.items())
    + ") SELECT doc_id, string_agg(coalesce(v, w), ' ' ORDER BY pos) AS out FROM t LEFT JOIN d ON w = k GROUP BY doc_id"
)
def dictionary_replace(spark, sf_dir):
    """Words of each text replaced by a dictionary that is joined within the row: no exchange, whatever the text's length."""
    words = F.from_json(F.lit(str(_DICTIONARY).replace("'", '"')), "map<string,string>")
    out = F.array_join(F.transform(F.split("text", " ", -1), lambda w: F.coalesce(F.element_at(words, w), w)), " ")
    return table(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", out.alias("out"))


@query("SELECT p_partkey, CASE WHEN levenshtein(p_name, 'large polished brass') <= 8 THEN true ELSE false END AS near FROM part")
def approx_levenshtein(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", compile_program("main := /large polished brass/<8>", metric="levenshtein").accepts("p_name").alias("near"))


@query("SELECT p_partkey, length(p_type) = 8 AND (CASE WHEN length(p_type) = 8 THEN hamming(p_type, 'STANDARD') ELSE 99 END) <= 6 AS near FROM part")
def approx_hamming(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", compile_program("main := /STANDARD/<6>", metric="hamming").accepts("p_type").alias("near"))


@query("SELECT p_partkey, levenshtein(p_type, 'ECONOMY') <= 4 AS lev, length(p_type) = 7 AND (CASE WHEN length(p_type) = 7 THEN hamming(p_type, 'ECONOMY') ELSE 99 END) <= 4 AS ham FROM part")
def approx_kernel_accept(spark, sf_dir):
    accept = lambda metric: compile_program("main := /ECONOMY/<4>", metric=metric).accepts("p_type", "kernel")
    return table(spark, sf_dir, "part").select("p_partkey", accept("levenshtein").alias("lev"), accept("hamming").alias("ham"))


@query("SELECT p_partkey, CASE WHEN levenshtein(p_type, 'ECONOMY') <= 4 THEN 'ECONOMY' END AS out FROM part")
def approx_correction(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", compile_program("main := /ECONOMY/<4>", metric="levenshtein").column("p_type").alias("out"))


@query("SELECT p_partkey, CASE WHEN levenshtein(p_type, 'ECONOMY') <= 4 THEN p_type END AS out FROM part")
def approx_matching(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", compile_program("main := /ECONOMY/<4>", metric="levenshtein", mode="matching").column("p_type").alias("out"))


@query("SELECT p_partkey, CASE WHEN levenshtein(p_type, 'ECONOMY') <= 4 THEN levenshtein(p_type, 'ECONOMY')::BIGINT ELSE -1 END AS edits FROM part")
def approx_script(spark, sf_dir):
    """Edit scripts: as many marks as there are edits."""
    script = compile_program("main := /economy/<4>", metric="levenshtein", mode="explicit").column(F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.regexp_count(script, F.lit("[IDR]")).cast("long"), F.lit(-1).cast("long")).alias("edits"))


@query("SELECT c_custkey, list_transform(string_split(string_split(c_name, '#')[2], ''), lambda d: d::INTEGER) AS codes FROM customer")
def parse_codes(spark, sf_dir):
    """The ranks of the symbols read are the digits themselves."""
    return table(spark, sf_dir, "customer").select("c_custkey", compile_program("main := /[0-9]{9}/").codes(F.split("c_name", "#")[1]).alias("codes"))


@query("SELECT c_custkey, string_split(c_name, '#')[1] AS kind, string_split(c_name, '#')[2] AS number FROM customer")
def parse_records(spark, sf_dir):
    program = compile_program("main := kind ~/#/ number\nkind := /[A-Za-z]+/\nnumber := /[0-9]+/")
    return program.parse_records(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name").drop("c_name")


@query("SELECT c_custkey, regexp_full_match(c_name, 'Customer#00000[0-9]*') AS ok, CASE WHEN regexp_full_match(c_name, 'Customer#00000[0-9]*') THEN replace(c_name, '#', ':') END AS value, CASE WHEN regexp_full_match(c_name, 'Customer#00000[0-9]*') THEN NULL ELSE length(regexp_extract(c_name, '^Customer#0{0,5}')) END::BIGINT AS error_pos FROM customer")
def outcome_struct(spark, sf_dir):
    out = compile_program('main := /Customer/ ~/#/ ":" /00000[0-9]*/').result("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", out.alias("r")).select("c_custkey", "r.ok", "r.value", "r.error_pos")


@query("SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '<\\0>', 'g') AS out FROM customer")
def sql_function(spark, sf_dir):
    """A program as a function of SQL."""
    compile_program('main := ("<" /[0-9]+/ ">" | /./)*').register(spark, "mark_numbers")
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer_rows")
    return spark.sql("SELECT c_custkey, mark_numbers(c_name) AS out FROM customer_rows")


@query("SELECT doc_id, pos::INTEGER AS pos, record FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS record, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)")
def sql_table_function(spark, sf_dir):
    """A program as a table function of SQL, joined laterally."""
    compile_program("main := (/[^\\n]*\\n/)*").register_table_function(spark, "records_of")
    table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n")).alias("text")).createOrReplaceTempView("document_rows")
    return spark.sql("SELECT doc_id, r.pos, r.record FROM document_rows, LATERAL records_of(text) AS r")


def _chunked(name: str, program: str, sql: str) -> None:
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").filter("doc_id is not null")
        done = run_chunked(compile_program(program), split_chunks(docs, "doc_id", "text", 1000))
        return join_chunks(done, "doc_id", name="out")

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"SELECT doc_id, {sql} AS out FROM documents WHERE text IS NOT NULL"


_chunked("chunked_quote_words", 'main := ("\\"" /[a-zA-Z]+/ "\\"" | /./)*', r"""regexp_replace(text, '[a-zA-Z]+', '"\0"', 'g')""")
_chunked("chunked_keep_lines", 'main := (/[^\\n]*[.]/ | ~/[^\\n]*/) (/\\n/ (/[^\\n]*[.]/ | ~/[^\\n]*/))*', "array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN ends_with(l, '.') THEN l ELSE '' END), chr(10))")


def stream_folder(spark: SparkSession) -> str:
    """A fresh folder for a stream's input, state and output, in the shared folder where the session names one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    return f"{where}/stream-{os.urandom(8).hex()}" if where else tempfile.mkdtemp(prefix="textloom-stream-")


def _streamed(spark: SparkSession, sf_dir: str, program: str, rows: DataFrame) -> DataFrame:
    """Rows (doc_id, seq, chunk, last) through a file stream, a program and a Parquet sink, in one run over what is there."""
    from textloom.sources.text import stream_table

    where = stream_folder(spark)
    rows.write.parquet(f"{where}/in")
    out = run_stream(compile_program(program), stream_table(spark, f"{where}/in", rows.schema))
    query_ = out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query_.awaitTermination()
    return collect_outputs(spark.read.schema(out.schema).parquet(f"{where}/out"))


@query(r"""SELECT conv_id AS doc_id, regexp_replace(string_agg(text, chr(10) ORDER BY turn, role, text) || chr(10), '[a-zA-Z]+', '"\0"', 'g') AS output FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id""")
def streaming_quote_words(spark, sf_dir):
    """Turns of a conversation arrive as chunks; the output equals that of the whole conversation."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = table(spark, sf_dir, "conversations").filter("conv_id is not null")
    rows = turns.select(F.col("conv_id").alias("doc_id"), (F.row_number().over(order) - 1).cast("long").alias("seq"), F.concat("text", F.lit("\n")).alias("chunk"), F.lead("turn").over(order).isNull().alias("last"))
    return _streamed(spark, sf_dir, 'main := ("\\"" /[a-zA-Z]+/ "\\"" | /./)*', rows)


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    """Records around a program in event time: hourly counts of a parsed field."""
    program = compile_program('main := ~/\\{"k": / /[0-9]+/ ~/\\}/')
    rows = table(spark, sf_dir, "events").filter(program.accepts("props"))
    return rows.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, count(*) AS n, sum(length(concat_ws('|', l_orderkey, l_linenumber, l_returnflag, l_linestatus)))::BIGINT AS chars FROM lineitem GROUP BY l_returnflag")
def render_rows(spark, sf_dir):
    """A row-rendering program under an aggregate: only four columns are read."""
    row = F.concat_ws(",", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    out = compile_program('main := (~/,/ "|" | /./)*').column(row)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length(out)).cast("long").alias("chars"))
