"""Columns, records, chunks, streams, sources and the SQL forms."""

import json

import pytest
from pyspark.sql import functions as F

from textloom import compile_program, compile_regex, load_program
from textloom.operators.chunked import join_chunks, run_chunked, split_chunks
from textloom.plans.lower import NotNative
from textloom.sources import text as sources
from textloom.streaming.transducer import Document, collect_outputs, run_stream

TEXTS = ["", "a1b22", "Hello wor1d\nsecond  line\n", "x" * 50 + "\n" + "é ß 漢\n", "\n\n", None]
PROGRAMS = [
    'main := ("<" /[a-zA-Z]+/ ">" | /./)*',
    'main := ("<" /[a-z]+/ ">" | ~/[0-9]/ "#" | "{" /[A-Z]/ "}" | ~/./)*',
    'main := (~/a/ "b" | ~/b/ "a" | /./)*',
    "main := ((/[^\\n]*e/ | ~/[^\\n]*/) /\\n/)*",
    'main := (k@/[a-zA-Z]*/ ~/ / !k "=" /[^\\n]*/ /\\n/)*',
    "main := a@/[^\\n]*\\n/ b@/[^\\n]*\\n/ !b !a",
    'main := "$1\\\\5" /[a-z]/ "7" /.*/',
    "main := /x/ main | /./ main | 1",
    'main := (~/a/ [as += "a"] | ~/[0-9]+/ [ns += "#"] [as += "n"] | ~/./)* !ns "-" !as',
    'main := (/l+/ [ls += "l"] | "<" /[0-9]/ ">" [ds += "d"] | /./)* !ls !ds',
]


@pytest.mark.parametrize("program", PROGRAMS)
def test_native_equals_kernel(spark, program):
    df = spark.createDataFrame([(t,) for t in TEXTS], "s string").coalesce(1)
    p = compile_program(program)
    rows = df.select(p.column("s", "native"), p.column("s", "kernel"), p.column("s", "backtrack"), p.accepts("s"), p.result("s")["ok"]).collect()
    for native, kernel, back, good, ok in rows:
        assert native == kernel == back
        assert good == ok and (good is None or good == (kernel is not None))


@pytest.mark.parametrize("few", [0, 2, 12])
def test_batches_equal_single_texts(few, monkeypatch):
    """The machine over many texts gives what it gives for each, whatever their lengths."""
    import random

    from textloom.operators import batch

    monkeypatch.setattr(batch, "FEW", few)
    monkeypatch.setattr(batch, "BLOCK", 300)
    rng = random.Random(few)
    texts = [None if k % 17 == 0 else "".join(rng.choice("aaab eE1\nZé😀") for _ in range(rng.choice([0, 1, 5, 40, 90]))) for k in range(60)]
    texts += ["a" * k for k in range(23)] + ["hello", "helo", "ab cd\n", "ab cd\nx e\n"]
    more = ['main := "x" (~/a{7}/ "0" | ~/a{3}/ "1")*', "main := /hello/<3>", 'main := "s" (/a*/ | "e" /[^q]*/)', "start: p >> q\np := (~/a/ | /./)*\nq := /[^Z]*/"]
    for program in [*PROGRAMS, *more]:
        for options in ({}, {"metric": "levenshtein", "mode": "explicit"}, {"copying": True}):
            stages = compile_program(program, **options).stages()
            assert stages.run_all(texts) == [stages.run(t) for t in texts]


def test_native_plan_has_no_python(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("s"))
    plan = lambda c: df.select(c)._jdf.queryExecution().executedPlan().toString()
    p = compile_program('start: a >> b\na := ("<" /[0-9]/ ">" | /./)*\nb := (~/</ "(" | /./)*')
    assert "Python" not in plan(p.column("s")) and "Python" in plan(p.column("s", "kernel"))
    with pytest.raises(NotNative):
        compile_program("main := /a/<1>").column("s", "native")


MANY = 250_000
LONG = [
    ("main := /(ab| |c)*/", "ab c" * MANY, "ab c" * MANY),
    ('main := ("<" /(ab|c)+/ ">" | /./)*', "abcx" * MANY, "<abc>x" * MANY),
    ("main := ~/[^,]*/ /(,[^,]*,[^,]*)*/", "a" + ",b,a" * MANY, ",b,a" * MANY),
    ("main := ((/[^\\n]*[.]/ | ~/[^\\n]*/) /\\n/)*", ("a.\n" + "b\n" * 2) * MANY, ("a.\n" + "\n" * 2) * MANY),
    ("main := a@/[^\\n]*\\n/ b@/[^\\n]*\\n/ !b !a /.*/", "é" * MANY + "\n" + "😀a" * MANY + "\nrest" * MANY, "😀a" * MANY + "\n" + "é" * MANY + "\n" + ("\nrest" * MANY)[1:]),
    ('main := (~/a/ [as += "a"] | ~/[0-9]+/ [ns += "#"] | ~/./)* !ns !as', "a12é" * MANY, "#" * MANY + "a" * MANY),
    ("main := /[a-z ]{3,}/", "ab " * MANY, "ab " * MANY),
]


@pytest.mark.parametrize("program,text,expected", LONG)
def test_native_forms_on_long_texts(spark, program, text, expected):
    p = compile_program(program)
    df = spark.createDataFrame([(text,), (text[:3001],)], "s string").coalesce(1)
    long, short = df.select(p.column("s", "native"), p.accepts("s")).collect()
    assert long[0] == expected and long[1]
    assert short[0] == p.run(text[:3001]).value


@pytest.mark.parametrize("program", ["main := /[a-z]*[a-z]*[a-z]*[a-z]*x/", "main := /(a|ab)*c/", "main := /(a*b?)+x/", "main := /.*,[a,]*!/", "main := /(ab|c)*?x/ | /(aa){,300}/"])
def test_patterns_that_search_too_long_are_not_native(spark, program):
    p = compile_program(program)
    assert p.forms[0][0] == "kernel"
    text = "abc,a" * 400
    df = spark.createDataFrame([(text,), ("abx",), ("ab,!",)], "s string").coalesce(1)
    assert [tuple(r) for r in df.select(p.column("s"), p.accepts("s")).collect()] == [(o.value, o.ok) for o in map(p.run, (text, "abx", "ab,!"))]


def test_results_and_records(spark):
    df = spark.createDataFrame([("ab",), ("ax",), ("a",), (None,)], "s string")
    p = compile_program('main := /a/ ~/b/ "!"')
    assert [tuple(r.r) if r.r else None for r in df.select(p.result("s").alias("r")).collect()] == [(True, "a!", None), (False, None, 1), (False, None, 1), None]
    with pytest.raises(Exception, match="rejects"):
        df.select(p.or_raise("s")).collect()
    rec = compile_program("main := key ~/=/ value\nkey := /[a-z]+/\nvalue := /[0-9]+/")
    out = rec.parse_records(spark.createDataFrame([("a=1",), ("=",)], "s string"), "s").collect()
    assert [(r.key, r.value) for r in out] == [("a", "1"), (None, None)]
    assert [r[0] for r in spark.createDataFrame([("7",), ("x",)], "s string").select(compile_regex("[0-9]").codes("s")).collect()] == [[7], None]
    b = spark.createDataFrame([(bytearray("é".encode()),)], "b binary").select(compile_program("main := /./ ~/./", binary=True).column("b")).first()[0]
    assert bytes(b) == b"\xc3"
    assert compile_program("main := /a/").automaton(spark).count() > 0


def test_sql_functions(spark):
    compile_program('main := ("<" /[0-9]+/ ">" | /./)*').register(spark, "marked")
    assert spark.sql("SELECT marked('a12')").first()[0] == "a<12>"
    compile_program("main := (/[^\\n]*\\n/)*").register_table_function(spark, "records")
    assert [tuple(r) for r in spark.sql("SELECT * FROM records('x\ny\n')").collect()] == [(0, "x"), (1, "y")]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_chunks(spark, size):
    p = compile_program('main := ("<" /[a-z]+/ ">" | "#" ~/[0-9]+/ | /[^q]/)*')
    texts = {1: "abc12def 7", 2: "", 3: "abqc", 4: "zz\n99"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = join_chunks(run_chunked(p, split_chunks(df, "doc_id", "text", size)), "doc_id").collect()
    assert {r.doc_id: r.output for r in out} == {k: p.run(t).value for k, t in texts.items()}
    with pytest.raises(ValueError):
        run_chunked(compile_program("main := a@/./ !a"), df)


def test_document_state():
    p = compile_program('start: a >> b\na := (/x/ | ~/y/)*\nb := (/x/ "1")*')
    chunks = [(2, "x", True), (0, "xy", False), (1, "yx", False), (1, "yx", False)]
    document, rows = Document(p.stages().machines), []
    for chunk in chunks:
        rows += document.feed(*chunk)
        document = Document(p.stages().machines, json.loads(json.dumps(document.save())))
    assert "".join(r[0] for r in rows) == p.run("xyyxx").value and rows[-1][1] == "done"
    bad = Document(p.stages().machines).feed(0, "xz", False)
    assert bad[-1][1] == "rejected"


def test_stream(spark, tmp_path):
    p = compile_program('main := (k@/[a-z]+/ ~/ / !k "," | /\\n/)*')
    rows = [(1, 0, "ab c", False), (1, 1, "d \n", True), (2, 0, "A", True), (3, 0, "x", False)]
    spark.createDataFrame(rows, "doc_id long, seq long, chunk string, last boolean").write.parquet(f"{tmp_path}/in")
    stream = sources.stream_table(spark, f"{tmp_path}/in", "doc_id long, seq long, chunk string, last boolean")
    out = run_stream(p, stream)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    done = collect_outputs(spark.read.schema(out.schema).parquet(f"{tmp_path}/out"))
    assert {r.doc_id: r.output for r in done.collect()} == {1: "ab,cd,\n", 2: None}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "s string").coalesce(1)
    sources.write_lines(df, "s", f"{tmp_path}/lines")
    assert sorted(r.value for r in sources.read_lines(spark, f"{tmp_path}/lines").collect()) == ["a", "b"]
    assert [r.value for r in sources.read_documents(spark, f"{tmp_path}/lines").collect()] == ["a\nb\n"]
    assert b"a\nb\n" in [bytes(r.content) for r in sources.read_binary(spark, f"{tmp_path}/lines/*.txt").collect()]
    sources.write_table(df, f"{tmp_path}/table")
    assert sources.read_table(spark, f"{tmp_path}/table", "s").columns == ["s"]
    (tmp_path / "p.loom").write_text("main := /a/")
    (tmp_path / "p.re").write_text("a|b/c\n")
    assert load_program(str(tmp_path / "p.loom")).run("a").ok and load_program(str(tmp_path / "p.re")).run("b/c").ok


def test_entry():
    import __spark_entry__ as e

    own = [q for q in e.queries() if not q.startswith("op") and q != "pipeline"]
    assert len(own) > 60 and set(own) <= set(e.oracle_sql())
