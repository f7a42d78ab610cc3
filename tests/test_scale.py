"""Steps whose cost must not grow faster than the input."""

import json
import random
import tracemalloc

import pyarrow as pa
import pytest

from textloom import compile_program
from textloom.operators import batch as batches
from textloom.operators.chunked import _Composer, run_chunked, split_chunks
from textloom.operators.machine import summary

LINES = "main := (/[^\\n]*[.]/ | ~/[^\\n]*/) (/\\n/ (/[^\\n]*[.]/ | ~/[^\\n]*/))*"
WORDS = 'main := ("\\"" /[a-zA-Z]+/ "\\"" | /./)*'
STRICT = 'main := "s" (/ab/ "X" | ~/a/ "y" | /b+?/ "Z" | /\\n/ | /[.]/)* "e" /q?/'


def _chunked(program, texts, size):
    """The outputs of texts in chunks, put together without Spark."""
    stages = program.stages()
    rows = [(k, s, t[a : a + size]) for k, t in enumerate(texts) for s, a in enumerate(range(0, max(len(t), 1), size))]
    found = stages.batches[0].summaries([r[2] for r in rows], [r[1] == 0 for r in rows])
    end, out = stages.machines[0].graph.end, []
    for (_, seq, text), told in zip(rows, found, strict=True):
        if seq:
            for final in (True, False):
                assert {n: tuple(m for m in v if (m == end) == final) for n, v in told.items()} == summary(stages.machines[0], text, final)
    fix = _Composer(end).fix
    for k in range(len(texts)):
        mine = [n for n, r in enumerate(rows) if r[0] == k]
        fixed = fix([rows[n][1] for n in mine], [json.dumps(found[n]) for n in mine])
        if fixed[0][1] < 0:
            out.append(None)
        else:
            out.append("".join(stages.batches[0].between([rows[n][2] for n in mine], [None if s == 0 else e for s, (e, _) in enumerate(fixed)], [leave for _, leave in fixed])))
    return out


@pytest.mark.parametrize("few", [0, 3, 12])
@pytest.mark.parametrize("program", [LINES, WORDS, STRICT])
def test_chunks_in_blocks(monkeypatch, program, few):
    """Chunks that step together tell and write what each tells and writes alone."""
    monkeypatch.setattr(batches, "FEW", few)
    monkeypatch.setattr(batches, "BLOCK", 500)
    rng, p = random.Random(3), compile_program(program)
    texts = ["".join(rng.choices("ab.\nq0é😀\0", (9, 9, 2, 3, 0.2, 1, 0.2, 0.1, 0.1), k=k)) for k in (0, 1, 2, 40, 40, 130, 300)] + ["abab.\nbb", "q", "a\n\nbq"]
    for size in (1, 3, 50, 1000):
        assert _chunked(p, texts, size) == [p.run(t).value for t in texts]


@pytest.mark.parametrize("program", [LINES, WORDS])
def test_chunks_ask_the_machine_once(monkeypatch, program):
    """The machine is asked for each new step, not for each symbol and entry node; no document has a call of its own."""
    stages = compile_program(program).stages()
    machine, asked = stages.machines[0], []
    monkeypatch.setattr(machine, "step", lambda state, symbol, step=machine.step: asked.append(symbol) or step(state, symbol))
    texts = [f"Line {k} of it.\nnext one\n" * 40 for k in range(50)]
    stages.batches[0].summaries(texts, [False] * len(texts))
    assert 0 < len(asked) < 500


@pytest.mark.parametrize("program", [LINES, WORDS])
def test_chunks_move_once(spark, program):
    """Of the text only the last pass has an exchange, and documents are composed in batches."""
    df = spark.createDataFrame([(1, "a.\nb"), (2, None), (3, "")], "doc_id long, text string")
    done = run_chunked(compile_program(program), split_chunks(df, "doc_id", "text", 2))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "FlatMapGroupsInPandas" not in plan
    assert {(r.doc_id, r.seq) for r in done.collect()} == {(1, 0), (1, 1), (3, 0)}


THREE = 'start: strip >> join >> quote\nstrip := (~/[0-9]+/ | /./)*\njoin := (~/\\n/ "|" | /./)*\nquote := ("<" /[A-Z]+/ ">" | /./)*'


@pytest.mark.parametrize("program", [THREE, "main := a@/[^ ]*/ (/ / | /[^ ]/)* !a"])
def test_stages_in_parts(monkeypatch, program):
    """Outputs put together in parts, and of an Arrow array, are those of each text alone."""
    monkeypatch.setattr(batches, "BLOCK", 300)
    monkeypatch.setattr(batches, "PART", 7)
    rng, p = random.Random(5), compile_program(program)
    texts = [None, "", *["".join(rng.choices("aB1\n é", k=k)) for k in (1, 6, 7, 8, 90, 3, 90)], None]
    want = [None if t is None else p.run(t).value for t in texts]
    assert [o.value for o in p.stages().run_all(texts)] == want
    assert p.stages().run_array(pa.array(texts, pa.string())).to_pylist() == want
    assert p.stages().run_array(pa.array([None], pa.string())).to_pylist() == [None]


def test_stages_hold_one_block():
    """What a batch needs besides its texts is that of one block, put together in parts."""
    stages = compile_program(THREE).stages()
    texts = ["Some TEXT of 12 words\n" * 100] * 950  # 2,090,000 symbols: one block
    stages.run_all(texts[:20])
    tracemalloc.start()
    stages.run_all(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * sum(map(len, texts))
