"""The language: front end, checks, and the meaning of every term, on all engines."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom import ProgramError, compile_program, compile_regex
from textloom.functions.charset import ANY, CharSet, minterms
from textloom.operators.machine import Incremental, Machine, between, summary
from textloom.plans.graph import Graph
from textloom.plans.parser import parse_program, parse_regex
from textloom.plans.syntax import Repeat

RANGES = """main := (line /\\n/)*
line := x3 | y2 | z3 | w23
x3 := ~/x/{3} "three x" | ~/x*/ "some x"
y2 := ~/y/{2,} "many y" | ~/y*/ "few y"
z3 := ~/z/{,3} "few z" | ~/z*/ "many z"
w23 := ~/w/{2,3} "right w" | ~/w*/ "wrong w"
"""

CASES = [
    ("main := /[a-c]+/", "abc", "abc"),
    ("main := /[a-c]+/", "abd", None),
    ('main := "x\\n\\x41"', "", "x\nA"),
    ("main := ~/a/ /b/", "ab", "b"),
    ("main := twice\ntwice := ~once once\nonce := /a/ | /b/", "ab", "b"),
    ("main := 1", "", ""),
    ('main := (~/b/ "first" | ~/b/ "second")', "b", "first"),
    ('main := ~/a/* "!"', "aaa", "!"),
    ('main := (~/a/ "1")+', "aa", "11"),
    ('main := (~/a/ "1")+', "", None),
    ('main := (~/a/ "x") (~/c/ "y")?', "a", "x"),
    ('main := ((~/q/ "1")? (~/q/ "2")? (~/q/ "3") (~/q/ "4")? (~/q/ "5")?)', "qqq", "123"),
    (RANGES, "x\nxxx\nyyy\ny\nzzz\nzzzz\nw\nww\nwwww\n", "some x\nthree x\nmany y\nfew y\nfew z\nmany z\nwrong w\nright w\nwrong w\n"),
    ("start: p >> q >> r\np := ~/pq/ \"p\"\nq := /p/ \"q\"\nr := /pq/ \"r\"", "pq", "pqr"),
    ("main := u@/a+/ v@/b+/ !v !u", "aabb", "bbaa"),
    ('main := u@/a+/ [v <- "<" u ">"] !v !u', "aa", "<aa>"),
    ('main := (u@/./ [all += u ","])* !all', "xyz", "x,y,z,"),
    ("main := ~(u@/a/) !u", "a", ""),
    ('main := ~([u <- "t"]) !u', "", "t"),
    ("main := (loop /;/)*\nloop := (ps qs)*\nps := (~/p/ \"P\")*\nqs := (~/q/ \"Q\")*", "pq;qp;;", "PQ;QP;;"),
    ("main := /(ab)*/", "aba", None),
    ("main := /é+/", "éé", "éé"),
    ("main := ~/.*?x/ /.*/", "axbx", "bx"),
    ("main := /a{2}b{1,2}c{1,}/", "aabbccc", "aabbccc"),
    ('main := ("a" /[^a]/ main) | /a/', "xya", "axaya"),
    ('main := r // end of line\n/* a note */ r := /[0-9]/ "\\""', "7", '7"'),
]


@pytest.mark.parametrize("program,text,expected", CASES)
def test_meaning(program, text, expected):
    p = compile_program(program)
    assert p.run(text).value == expected
    assert p.run(text, "backtrack").value == expected
    if len(p.source.pipeline) == 1:
        stage = Incremental(p.stages().machines[0])
        out = "".join(stage.push(c) for c in text)
        good, rest = stage.finish()
        assert (out + rest if good else None) == expected


@pytest.mark.parametrize("program,text,expected", CASES)
def test_columns(spark, program, text, expected):
    p = compile_program(program)
    df = spark.createDataFrame([(text,), (None,)], "s string")
    assert [r[0] for r in df.select(p.column("s")).collect()] == [expected, None]


def test_move_and_copy():
    assert compile_program("main := u@/a/ !u !u").run("a").value == "a"
    assert compile_program("main := u@/a/ !u !u", copying=True).run("a").value == "aa"


def test_precedence():
    assert compile_program('main := ~/a/* "x"').run("aa").value == "x"
    assert compile_program("main := r@/a/* !r").run("aa").value == "a"  # each round overwrites r
    p, _ = parse_program("main := /a/*?")
    assert isinstance(p.rules["main"], Repeat) and isinstance(p.rules["main"].body, Repeat)


def test_bytes():
    p = compile_program("main := /./ ~/./", binary=True)
    assert p.run("é".encode().decode("latin-1")).value.encode("latin-1") == b"\xc3"


@pytest.mark.parametrize(
    "program,line",
    [("main := x", 1), ("main := /a/ main /b/ | 1", 1), ("main := (/a/ main)*", 1), ("start: q\nmain := 1", 1), ('main := "a', 1), ("a := 1\na := 1", 2), ("main := (/a/<1>)<2>", 1), ("main := /a{2,1}/", 1), ("main := /[a/", 1), ("main := r@main", 1), ("", 1), ("main := /[[:alpha:]]/", 1), ('main := "\\q"', 1), ("main := [r <- ]", 1), ("main := x<2>\nx := y\ny := /a/<1>", 1)],
)
def test_faults(program, line):
    with pytest.raises(ProgramError) as fault:
        compile_program(program)
    assert fault.value.line == line


APPROXIMATE = [("levenshtein", 1, "/a/", {"": 1, "b": 1, "ab": 1, "ba": 1, "a": 1, "abb": 0, "bba": 0}), ("hamming", 1, "/ab/", {"bb": 1, "aa": 1, "abc": 0, "": 0, "cc": 0}), ("lcs", 2, "/abc/", {"abc": 1, "ac": 1, "axbc": 1, "axc": 1, "a": 1, "xyabc": 1, "": 0})]


@pytest.mark.parametrize("metric,k,body,cases", APPROXIMATE)
def test_approximate_acceptance(metric, k, body, cases):
    for text, good in cases.items():
        for mode in ("correction", "matching", "explicit"):
            assert compile_program(f"main := {body}<{k}>", metric=metric, mode=mode).run(text).ok == bool(good), (text, mode)


def test_approximate_output():
    out = lambda mode, metric, text: compile_program("main := /hello/<2>", metric=metric, mode=mode).run(text).value
    assert [out("correction", "levenshtein", t) for t in ("hello", "helo", "hallo", "yhellow")] == ["hello"] * 4
    assert out("matching", "levenshtein", "hallo") == "hallo"
    assert out("explicit", "levenshtein", "hallo") == "haRello"
    assert out("explicit", "lcs", "helo") == "helIlo"
    assert out("explicit", "levenshtein", "hellox") == "helloDx"
    # suppressed terms are not approximated
    assert compile_program("main := ~(/a/<1>) /b/", metric="hamming").run("cb").value is None


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=5), st.text("abc", max_size=7), st.integers(1, 3))
def test_levenshtein_agrees(word, text, k):
    p = compile_program(f"main := ({' '.join(f'/{c}/' for c in word) or '1'})<{k}>", metric="levenshtein", mode="explicit")
    out = p.run(text)
    d = distance(word, text)
    assert out.ok == (d <= k)
    if out.ok:
        assert sum(c in "IDR" for c in out.value) == d


def test_parse_codes():
    assert compile_regex("(a|b)*[0-9]").stages(codes=True).machines[0].parse_codes("ab7") == [0, 0, 0, 1, 1, 7]
    assert compile_regex("(a|b)*?c").stages(codes=True).machines[0].parse_codes("bc") == [1, 1, 0]
    assert compile_regex("a").stages(codes=True).machines[0].parse_codes("b") is None


REGEXES = st.recursive(
    st.sampled_from(["a", "b", "[ab]", ".", "c"]),
    lambda inner: st.one_of(st.tuples(inner, inner).map("".join), st.tuples(inner, inner).map(lambda t: f"(?:{t[0]}|{t[1]})"), st.tuples(inner, st.sampled_from(["*", "+", "?", "*?", "{1,2}"])).map(lambda t: f"(?:{t[0]}){t[1]}")),
    max_leaves=6,
)


@settings(max_examples=200, deadline=None)
@given(REGEXES, st.text("abc", max_size=8), st.lists(st.integers(0, 8), max_size=3))
def test_engines_agree(regex, text, cuts):
    """Lockstep, backtracking, incremental and chunked parsing give the same parse, seen through marks."""
    program = f'main := ("<" /{regex}/ ">" | "-" /./)*'
    p = compile_program(program)
    machine = Machine(Graph(p.source, "main"))
    out = machine.run(text)
    assert machine.backtrack(text) == out
    ends = sorted({min(c, len(text)) for c in cuts} | {0, len(text)})
    pieces = [text[a:b] for a, b in zip(ends, ends[1:], strict=False)] or [""]
    stage = Incremental(machine)
    parts = []
    for piece in pieces:
        parts.append(stage.push(piece))
        stage = Incremental(machine, stage.save())
    good, rest = stage.finish()
    assert ("".join(parts) + rest if good else None) == out.value
    # chunk summaries compose to the same acceptance
    state = machine.begin()[0]
    nodes = list(machine.states[state])
    for k, piece in enumerate(pieces):
        found = summary(machine, piece, k == len(pieces) - 1)
        if k == 0:
            nodes = [n for n in nodes if n in found]
        seen = {}
        for n in nodes:
            for m in found.get(n, ()):
                seen.setdefault(m)
        nodes = list(seen)
    if text:
        assert (machine.graph.end in nodes) == out.ok
        if out.ok and len(pieces) == 1:
            path = between(machine, text, None, machine.graph.end)
            assert "".join(a if isinstance(a, str) else s for acts, s in path for a in acts) == out.value


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300)), max_size=5), st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300)), max_size=5))
def test_charsets(x, y):
    a, b = CharSet.of(x), CharSet.of(y)
    sa, sb = ({c for lo, hi in p if lo <= hi for c in range(lo, hi + 1)} for p in (x, y))
    probe = range(0, 310)
    assert {c for c in probe if c in (a | b)} == sa | sb
    assert {c for c in probe if c in (a & b)} == sa & sb
    assert {c for c in probe if c in ~a} == set(probe) - sa
    assert len(a) == len(sa) and (a <= b) == (sa <= sb)
    assert [a.member(a.rank(c)) for c in sorted(sa)] == sorted(sa)
    parts = minterms([a, b])
    assert sum(map(len, parts)) == len(ANY)
    assert all(not (p & q) for k, p in enumerate(parts) for q in parts[:k])


def test_linear_on_ambiguous_input():
    p = compile_program("main := /(a?){28}a{28}/")
    assert p.run("a" * 28).ok
    p = compile_program('main := (/x+/ /x+/)+ "!" /y/')
    assert not p.run("x" * 400).ok


def test_shapes():
    p = compile_program('main := ("<" /[a-z]+/ ">" | /./)*')
    assert p.explain() == "main: tokens"
    assert "doublecircle" in p.to_dot() and p.edges()
    assert parse_regex("a|b") is not None
