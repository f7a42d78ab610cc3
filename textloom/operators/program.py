"""Programs over DataFrame columns."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.plans import checks
from textloom.plans.graph import Graph
from textloom.plans.lower import NotNative, acceptance, fields, inline, literal, lower
from textloom.plans.parser import parse_program, parse_regex
from textloom.plans.syntax import Near, Source

from .batch import Batch, blocks
from .machine import Machine, Outcome

ENGINES = ("auto", "native", "kernel", "backtrack")


class Stages:
    """The machines of a program; pickled as source text and options, built once in each worker."""

    def __init__(self, source: Source, metric: str, mode: str, binary: bool, copying: bool, codes: bool = False):
        self.options = (source, metric, mode, binary, copying, codes)

    def __getstate__(self):
        return {"options": self.options}

    @functools.cached_property
    def machines(self) -> list[Machine]:
        source, metric, mode, binary, copying, codes = self.options
        return [Machine(Graph(source, rule, metric, mode, binary, codes), copying) for rule in source.pipeline]

    @functools.cached_property
    def batches(self) -> list[Batch]:
        return [Batch(m) for m in self.machines]

    def run_all(self, texts, engine: str = "kernel", first: int = 0, last: int | None = None) -> list[Outcome]:
        """The outcome of each text; that of None is a rejection without a place."""
        if engine != "kernel":
            return [self.run(t, engine, first, last) for t in texts]
        out = [Outcome(False, None, None)] * len(texts)
        # a block goes through all stages before the next, so that no more is held between stages
        for rows in blocks([None if t is None else len(t) for t in texts]):
            done = [Outcome(True, texts[k], None) for k in rows]
            for batch in self.batches[first:last]:
                after = batch.run([o.value if o.ok else None for o in done])
                done = [o if d is None else d for o, d in zip(done, after, strict=True)]
            for k, o in zip(rows, done, strict=True):
                out[k] = o
        return out

    def run_array(self, values: pa.Array, engine: str = "kernel", first: int = 0, last: int | None = None) -> pa.Array:
        """The outputs of an Arrow array of texts; only those of a block are Python strings at a time."""
        parts, order = [], []
        for rows in blocks(pc.utf8_length(values).to_pylist()):
            texts = values.take(pa.array(rows)).to_pylist()
            parts.append(pa.array([o.value for o in self.run_all(texts, engine, first, last)], values.type))
            order += rows
        if not parts:
            return pa.nulls(len(values), values.type)
        place = np.full(len(values), -1, dtype=np.int64)
        place[order] = np.arange(len(order))
        return pa.concat_arrays(parts).take(pa.array(place, mask=place < 0))

    def run(self, text: str | None, engine: str = "kernel", first: int = 0, last: int | None = None) -> Outcome:
        if text is None:
            return Outcome(False, None, None)
        out = Outcome(True, text, None)
        for machine in self.machines[first:last]:
            out = machine.run(out.value) if engine == "kernel" else machine.backtrack(out.value)
            if not out.ok:
                return out
        return out


class Program:
    """A checked program. Columns are null where the input is null or rejected."""

    def __init__(self, text: str, metric: str = "lcs", mode: str = "correction", binary: bool = False, copying: bool = False):
        self.text = text
        self.source, places = parse_program(text)
        checks.check(self.source, places)
        self.metric, self.mode, self.binary, self.copying = metric, mode, binary, copying
        Graph(self.source, self.source.pipeline[0], metric, mode, binary)  # faults in options show here
        self.forms: list[tuple[str, object]] = []
        for rule in self.source.pipeline:
            try:
                if binary:
                    raise NotNative("bytes")
                self.forms.append(lower(self.source, rule, copying))
            except NotNative as why:
                self.forms.append(("kernel", str(why)))

    def stages(self, codes: bool = False) -> Stages:
        return Stages(self.source, self.metric, self.mode, self.binary, self.copying, codes)

    def run(self, text: str, engine: str = "kernel") -> Outcome:
        """The outcome for one text, on the driver."""
        return self.stages().run(text, engine)

    def column(self, value: Column | str, engine: str = "auto") -> Column:
        """Output for each value. Stages with a native form are expressions, runs of others one Arrow function."""
        if engine not in ENGINES:
            raise ValueError(f"engine is one of {ENGINES}")
        value = F.col(value) if isinstance(value, str) else value
        if engine == "native" and any(name == "kernel" for name, _ in self.forms):
            raise NotNative("; ".join(str(why) for name, why in self.forms if name == "kernel"))
        at = 0
        while at < len(self.forms):
            name, form = self.forms[at]
            if engine in ("auto", "native") and name != "kernel":
                value, at = form(value), at + 1
                continue
            last = at + 1
            while last < len(self.forms) and (engine not in ("auto",) or self.forms[last][0] == "kernel"):
                last += 1
            value, at = self._kernel(at, last, "backtrack" if engine == "backtrack" else "kernel")(value), last
        return value

    def _kernel(self, first: int, last: int, engine: str):
        stages = self.stages()
        if self.binary:

            @F.pandas_udf("binary")
            def run(values: pd.Series) -> pd.Series:
                done = stages.run_all([None if v is None else bytes(v).decode("latin-1") for v in values], engine, first, last)
                return pd.Series([None if o.value is None else o.value.encode("latin-1") for o in done], dtype=object)

            return run

        @F.arrow_udf("string")
        def run_text(values: pa.Array) -> pa.Array:
            return stages.run_array(values, engine, first, last)

        return run_text

    def result(self, value: Column | str) -> Column:
        """struct(ok, value, error_pos): error_pos is in the input of the stage that rejects; null input gives null."""
        stages = self.stages()
        kind = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("value", T.StringType()), T.StructField("error_pos", T.LongType())])

        @F.pandas_udf(kind)
        def run(values: pd.Series) -> pd.DataFrame:
            done = stages.run_all(values)
            frame = pd.DataFrame({"ok": [o.ok for o in done], "value": pd.Series([o.value for o in done], dtype=object)})
            frame["error_pos"] = pd.array([o.error_pos for o in done], dtype="Int64")
            return frame

        value = F.col(value) if isinstance(value, str) else value
        return F.when(value.isNotNull(), run(value))

    def or_raise(self, value: Column | str) -> Column:
        """Output for each value; a rejected one is an error of the job."""
        value = F.col(value) if isinstance(value, str) else value
        return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(self.column(value), F.raise_error(F.concat(F.lit("the program rejects: "), F.substring(value, 1, 80))).cast("string")))

    def accepts(self, value: Column | str, engine: str = "auto") -> Column:
        """Whether each value is accepted; a built-in predicate where there is one."""
        value = F.col(value) if isinstance(value, str) else value
        if engine == "auto" and len(self.source.pipeline) == 1 and not self.binary:
            term = self.source.rules[self.source.pipeline[0]]
            text = None
            if isinstance(term, Near):
                try:
                    text = literal(inline(term.body, self.source.rules))
                except NotNative:
                    text = None
            if text is not None and self.metric == "levenshtein":
                return F.levenshtein(value, F.lit(text), term.errors) >= 0
            if text is not None and self.metric == "hamming":
                differ = F.zip_with(F.split(value, ""), F.split(F.lit(text), ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
                return (F.char_length(value) == len(text)) & (F.aggregate(differ, F.lit(0), lambda a, b: a + b) <= term.errors)
            if not isinstance(term, Near):
                try:
                    return value.rlike(acceptance(self.source, self.source.pipeline[0]))
                except NotNative:
                    pass
        return F.when(value.isNotNull(), self.result(value)["ok"])

    def codes(self, value: Column | str) -> Column:
        """Parse code of a single-stage program: alternatives taken and ranks of symbols read."""
        if len(self.source.pipeline) != 1:
            raise ValueError("parse codes belong to programs of one stage")
        stages = self.stages(codes=True)

        @F.pandas_udf("array<int>")
        def run(values: pd.Series) -> pd.Series:
            return pd.Series([None if v is None else stages.machines[0].parse_codes(v) for v in values], dtype=object)

        return run(F.col(value) if isinstance(value, str) else value)

    def parse_records(self, df: DataFrame, value: str, rule: str | None = None) -> DataFrame:
        """df with a column for each rule that the record rule calls; rows that are no record have nulls."""
        regex, names = fields(self.source, rule or self.source.pipeline[0])
        good = F.col(value).rlike(regex)
        return df.select("*", *[F.when(good, F.regexp_extract(F.col(value), regex, k)).alias(n) for k, n in enumerate(names, 1)])

    def register(self, spark: SparkSession, name: str) -> None:
        """Make the program a scalar function of SQL."""
        stages = self.stages()

        @F.pandas_udf("string")
        def run(values: pd.Series) -> pd.Series:
            return pd.Series([o.value for o in stages.run_all(values)], dtype=object)

        spark.udf.register(name, run)

    def register_table_function(self, spark: SparkSession, name: str, separator: str = "\n") -> None:
        """Make the program a table function of SQL: rows (pos, record) of the output, cut at a separator."""
        stages = self.stages()

        @F.udtf(returnType="pos int, record string")
        class Records:
            def eval(self, value: str):
                out = stages.run(value).value
                if out is not None:
                    parts = out.split(separator)
                    for k, part in enumerate(parts[:-1] if parts[-1] == "" else parts):
                        yield k, part

        spark.udtf.register(name, Records)

    def explain(self) -> str:
        """One line for each stage: its form, or why it runs in the kernel."""
        return "\n".join(f"{rule}: {name}" + (f" ({why})" if name == "kernel" else "") for rule, (name, why) in zip(self.source.pipeline, self.forms, strict=True))

    def edges(self, stage: int = 0) -> list[tuple[int, str, str, int]]:
        """The automaton of a stage: (node, what it reads, what it does, next node)."""
        out = []
        for k, node in enumerate(self.stages().machines[stage].graph.nodes):
            for n, target in enumerate(node.targets):
                reads = node.chars.java() if node.kind == "read" else ""
                does = "copy" if node.copies else "" if node.kind == "read" else repr(node.act) if node.kind == "act" else f"choice {n}"
                out.append((k, reads, does, target))
        return out

    def automaton(self, spark: SparkSession, stage: int = 0) -> DataFrame:
        return spark.createDataFrame(self.edges(stage), "node int, reads string, does string, target int")

    def to_dot(self, stage: int = 0) -> str:
        """The automaton in the language of Graphviz."""
        machine = self.stages().machines[stage]
        quoted = lambda s: s.replace("\\", "\\\\").replace('"', '\\"')
        lines = ["digraph stage {", "  rankdir=LR;", f'  start [shape=point]; start -> n{machine.graph.start};', f"  n{machine.graph.end} [shape=doublecircle];"]
        lines += [f'  n{a} -> n{b} [label="{quoted(r or d)}{"/" + quoted(d) if r and d else ""}"];' for a, r, d, b in self.edges(stage)]
        return "\n".join([*lines, "}"])


@functools.lru_cache(maxsize=256)
def compile_program(text: str, metric: str = "lcs", mode: str = "correction", binary: bool = False, copying: bool = False) -> Program:
    """Parse, check and lower a program."""
    return Program(text, metric, mode, binary, copying)


def compile_regex(regex: str) -> Program:
    """The program that copies what a regex matches; its codes are the regex's parse trees."""
    parse_regex(regex)
    return compile_program("main := /" + "".join("\\/" if c == "/" and (k == 0 or regex[k - 1] != "\\") else c for k, c in enumerate(regex)) + "/")


def load_program(path: str, **options) -> Program:
    """A program from a file: of the language, or (suffix .re or .rx) a regex."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    return compile_regex(text.rstrip("\n")) if path.endswith((".re", ".rx")) else compile_program(text, **options)
