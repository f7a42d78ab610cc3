"""Chunk-parallel parsing of documents that are too long for one task.

Pass 1 reads every chunk on its own, from every node at which its predecessor could leave
off, and keeps where each of these paths can end (a summary). Summaries of a document
compose in order; that is the only step that sees a whole document, and it sees no text.
Pass 2 fixes the node at which the accepted path enters and leaves each chunk, and pass 3
writes the output of every chunk on its own.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .program import Program


def split_chunks(df: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """Rows (key, seq, chunk) of at most `size` characters; an empty text is one empty chunk."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(value), F.lit(1)), F.lit(size))
    return df.filter(F.col(value).isNotNull()).select(F.col(key), F.col(value).alias("_v"), F.posexplode(starts).alias("seq", "_at")).select(key, "seq", F.substring(F.col("_v"), F.col("_at"), F.lit(size)).alias("chunk"))


def run_chunked(program: Program, df: DataFrame, key: str = "doc_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """Rows (key, seq, output) of a single-stage program over documents in chunks.

    The outputs of a document, joined in the order of seq, are the program's output; a
    rejected document has null outputs. A chunk that writes nothing has an empty output.
    """
    if len(program.source.pipeline) != 1:
        raise ValueError("stages are run one after the other: join the output of one before the next")
    if any(n.kind == "act" and not isinstance(n.act, str) for n in program.stages().machines[0].graph.nodes):
        raise ValueError("registers carry text across chunks: run the program on whole documents or as a stream")
    stages = program.stages()
    kind = df.schema[key].dataType.simpleString()
    df = df.filter(F.col(key).isNotNull()).select(F.col(key), F.col(seq).cast("long").alias(seq), F.col(chunk).alias(chunk))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = stages.batches[0].summaries(pdf[chunk].tolist(), (pdf[seq] == 0).tolist())
            # many chunks share a summary
            told: dict[int, str] = {}
            for s in found:
                if id(s) not in told:
                    told[id(s)] = json.dumps(s)
            yield pd.DataFrame({key: pdf[key], seq: pdf[seq], "_summary": [told[id(s)] for s in found]})

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = _Composer(stages.machines[0].graph.end).fix
        names: list = []
        places: list[int] = []
        told: list[str] = []
        begin, fixed, kept = 0, [], None

        def frame(n: int) -> pd.DataFrame:
            """The rows of the documents that are done, which leave the lists."""
            enter, leave = zip(*fixed, strict=True)
            out = pd.DataFrame({key: pd.Series(names[:n], dtype=kept), seq: places[:n], "_entry": enter, "_leave": leave})
            del names[:n], places[:n], told[:n], fixed[:]
            return out

        for pdf in batches:
            kept = pdf[key].dtype
            for name, place, summary in zip(pdf[key].tolist(), pdf[seq].tolist(), pdf["_summary"].tolist(), strict=True):
                if len(names) > begin and name != names[-1]:
                    fixed += fix(places[begin:], told[begin:])
                    begin = len(names)
                    if begin >= 10_000:
                        yield frame(begin)
                        begin = 0
                names.append(name)
                places.append(place)
                told.append(summary)
        if names:
            fixed += fix(places[begin:], told[begin:])
            yield frame(len(names))

    def third(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = pdf["_leave"] >= 0
            rows = pdf[good]
            entries = [None if s == 0 else n for s, n in zip(rows[seq].tolist(), rows["_entry"].tolist(), strict=True)]
            done = iter(stages.batches[0].between(rows[chunk].tolist(), entries, rows["_leave"].tolist()))
            texts = [next(done) if g else None for g in good]
            yield pd.DataFrame({key: pdf[key], seq: pdf[seq], "output": pd.Series(texts, index=pdf.index, dtype=object)})

    told = df.mapInPandas(first, f"{key} {kind}, {seq} long, _summary string")
    fixed = told.repartition(key).sortWithinPartitions(key, seq).mapInPandas(second, f"{key} {kind}, {seq} long, _entry int, _leave int")
    return df.join(fixed, [key, seq]).mapInPandas(third, f"{key} {kind}, {seq} long, output string")


class _Composer:
    """Finds where the accepted path of a document enters and leaves each chunk, from the summaries alone."""

    def __init__(self, end: int):
        self.end = end
        self.read = functools.lru_cache(maxsize=10_000)(lambda told: {int(k): tuple(v) for k, v in json.loads(told).items()})
        self.after = functools.lru_cache(maxsize=100_000)(self._after)
        self.before = functools.lru_cache(maxsize=100_000)(self._before)

    def _after(self, nodes: tuple[int, ...], told: str, last: bool) -> tuple[int, ...]:
        """Nodes after a chunk, best first; after the last chunk only the end."""
        maps = self.read(told)
        return tuple(dict.fromkeys(m for n in nodes for m in maps.get(n, ()) if (m == self.end) == last))

    def _before(self, nodes: tuple[int, ...], told: str, at: int) -> int:
        """The best node of those that lead there."""
        maps = self.read(told)
        return next(n for n in nodes if at in maps.get(n, ()))

    def fix(self, places: list[int], told: list[str]) -> list[tuple[int, int]]:
        """(entry, leave) of each chunk of one document, in order; -1, -1 if it is rejected."""
        if places[0] != 0:
            raise ValueError("the chunks of a document are numbered from 0")
        nodes, entries, top = (-1,), [], len(told) - 1
        for k, summary in enumerate(told):
            entries.append(nodes)
            nodes = self.after(nodes, summary, k == top)
        if not nodes:
            return [(-1, -1)] * len(told)
        at, out = self.end, []
        for nodes, summary in zip(reversed(entries), reversed(told), strict=True):
            leave, at = at, self.before(nodes, summary, at)
            out.append((at, leave))
        return out[::-1]


def join_chunks(df: DataFrame, key: str, seq: str = "seq", output: str = "output", name: str = "output") -> DataFrame:
    """One row for each document with its chunks' outputs joined; null if any of them is."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(output).alias("o"))))
    return df.groupBy(key).agg(rows.alias("_rows")).select(key, F.when(~F.exists("_rows", lambda r: r["o"].isNull()), F.array_join(F.transform("_rows", lambda r: r["o"]), "")).alias(name))
