"""Programs over streams of chunks, with output as soon as it is certain.

The state of a document is small: for each stage the node that all live paths come from,
the text read since, and the registers. Chunks that arrive early wait for their turn.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators.machine import Incremental
from textloom.operators.program import Program

STATE = "value string"


class Document:
    """All stages of a program over one document that arrives in pieces."""

    def __init__(self, machines, saved: dict | None = None):
        saved = saved or {"stages": [None] * len(machines), "next": 0, "early": {}, "over": False, "out": 0}
        self.stages = [Incremental(m, s) for m, s in zip(machines, saved["stages"], strict=True)]
        self.next, self.early, self.over, self.out = saved["next"], {int(k): tuple(v) for k, v in saved["early"].items()}, saved["over"], saved["out"]

    def save(self) -> dict:
        # of a finished document only that it is over is kept
        return {"stages": [None if self.over else s.save() for s in self.stages], "next": self.next, "early": self.early, "over": self.over, "out": self.out}

    def feed(self, seq: int, chunk: str, last: bool) -> list[tuple[str, str]]:
        """(output, status) rows: status is running, then done or rejected once; a repeated chunk is ignored."""
        if self.over or seq < self.next:
            return []
        self.early[seq] = (chunk, last)
        out, rows = "", []
        while not self.over and self.next in self.early:
            chunk, last = self.early.pop(self.next)
            self.next += 1
            out += self._push(chunk)
            if last or any(s.failed for s in self.stages):
                rest, good = self._finish() if not any(s.failed for s in self.stages) else ("", False)
                self.over = True
                self.early = {}
                rows = [(out + rest, "done" if good else "rejected")]
                out = ""
        return [(out, "running")] if out and not rows else rows

    def _push(self, text: str) -> str:
        for stage in self.stages:
            text = stage.push(text)
        return text

    def _finish(self) -> tuple[str, bool]:
        rest = ""
        for stage in self.stages:
            rest = stage.push(rest)
            good, end = stage.finish()
            rest += end
            if not good:
                return rest, False
        return rest, True


def run_stream(program: Program, chunks: DataFrame, key: str = "doc_id", seq: str = "seq", chunk: str = "chunk", last: str = "last") -> DataFrame:
    """Rows (key, out_seq, output, status) of a streaming DataFrame of chunks.

    chunks: key, seq (from 0, without gaps, in any order of arrival), chunk and last
    (whether the document ends with it). The outputs of a document in the order of
    out_seq make up its output; a rejected one may have written before its last row says so.
    Of a finished document a few bytes of state stay, by which chunks that come again are known.
    """
    stages = program.stages()
    kind = chunks.schema[key].dataType.simpleString()

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        document = Document(stages.machines, json.loads(state.get[0]) if state.exists else None)
        rows = []
        for pdf in batches:
            for s, text, end in zip(pdf[seq], pdf[chunk], pdf[last], strict=True):
                for output, status in document.feed(int(s), text or "", bool(end)):
                    rows.append((name[0], document.out, output, status))
                    document.out += 1
        state.update((json.dumps(document.save()),))
        if rows:
            yield pd.DataFrame(rows, columns=[key, "out_seq", "output", "status"])

    rows = chunks.select(key, F.col(seq).cast("long").alias(seq), chunk, F.col(last).cast("boolean").alias(last))
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, out_seq long, output string, status string", STATE, "append", GroupStateTimeout.NoTimeout)


def collect_outputs(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each finished document of run_stream's rows: key and output, null if it was rejected."""
    parts = F.array_sort(F.collect_list(F.struct("out_seq", "output")))
    done = rows.groupBy(key).agg(parts.alias("_parts"), F.max(F.col("status") == "rejected").alias("_bad"), F.max(F.col("status") != "running").alias("_over"))
    return done.filter("_over").select(key, F.when(~F.col("_bad"), F.array_join(F.transform("_parts", lambda p: p["output"]), "")).alias("output"))
