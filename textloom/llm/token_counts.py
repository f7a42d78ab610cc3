"""Exact token counts at every prefix, by dynamic programming over last-token states.

count[d] = count[d - length of the last token of the first d symbols] + its weight, so the
token count of every prefix is known without encoding any prefix again: what a limit cuts
off, or how much of a text a budget pays for, is read from the table.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textkit
from .bpe import BLOCK_BYTES, CACHE_WORDS, PrefixBpe

SPACE = "▁"
#: Pieces of the model that only join spaces carry this score and are merged last, leftmost first.


class PieceBpe:
    """A BPE model file of the sentencepiece library with byte fallback and without text normalisation."""

    _loaded: dict[str, PieceBpe] = {}

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" A  ﬁ ") != f"{SPACE} A{SPACE}{SPACE}ﬁ{SPACE}":
            raise ValueError("models that normalise texts are not covered")
        scores, self.runs = {}, {1}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
                continue
            if set(piece) == {SPACE}:
                self.runs.add(len(piece))
            if len(piece) > 1 and set(piece) == {SPACE}:
                continue
            if SPACE in piece[1:]:
                raise ValueError("pieces that join words are not covered")
            scores[piece] = (-model.get_score(i), i)
        ids = {piece: i for piece, (_, i) in scores.items()}
        rank = {i: k for k, (_, i) in enumerate(sorted(scores.values()))}
        joined: dict[tuple[int, int], int] = {}
        text = {i: piece for piece, i in ids.items()}

        def pair_rank(x: int, y: int):
            found = joined.get((x, y), -1)
            if found == -1:
                merged = ids.get(text[x] + text[y])
                found = joined[x, y] = None if merged is None else rank[merged]
            return found

        parts, names = {}, {}
        for piece, i in ids.items():
            tree = self._merge(piece, ids, rank)
            if tree is not None:
                names[piece] = i
                if len(piece) > 1:
                    parts[i] = (*tree, rank[i])
        self.core = PrefixBpe(names, parts, pair_rank)
        # a symbol that no piece of two or more has cannot be merged: it ends a segment
        inside = set().union(*(set(p) for p in names if len(p) > 1)) if names else set()
        self.split = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+" if "\n" not in inside else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.cache: dict[str, array] = {}
        self.total: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> PieceBpe:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @staticmethod
    def _merge(piece: str, ids: dict[str, int], rank: dict[int, int]):
        """The two ids that the last merge of a piece joins; None if merging does not lead to it."""
        parts = list(piece)
        while len(parts) > 2:
            best = min(((rank[ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids), default=None)
            if best is None:
                return None
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if any(p not in ids for p in parts):
            return None
        return tuple(ids[p] for p in parts)

    def _run_counts(self, n: int) -> list[int]:
        """Tokens of the first 0..n spaces of a run."""
        stack, out = [], [0]
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                stack[-2:] = [stack[-2] + stack[-1]]
            out.append(len(stack))
        return out

    def learn(self, segments: set[str]) -> None:
        """Prefix counts of the distinct segments that the cache lacks."""
        new = segments - self.total.keys()
        if len(self.total) + len(new) > CACHE_WORDS:
            self.total.clear()
            self.cache.clear()
            new = segments
        lone = self.core.names.get(SPACE)
        length = self.core.length
        bodies: dict[str, list[str]] = {}
        for s in new:
            body = s.lstrip(SPACE)
            bodies.setdefault(SPACE + body if len(body) < len(s) else body, []).append(s)
        ones = dict.fromkeys(length, 1)
        for body, last, count in self.core.walk(sorted(bodies), 0, ones):
            n = len(body)
            first = None
            for s in bodies[body]:
                spaces = len(s) - len(s.lstrip(SPACE))
                if spaces > 1:
                    if first is None:
                        first = [0] * (n + 1)
                        for d in range(1, n + 1):
                            back = d - length.get(last[d], 1)
                            first[d] = first[back] if back else last[d]
                    run = self._run_counts(spaces)
                    # the last space of a run belongs to the word unless it stays a token of its own
                    tail = [run[spaces] + count[d] - 1 if first[d] == lone else run[spaces - 1] + count[d] for d in range(2, n + 1)]
                    counts = run + tail
                else:
                    counts = count
                self.cache[s] = array("I", counts)
                self.total[s] = counts[-1]

    def segments(self, text: str) -> list[str]:
        return self.split(SPACE + text.replace(" ", SPACE)) if text else []

    def fit(self, segments: list[str], limit: int) -> int:
        """Characters of the longest prefix of the text that has at most `limit` tokens."""
        before, spent = 0, []
        for s in segments:
            spent.append(before)
            before += self.total[s]
            if before >= limit:
                break
        # from the last segment that the limit reaches back to one with a prefix within it
        at = sum(map(len, segments[: len(spent)])) - 1
        for s, before in zip(reversed(segments[: len(spent)]), reversed(spent), strict=True):
            at -= len(s)
            good = np.flatnonzero(np.frombuffer(self.cache[s], dtype=np.uint32)[1:] + before <= limit)
            if len(good):
                return max(at + int(good[-1]) + 1, 0)
        return 0

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of the first 0, 1, ... len(text) characters."""
        if not text:
            return np.zeros(1, dtype=np.uint32)
        segments = self.segments(text)
        self.learn(set(segments))
        out, before = [], 0
        for s in segments:
            out.append(np.array(self.cache[s][1:], dtype=np.uint32) + np.uint32(before))
            before += int(self.cache[s][-1])
        counts = np.concatenate(out)
        counts[0] = 0  # the space in front is added to texts only, not to the empty prefix
        return counts


def token_counts(docs: DataFrame, model: str, limit: int, column: str = "text", prefixes: bool = False) -> DataFrame:
    """Token counts of whole texts, from their prefix tables.

    Adds to all columns of docs: n_bytes, n_tokens, over_limit and fit_chars (characters
    of the longest prefix within `limit` tokens); with prefixes=True also prefix_counts
    (binary, one little-endian 32-bit count for each prefix, the empty one first). Columns
    of docs with these names are replaced. A null text counts as the empty one: no bytes,
    no tokens. Rows are independent: repeated rows repeat, an empty table stays empty.
    """
    docs = docs.drop("n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_counts")
    schema = StructType(list(docs.schema)).add("n_tokens", "long").add("fit_chars", "long")
    if prefixes:
        schema = schema.add("prefix_counts", "binary")
    at = docs.columns.index(column)

    def run(batches):
        bpe = PieceBpe.load(model)
        for batch in batches:
            for first, n in textkit.blocks(batch.column(at).cast(pa.large_string()), BLOCK_BYTES):
                rows = batch.slice(first, n)
                texts = [t or "" for t in rows.column(at).to_pylist()]
                split = [bpe.segments(t) for t in texts]
                bpe.learn(set().union(*split))
                get = bpe.total.__getitem__
                total = [sum(map(get, s)) for s in split]
                fits = [len(t) if k <= limit else bpe.fit(s, limit) for t, s, k in zip(texts, split, total, strict=True)]
                out = [*rows.columns, pa.array(total, pa.int64()), pa.array(fits, pa.int64())]
                if prefixes:
                    out.append(pa.array([bpe.prefix_counts(t).astype("<u4").tobytes() for t in texts], pa.binary()))
                yield pa.record_batch(out, names=schema.names)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_bytes", F.coalesce(F.octet_length(column), F.lit(0)).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)
