"""Benchmark decontamination: CGK embedding, bit sampling, exact edit verification.

The CGK walk reads a word sequence with a random bit for each (step, word): the bit says
whether the pointer moves on, so two sequences with few edits fall into step again and
their outputs differ in few places (edit distance becomes Hamming distance). A repetition
of the bit-sampling LSH draws a walk, a place inside each benchmark item and a few steps,
and looks for document windows whose sampled outputs are all those of an item's window. A
window's walk needs no end, so one walk serves items of all lengths of a band. The number
of repetitions is the smallest that reaches the target recall on randomly edited items
amid other words. Items of less than EXACT_BELOW words have draws that read consecutive
words instead, one for each of as many parts that an allowed number of edits leaves one whole.
Every window found is aligned with its whole item; only exact edit distances decide.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

#: Edits allowed as a share of an item's words, and the recall that the repetitions must reach.
MAX_EDITS, RECALL = 0.2, 0.98
#: Sampled steps of a repetition, most repetitions, and bytes of items that one pass broadcasts (with their keys, some ten times that).
SAMPLES, MOST_REPETITIONS, PASS_BYTES = 4, 256, 4 << 20
#: Steps of a walk at most: longer items are walked through from random places inside them.
WALK = 128
#: Items with fewer words are looked for by whole parts; words on both sides of the items that calibrate.
EXACT_BELOW, AMID = 16, 40

_U = np.uint64
_END = _U(0x5EED)


def _steps(words: int, rng: np.random.Generator) -> np.ndarray:
    """The sampled steps of a band: the first one, which reads the window's first word, and others anywhere in the walk of an item-sized window (of WALK steps at most)."""
    rest = np.arange(1, max(min(2 * words, WALK), SAMPLES))
    return np.concatenate([[0], np.sort(rng.choice(rest, SAMPLES - 1, replace=False))])


class Sampler:
    """The repetitions of all bands over a set of items (arrays of word hashes)."""

    def __init__(self, items: list[np.ndarray], repetitions: int | None = None, seed: int = 11):
        self.items = items
        self.bands: list[tuple[int, list[dict]]] = []
        sizes = np.array([len(x) for x in items])
        band = np.floor(np.log2(np.maximum(sizes, 1))).astype(int)
        for k in sorted(set(band[sizes > 0])):
            members = np.flatnonzero((band == k) & (sizes > 0))
            if 1 << int(k) < EXACT_BELOW:
                self.bands.append((1 << int(k), self._exact(members)))
                continue
            rng = np.random.default_rng(seed + int(k))
            draws = [self._draw(members, 1 << int(k), rng) for _ in range(repetitions or MOST_REPETITIONS)]
            if repetitions is None:
                draws = draws[: self._enough(members, draws)]
            self.bands.append((1 << int(k), draws))
        # openings that some repetition can go on from
        self.begins = _Bits(np.concatenate([np.zeros(0, _U), *(draw.pop("first") for _, draws in self.bands for draw in draws)]))

    def _exact(self, members: np.ndarray) -> list[dict]:
        """One draw of consecutive words: each item has one part more than it may have edits, so one is whole."""
        at = [(m, len(self.items[m]) * j // parts, len(self.items[m]) // parts) for m in members for parts in [int(MAX_EDITS * len(self.items[m])) + 1] for j in range(parts)]
        member, offset, size = np.array(at, dtype=np.int64).T
        return [self._keys(member, offset, np.arange(min(int(size.min()), SAMPLES)), None)]

    def _draw(self, members: np.ndarray, words: int, rng: np.random.Generator) -> dict:
        steps = _steps(words, rng)
        coins = rng.integers(1, 2**63, int(steps[-1]) + 1, dtype=np.int64).view(_U) * _U(2) + _U(1)
        offset = np.array([int(rng.integers(0, len(self.items[m]) - words + 1)) for m in members])
        return self._keys(members, offset, steps, coins)

    def _keys(self, members: np.ndarray, offset: np.ndarray, steps: np.ndarray, coins: np.ndarray | None) -> dict:
        """A draw of the members whose walk stays in the item; other words follow there in a document."""
        flat = np.concatenate([self.items[m][o:] for m, o in zip(members, offset, strict=True)])
        ends = np.cumsum([len(self.items[m]) - o for m, o in zip(members, offset, strict=True)])
        starts = np.concatenate([[0], ends[:-1]])
        at, key, step, keys = starts.copy(), np.zeros(len(members), _U), 0, []
        for s in steps:
            at, key, step = _advance(flat, ends, at, key, coins, step, int(s))
            keys.append(key)
        stays = at < ends
        return {"steps": steps, "coins": coins, "members": members[stays], "offset": offset[stays], "first": keys[0][stays], "maybe": [_Bits(k[stays]) for k in keys], "keys": _Lookup(keys[-1][stays])}

    def _enough(self, members: np.ndarray, draws: list[dict], trials: int = 600) -> int:
        """Repetitions that find the target share of items edited as much as is allowed, amid other words."""
        rng = np.random.default_rng(5)
        trials = int(max(100, min(trials, 60_000 // np.mean([len(self.items[m]) for m in members]))))
        texts, owner = [], []
        for t in range(trials):
            m = int(members[t % len(members)])
            amid = [rng.integers(1, 2**62, AMID).astype(_U) for _ in range(2)]
            texts.append(np.concatenate([amid[0], _edited(self.items[m], int(MAX_EDITS * len(self.items[m])), rng), amid[1]]))
            owner.append(m)
        sizes = np.array([len(x) for x in texts])
        flat, ends = np.concatenate(texts), np.cumsum(sizes)
        found = np.zeros(trials, dtype=bool)
        for n, draw in enumerate(draws, 1):
            at, item, _ = find(flat, np.repeat(ends, sizes), draw)
            hit = np.searchsorted(ends, at, side="right")
            found[hit[np.array(owner)[hit] == item]] = True
            if found.mean() >= RECALL:
                return n
        if len(draws) == MOST_REPETITIONS:
            warnings.warn(f"{len(draws)} repetitions find {found.mean():.3f} of edited items of {min(len(self.items[m]) for m in members)} words or more, not {RECALL}", stacklevel=2)
        return len(draws)


class _Bits:
    """Which keys may be among some: at least 32 bits for each of them."""

    def __init__(self, keys: np.ndarray):
        size = max(14, int(32 * len(np.unique(keys))).bit_length())
        self.shift = _U(64 - size)
        held = np.zeros(1 << size, dtype=np.uint8)
        held[(keys >> self.shift).astype(np.int64)] = 1
        self.bits = np.packbits(held, bitorder="little")

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> self.shift).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class _Lookup:
    """Sorted keys."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]

    def matches(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into keys, index of an equal member), all pairs."""
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = high - low
        which = np.repeat(np.arange(len(keys)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return which, self.order[place]


def _advance(flat, ends, at, key, coins, step, target):
    """Walk to a sampled step and add the word read there to the key; behind the end stands an end mark.

    Without coins every step moves on.
    """
    last = len(flat) - 1
    while True:
        word = np.where(at < ends, flat[np.minimum(at, last)], _END)
        if step == target:
            return at, textkit.mix(key * _U(0x9E3779B97F4A7C15) + word + _U(step + 1)), step
        at = at + (1 if coins is None else ((word * coins[step]) >> _U(63)).astype(at.dtype))
        step += 1


def openings(flat: np.ndarray) -> np.ndarray:
    """The key that every walk has after its first step, which reads the window's first word."""
    return textkit.mix(flat + _U(1))


def find(flat: np.ndarray, ends: np.ndarray, draw: dict, start: np.ndarray | None = None, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that a repetition matches: (first word, item, place in the item).

    flat: words of a block; ends: for each word where its document ends; start, key: the
    windows looked at and their openings (all of them if not given).
    """
    if start is None:
        start, key = np.arange(len(flat)), openings(flat)
    keep = draw["maybe"][0].has(key)
    start, key = start[keep], key[keep]
    at, ends, step = start, ends[start], 0
    for s, some in zip(draw["steps"][1:], draw["maybe"][1:], strict=True):
        at, key, step = _advance(flat, ends, at, key, draw["coins"], step, int(s))
        keep = some.has(key)
        start, at, key, ends = start[keep], at[keep], key[keep], ends[keep]
        if not len(start):
            return start, start, start
    which, member = draw["keys"].matches(key)
    return start[which], draw["members"][member], draw["offset"][member]


def _edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = item.tolist()
    for _ in range(edits):
        kind, at = int(rng.integers(3)), int(rng.integers(len(out)))
        new = int(rng.integers(1, 2**62))
        if kind == 0:
            out[at] = new
        elif kind == 1:
            out.insert(at, new)
        elif len(out) > 1:
            del out[at]
    return np.array(out, dtype=_U)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the part of text that is nearest to item; the first end, then the shortest part."""
    row = _distances(item, text, anchored=False)
    end = int(np.argmin(row))
    back = _distances(item[::-1], text[:end][::-1], anchored=True)
    return int(row[end]), end - int(np.argmin(back)), end


def _distances(pattern: np.ndarray, words: np.ndarray, anchored: bool) -> np.ndarray:
    """Edits from the whole pattern to a part of words that ends at each place, and starts at 0 if anchored."""
    steps = np.arange(len(words) + 1)
    row = steps.copy() if anchored else np.zeros_like(steps)
    for k, word in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (words != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return row


def _matches(words: textkit.Words, sampler: Sampler) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, edits, first word, end word): the best window of each item in each row of a block."""
    flat, doc = words.hash, words.doc
    if not len(flat):
        return
    ends = words.first[doc + 1]
    tried: set[tuple[int, int, int]] = set()
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    bags: dict[int, set[int]] = {}
    key = openings(flat)
    windows = np.flatnonzero(sampler.begins.has(key))
    key = key[windows]
    for _, draws in sampler.bands:
        for draw in draws:
            at, items, offsets = find(flat, ends, draw, windows, key)
            for p, m, o in zip(at.tolist(), items.tolist(), offsets.tolist(), strict=True):
                row, item = int(doc[p]), sampler.items[m]
                most = int(MAX_EDITS * len(item))
                # windows whose starts are near each other hold the same alignment
                if (row, m, (p - o) // max(most, 1)) in tried:
                    continue
                tried.add((row, m, (p - o) // max(most, 1)))
                low = max(p - o - 2 * most - 1, int(words.first[row]))
                high = min(p - o + len(item) + 2 * most + 1, int(words.first[row + 1]))
                bag = bags.get(m)
                if bag is None:
                    bag = bags[m] = set(item.tolist())
                # an edit removes one kind of word at most
                if len(bag.intersection(flat[low:high].tolist())) < len(bag) - most:
                    continue
                edits, start, end = align(item, flat[low:high])
                if edits <= most and (edits, low + start, low + end) < best.get((row, m), (most + 1, 0, 0)):
                    best[row, m] = (edits, low + start, low + end)
    for (row, m), (edits, start, end) in best.items():
        yield row, m, edits, start, end


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a benchmark item with at most MAX_EDITS edits a word.

    docs: doc_id, text; benchmark: item_id, text (other columns are ignored on both).
    Words are runs of letters and digits, lower-cased in A-Z. One row for each input row
    and item that it holds: doc_id, item_id, item_words, edits and the code points
    [start, end) of the best window, the first one of equals. Texts that are null, empty
    or free of words match nothing, nor do such items; repeated rows give repeated
    results; a row with a null doc_id, or an item with a null item_id, is reported with that;
    empty tables give none.
    Items are read in passes of PASS_BYTES, each of which scans docs once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // PASS_BYTES) or 1
    out = None
    for k in range(passes):
        part = items if passes == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        rows = sorted({(r.item_id, r.text) for r in part.collect()}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        found = _one_pass(spark, docs, rows)
        out = found if out is None else out.union(found)
    return out


def _one_pass(spark, docs: DataFrame, rows: list[tuple[int | None, str]]) -> DataFrame:
    words = textkit.scan(pa.array([t for _, t in rows], pa.large_string()), textkit.PUNCTUATION)
    items = [words.hash[words.first[k] : words.first[k + 1]] for k in range(len(rows))]
    shared = spark.sparkContext.broadcast((Sampler(items), [i for i, _ in rows]))
    names = ["doc_id", "item_id", "item_words", "edits", "start", "end"]

    def run(batches):
        sampler, ids = shared.value
        for batch in batches:
            for at, n in textkit.blocks(batch.column(1)):
                texts = batch.column(1).slice(at, n)
                block = textkit.scan(texts, textkit.PUNCTUATION)
                found = sorted(_matches(block, sampler))
                if not found:
                    continue
                offsets, data = textkit.raw(texts)
                out = []
                for row, m, edits, first, end in found:
                    # bytes that are not continuation bytes begin a code point
                    a, b, c = int(offsets[row]), int(block.start[first]), int(block.end[end - 1])
                    lead = int(((data[a:b] & 0xC0) != 0x80).sum())
                    out.append((batch.column(0)[at + row].as_py(), ids[m], len(sampler.items[m]), edits, lead, lead + int(((data[b:c] & 0xC0) != 0x80).sum())))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names))
