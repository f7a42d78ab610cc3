"""Interpolated modified Kneser-Ney bigram model in sorted hash arrays.

Counting is in Spark and covers every training row: tasks reduce the n-grams of a few
megabytes of text, pack them by hash range and exchange the packed bytes; the task of a
range sums its counts and writes them as sorted arrays to the shared folder. Scoring tasks
map these files into memory and look n-grams up by binary search, a block at a time.

A context that holds a large share of all tokens would make its range large, so such
contexts (at most HOT_CONTEXTS, from the exact unigram counts) are stored as SHARDS
pseudo-contexts, dealt by the hash of the next word; their totals are summed once.
"""

from __future__ import annotations

import gc
import os
import uuid
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .store import new_path, settle

#: A context is dealt over SHARDS when it has more than 1/HOT_CONTEXTS of all tokens.
HOT_CONTEXTS, SHARDS = 1000, 64
#: Tokens for each range of the arrays, and text that a task reduces before the exchange.
RANGE_TOKENS, GROUP_BYTES = 1_000_000, 16 << 20

_U = np.uint64
BEGIN, END = _U(0x0B5E55ED0B5E55ED), _U(0xE4D0E4D0E4D0E4D1)


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, context, token) of every token of a block: its words, then an end; the first context is a begin mark."""
    words = textkit.scan(column)
    rows = len(column)
    size = np.diff(words.first) + 1
    row = np.repeat(np.arange(rows), size)
    token = np.empty(len(row), dtype=_U)
    last = np.cumsum(size) - 1
    is_end = np.zeros(len(row), dtype=bool)
    is_end[last] = True
    token[is_end] = END
    token[~is_end] = words.hash
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[last - size + 1] = BEGIN
    return row, context, token


def _ranges(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each hash; ranges follow the order of the hashes."""
    return ((hashes >> _U(32)) * _U(ranges)) >> _U(32)


def _sharded(context: np.ndarray, token: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Contexts, with a hot one replaced by its shard for the token."""
    if not len(hot):
        return context
    at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
    is_hot = hot[at] == context
    out = context.copy()
    out[is_hot] = textkit.mix(context[is_hot] ^ textkit.mix(token[is_hot] % _U(SHARDS) + _U(1)))
    return out


def _counted(*keys: np.ndarray, weight: np.ndarray | None = None):
    """Sorted distinct keys (first key major) and the sums of their weights."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    head = np.ones(len(order), dtype=bool)
    if len(order):
        head[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    start = np.flatnonzero(head)
    if weight is None:
        count = np.diff(np.append(start, len(order)))
    else:
        count = np.add.reduceat(weight[order], start) if len(start) else np.zeros(0, np.int64)
    return *(k[start] for k in keys), count.astype(np.int64)


def _short(count: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, and those from 255 as (index, count)."""
    large = np.flatnonzero(count >= 255)
    return np.minimum(count, 255).astype(np.uint8).tobytes(), large.astype("<u4").tobytes() + count[large].astype("<i8").tobytes()


def _long(short: np.ndarray, rest: bytes) -> np.ndarray:
    count = short.astype(np.int64)
    if len(rest):
        n = len(rest) // 12
        count[np.frombuffer(rest, "<u4", n)] = np.frombuffer(rest, "<i8", n, 4 * n)
    return count


def _train_texts(batch):
    """Slices with about GROUP_BYTES of the training texts of a batch (text, train)."""
    texts = batch.column(0).filter(batch.column(1))
    for at, n in textkit.blocks(texts, GROUP_BYTES):
        part = texts.slice(at, n)
        yield [sequences(part.slice(a, m)) for a, m in textkit.blocks(part)]


def _packed(bucket: np.ndarray, columns, count: np.ndarray, contexts: np.ndarray | None = None):
    """A row (bucket, data) for each range: sizes, large counts, [distinct contexts and their sizes,] columns, counts."""
    if not len(bucket):
        return
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
        short, rest = _short(count[a:b])
        extra = b""
        if contexts is not None:
            name, size = _counted(contexts[a:b])
            extra = name.tobytes() + size.astype("<u4").tobytes()
        data = np.array([b - a, len(rest), len(extra) // 12], "<i8").tobytes() + rest + extra + b"".join(c[a:b].tobytes() for c in columns) + short
        yield pa.record_batch([pa.array([int(bucket[a])], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "data"])


def _unpacked(data, has_context: bool, kinds):
    """(contexts or None, columns, counts) of a packed row."""
    n, rest, names = np.frombuffer(data, "<i8", 3)
    at = 24
    large = bytes(data[at : at + rest])
    at += rest
    context = None
    if has_context:
        name, size = np.frombuffer(data, _U, names, at), np.frombuffer(data, "<u4", names, at + 8 * names)
        context = np.repeat(name, size)
        at += 12 * names
    columns = []
    for kind in kinds:
        columns.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return context, columns, _long(np.frombuffer(data, np.uint8, n, at), large)


def _by_bucket(batches, has_context, kinds):
    """All rows of each bucket in a partition, unpacked and joined."""
    held: dict[int, list] = {}
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.setdefault(bucket, []).append(_unpacked(data.as_buffer(), has_context, kinds))
    for bucket in sorted(held):
        parts = held.pop(bucket)
        context = np.concatenate([p[0] for p in parts]) if has_context else None
        yield bucket, context, [np.concatenate(c) for c in zip(*(p[1] for p in parts), strict=True)], np.concatenate([p[2] for p in parts])


def _put(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Write arrays one after the other (each padded to eight bytes) as a file of the shared folder; a repeated task replaces it."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        os.makedirs(url.path, exist_ok=True)
        draft = f"{url.path}/.{name}-{uuid.uuid4().hex}"
        with open(draft, "wb") as out:
            for a in arrays:
                out.write(a.tobytes() + bytes(-a.nbytes % 8))
        os.replace(draft, f"{url.path}/{name}")
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name}") as out:
            for a in arrays:
                out.write(a.tobytes() + bytes(-a.nbytes % 8))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more, from the counts of counts."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [k - (k + 1) * y * b / a if a and b else 0.5 * k for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
    return [min(max(d, 0.05), k) for k, d in enumerate(raw, 1)]


@dataclass
class Model:
    """Where the arrays are, and the sums that complete them."""

    folder: str
    files: dict[str, dict[int, tuple]]
    ranges: int
    shipped: bool
    tokens: int
    types: int
    bigrams: int
    discount: list[float]
    lower: list[float]
    lower_gamma: float
    hot: np.ndarray
    hot_stats: np.ndarray
    _maps: dict = field(default_factory=dict)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_maps"} | {"_maps": {}}

    def mapped(self, kind: str, bucket: int, layout) -> list[np.ndarray]:
        """The arrays of a file, mapped into memory. layout: (dtype, length) of each."""
        if (kind, bucket) not in self._maps:
            base = SparkFiles.get(os.path.basename(self.folder)) if self.shipped else urlparse(self.folder).path
            raw = np.memmap(f"{base}/{kind}-{bucket}", dtype=np.uint8, mode="r")
            out, at = [], 0
            for dtype, n in layout:
                size = np.dtype(dtype).itemsize * n
                out.append(raw[at : at + size].view(dtype))
                at += size + -size % 8
            self._maps[kind, bucket] = out
        return self._maps[kind, bucket]

    def unigrams(self, token: np.ndarray) -> np.ndarray:
        """Training counts of sorted distinct tokens."""
        return self._lookup("uni", token, lambda n: [("<u8", n), ("<i8", n)], lambda a, q: a[0], token)

    def continuations(self, token: np.ndarray) -> np.ndarray:
        """In how many contexts sorted distinct tokens occur."""
        return self._lookup("cont", token, lambda n: [("<u8", n), ("<u4", n)], lambda a, q: a[0], token >> _U(16))

    def _lookup(self, kind, token, layout, keys, wanted):
        out = np.zeros(len(token), dtype=np.int64)
        for bucket, a, b in _runs(_ranges(token, self.ranges)):
            if bucket in self.files[kind]:
                arrays = self.mapped(kind, bucket, layout(self.files[kind][bucket][0]))
                name = keys(arrays, None)
                at = np.minimum(np.searchsorted(name, wanted[a:b]), len(name) - 1)
                out[a:b] = np.where(name[at] == wanted[a:b], arrays[1][at], 0)
        return out

    def pairs(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of the pair, [total, n1, n2, types] of the context) for pairs sorted by context."""
        count, stats = np.zeros(len(context), np.int64), np.zeros((len(context), 4), np.int64)
        word = token >> _U(16)
        for bucket, a, b in _runs(_ranges(context, self.ranges)):
            if bucket not in self.files["ctx"]:
                continue
            n, entries, large = self.files["ctx"][bucket]
            names, begin, total, n1, n2, high, low, short, places, values = self.mapped("ctx", bucket, [("<u8", n), ("<u4", n + 1), ("<i8", n), ("<u4", n), ("<u4", n), ("<u4", entries), ("<u2", entries), ("<u1", entries), ("<u4", large), ("<i8", large)])
            at = np.minimum(np.searchsorted(names, context[a:b]), n - 1)
            known = np.flatnonzero(names[at] == context[a:b])
            at = at[known]
            lo, hi = begin[at].astype(np.int64), begin[at + 1].astype(np.int64)
            stats[a + known] = np.stack([total[at], n1[at], n2[at], hi - lo], axis=1)
            end, want = hi.copy(), word[a + known]
            todo = np.arange(len(known))
            while len(todo):  # binary search in the words of each context
                mid = (lo[todo] + hi[todo]) >> 1
                less = ((high[mid].astype(_U) << _U(16)) | low[mid]) < want[todo]
                lo[todo[less]] = mid[less] + 1
                hi[todo[~less]] = mid[~less]
                todo = todo[lo[todo] < hi[todo]]
            inside = np.flatnonzero(lo < end)
            hit = inside[((high[lo[inside]].astype(_U) << _U(16)) | low[lo[inside]]) == want[inside]]
            found = short[lo[hit]].astype(np.int64)
            if large:
                big = np.flatnonzero(found == 255)
                found[big] = values[np.searchsorted(places, lo[hit][big])]
            count[a + known[hit]] = found
        return count, stats

    def score(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each row of a block."""
        row, context, token = sequences(column)
        rows = len(column)
        kinds, inverse = np.unique(token, return_inverse=True)
        known = self.unigrams(kinds)
        base = np.log10((known + 0.5) / (self.tokens + 0.5 * (self.types + 1)))
        cont = self.continuations(kinds)
        unseen = 1.0 / (self.types + 1)
        if self.bigrams:
            cut = np.array([0.0, *self.lower])[np.minimum(cont, 3)]
            lower = (cont - cut) / self.bigrams + self.lower_gamma * unseen
        else:
            lower = np.full(len(kinds), unseen)
        place = _sharded(context, token, self.hot)
        order = np.lexsort((token, place))
        count, stats = self.pairs(place[order], token[order])
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context[order]), len(self.hot) - 1)
            is_hot = self.hot[at] == context[order]
            stats[is_hot] = self.hot_stats[at[is_hot]]
        total, n1, n2, types = stats.T
        gamma = (self.discount[0] * n1 + self.discount[1] * n2 + self.discount[2] * (types - n1 - n2)) / np.maximum(total, 1)
        cut = np.array([0.0, *self.discount])[np.minimum(count, 3)]
        p = np.where(total > 0, (count - cut) / np.maximum(total, 1) + gamma * lower[inverse[order]], lower[inverse[order]])
        size = np.bincount(row, minlength=rows)
        return size, np.bincount(row, (known > 0)[inverse], rows).astype(np.int64), np.bincount(row, base[inverse], rows), np.bincount(row[order], np.log10(p), rows)


def _runs(bucket: np.ndarray):
    if len(bucket):
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
            yield int(bucket[a]), int(a), int(b)


def _release(spark) -> None:
    """Let Spark delete the exchange files of passes that have ended."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def train(docs: DataFrame) -> Model:
    """Count unigrams, bigrams and continuations of the rows of docs (text, train) with train."""
    spark = docs.sparkSession
    folder = new_path(spark, "lm")
    # a bound on the tokens, from the bytes that the table has
    size = docs.select(F.sum(F.when(F.col("train"), F.octet_length("text"))).alias("n")).first().n or 0
    ranges = max(16, int(size // 6 // RANGE_TOKENS))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ranges // 2)

    def count_unigrams(batches):
        for batch in batches:
            for group in _train_texts(batch):
                token, count = _counted(np.concatenate([g[2] for g in group]))
                yield from _packed(_ranges(token, ranges), [token], count)

    def write_unigrams(batches):
        for bucket, _, (token,), count in _by_bucket(batches, False, ["<u8"]):
            token, count = _counted(token, weight=count)
            _put(folder, f"uni-{bucket}", token, count.astype("<i8"))
            # a token above the share in all text is above it in its range
            top = np.flatnonzero(count * HOT_CONTEXTS > count.sum())
            yield pa.record_batch([pa.array([bucket]), pa.array([len(token)]), pa.array([int(count.sum())]), pa.array([token[top].tobytes()], pa.binary()), pa.array([count[top].astype("<i8").tobytes()], pa.binary())], names=["bucket", "n", "total", "top", "counts"])

    packed = docs.mapInArrow(count_unigrams, "bucket int, data binary")
    told = settle(packed.repartition(parts, "bucket").mapInArrow(write_unigrams, "bucket long, n long, total long, top binary, counts binary"), "uni")
    ranges_told = told.select("bucket", "n", "total").collect()
    files = {"uni": {r.bucket: (r.n,) for r in ranges_told}, "ctx": {}, "cont": {}}
    tokens, types = sum(r.total for r in ranges_told), sum(r.n for r in ranges_told)

    def frequent(batches):
        for batch in batches:
            name = np.concatenate([np.frombuffer(x.as_buffer(), _U) for x in batch.column(0)]) if batch.num_rows else np.zeros(0, _U)
            often = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(1)]) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(name[often * HOT_CONTEXTS > tokens].view(np.int64))], names=["token"])

    # fewer than HOT_CONTEXTS tokens come to the driver
    hot = told.select("top", "counts").mapInArrow(frequent, "token long").toArrow().column(0).to_numpy().view(_U)
    hot = np.sort(np.append(hot, BEGIN))
    del packed
    _release(spark)

    def count_bigrams(batches):
        for batch in batches:
            for group in _train_texts(batch):
                context, token = np.concatenate([g[1] for g in group]), np.concatenate([g[2] for g in group])
                del group
                place, token, count = _counted(_sharded(context, token, hot), token >> _U(16))
                yield from _packed(_ranges(place, ranges), [(token >> _U(16)).astype("<u4"), (token & _U(0xFFFF)).astype("<u2")], count, place)

    names = ["bucket", "kind", "data", "n", "entries", "large", "stats"]
    sharded = np.stack([textkit.mix(hot ^ textkit.mix(np.full(len(hot), s + 1, _U))) for s in range(SHARDS)], axis=1)

    def write_bigrams(batches):
        for bucket, place, (high, low), count in _by_bucket(batches, True, ["<u4", "<u2"]):
            place, word, count = _counted(place, (high.astype(_U) << _U(16)) | low, weight=count)
            start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            names_, begin = place[start], np.append(start, len(place)).astype("<u4")
            total = np.add.reduceat(count, start)
            n1, n2 = (np.add.reduceat((count == k).astype(np.int64), start) for k in (1, 2))
            large = np.flatnonzero(count >= 255)
            _put(folder, f"ctx-{bucket}", names_, begin, total.astype("<i8"), n1.astype("<u4"), n2.astype("<u4"), (word >> _U(16)).astype("<u4"), (word & _U(0xFFFF)).astype("<u2"), np.minimum(count, 255).astype(np.uint8), large.astype("<u4"), count[large].astype("<i8"))
            of_hot = np.flatnonzero(np.isin(names_, sharded))
            stats = np.stack([names_[of_hot].view(np.int64), total[of_hot], n1[of_hot], n2[of_hot], np.diff(begin.astype(np.int64))[of_hot]], axis=1)
            by_count = [int((count == k).sum()) for k in (1, 2, 3, 4)]
            yield _row(bucket, 0, np.array(by_count, "<i8").tobytes(), len(names_), len(place), len(large), stats.astype("<i8").tobytes())
            # in how many contexts of this range each word occurs
            word, times = _counted(word)
            target = _ranges(word << _U(16), ranges)
            for to, a, b in _runs(target):
                short, rest = _short(times[a:b])
                data = np.array([b - a, len(rest)], "<i8").tobytes() + rest + (word[a:b] >> _U(16)).astype("<u4").tobytes() + (word[a:b] & _U(0xFFFF)).astype("<u2").tobytes() + short
                yield _row(to, 1, data, 0, 0, 0, b"")

    def _row(bucket, kind, data, n, entries, large, stats):
        return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary()), pa.array([n], pa.int64()), pa.array([entries], pa.int64()), pa.array([large], pa.int64()), pa.array([stats], pa.binary())], names=names)

    def write_continuations(batches):
        held: dict[int, list] = {}
        for batch in batches:
            kinds = batch.column(1).to_pylist()
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if not kinds[i]:
                    yield batch.slice(i, 1)
                    continue
                data = batch.column(2)[i].as_buffer()
                n, rest = np.frombuffer(data, "<i8", 2)
                high, low = np.frombuffer(data, "<u4", n, 16 + rest), np.frombuffer(data, "<u2", n, 16 + rest + 4 * n)
                held.setdefault(bucket, []).append(((high.astype(_U) << _U(16)) | low, _long(np.frombuffer(data, np.uint8, n, 16 + rest + 6 * n), bytes(data[16 : 16 + rest]))))
        for bucket, rows in held.items():
            word, times = _counted(np.concatenate([r[0] for r in rows]), weight=np.concatenate([r[1] for r in rows]))
            _put(folder, f"cont-{bucket}", word, times.astype("<u4"))
            by_count = [int((times == k).sum()) for k in (1, 2, 3, 4)]
            yield _row(bucket, 2, np.array([*by_count, int(times.sum())], "<i8").tobytes(), len(word), 0, 0, b"")

    packed = docs.mapInArrow(count_bigrams, "bucket int, data binary")
    schema = "bucket int, kind int, data binary, n long, entries long, large long, stats binary"
    pairs = packed.repartition(parts, "bucket").mapInArrow(write_bigrams, schema)
    # the second exchange deals the continuation counts by word, and the rows of kind 0 with them
    told = settle(pairs.repartition(parts, "bucket").mapInArrow(write_continuations, schema), "cont").collect()
    del packed, pairs
    _release(spark)
    files["ctx"] = {r.bucket: (r.n, r.entries, r.large) for r in told if r.kind == 0}
    files["cont"] = {r.bucket: (r.n,) for r in told if r.kind == 2}
    by_count = np.sum([np.frombuffer(r.data, "<i8") for r in told if r.kind == 0], axis=0, initial=0) + np.zeros(4, np.int64)
    lower = np.sum([np.frombuffer(r.data, "<i8") for r in told if r.kind == 2], axis=0, initial=0) + np.zeros(5, np.int64)
    bigrams, words = int(lower[4]), sum(r.n for r in told if r.kind == 2)
    cut = discounts(*map(int, lower[:4]))
    gamma = (cut[0] * lower[0] + cut[1] * lower[1] + cut[2] * (words - lower[0] - lower[1])) / max(bigrams, 1)
    hot_stats = np.zeros((len(hot), 4), np.int64)
    owner = {int(x): k for k, row in enumerate(sharded.view(np.int64)) for x in row}
    for r in told:
        for name, *stats in np.frombuffer(r.stats, "<i8").reshape(-1, 5).tolist() if r.kind == 0 else ():
            hot_stats[owner[name]] += np.array(stats)
    shipped = urlparse(folder).scheme not in ("", "file")
    if shipped:
        spark.sparkContext.addFile(folder, recursive=True)
    return Model(folder, files, ranges, shipped, int(tokens), int(types), bigrams, discounts(*map(int, by_count)), cut, float(gamma), hot, hot_stats)


def held_out(column: str):
    """Rows that the model does not learn from; a null id is learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score_documents(docs: DataFrame) -> DataFrame:
    """Log10 probabilities of whole texts under a model of the rows that are not held out.

    docs: doc_id, text (others are ignored). Returns one row per input row: doc_id,
    held_out, n_tokens (words and one end), n_known, train_tokens, base_score (add-half
    unigrams), score (the bigram model) and perplexity. A null or blank text has the end as
    its only token. Repeated rows are counted and scored each; an empty table gives an
    empty result; without training rows every token is unseen.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out("doc_id").alias("held_out"))
    model = train(docs.select("text", (~F.col("held_out")).alias("train")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lm = shared.value
        for batch in batches:
            for at, n in textkit.blocks(batch.column(1), 4 * textkit.BLOCK_BYTES):
                rows = batch.slice(at, n)
                tokens, known, base, score = lm.score(rows.column(1))
                yield pa.record_batch([rows.column(0), rows.column(2), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(n, lm.tokens), pa.int64()), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
