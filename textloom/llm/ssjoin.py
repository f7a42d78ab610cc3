"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Two sets r, s with Jaccard >= d differ in at most H = (1-d)/(1+d) (|r|+|s|) elements. Hash
the universe of shingles into m segments: every differing element spoils one segment at
most, so of the non-empty segments of r all but H are equal to those of s. Sets are
grouped into size bands whose bounds grow by 1/d, so a pair lies in one band or in two
neighbours: each set is indexed once as the lower and once as the upper band of a scheme.

Allocation by cost. A set does not index all segments: with all subset keys put in one
global order, cheapest (least frequent) first, the H+1 first keys of both sides must meet,
which lets each set leave out its expensive segments. Where H is 1, the whole set is one
segment, and its one-deletion neighbourhood covers the budget. A set with too few non-empty
segments for its H adds the next, finer partition; its partner does so too unless it
already met the condition. The order is only a matter of cost: candidates are complete
whatever the frequency estimates are.

Candidates of a key with many are not paired with each other: they are compared with the
group's smallest member. All members of such groups are then compared in blocks, by parity
sketches and by whole sets, out of which come numbers of links and what joins components
(see `_close_groups`). Verification intersects the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .graph import components, forest
from .store import first_copies, keep_ids, settle

#: Words in a shingle and the similarity (in per cent) that links two documents.
WORDS, PERCENT = 5, 75
#: Frequent shingles whose counts steer the allocation: a bound on what is broadcast, not on what is joined.
HOT_SHINGLES = 500_000
#: Groups with up to this many members are paired at once.
PAIR_GROUP = 4
#: Sets in a group of text from which a shingle's count is reported.
LOCAL_REPEATS = 3
#: Text that one task reduces before the exchange.
GROUP_BYTES = 4 << 20
#: Keys that one bucket of the exchange should hold.
BUCKET_KEYS = 400_000

_U = np.uint64


def size_bands(largest: int, percent: int) -> np.ndarray:
    """Lower bounds of the bands: a linked pair lies in one band or in two neighbours."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(-(-bounds[-1] * 100 // percent))
    return np.array(bounds, dtype=np.int64)


def _signature(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Order-free 64-bit identity of each row's set."""
    out = np.zeros(rows, dtype=_U)
    np.add.at(out, row, textkit.mix(value + _U(0x51ED2701)))
    return textkit.mix(out ^ textkit.mix(np.bincount(row, minlength=rows).astype(_U) + _U(77)))


def _sets(texts: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for at, n in textkit.blocks(texts):
        row, value, size = textkit.shingle_sets(texts.slice(at, n), words)
        yield at, n, row, value, size, _signature(row, value, n)


def _sketches(row: np.ndarray, value: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Parity bitmaps of at least two bits for each member; the number of bits is a power of two.

    Each differing element of two sets flips one bit, so the bits in which two bitmaps
    (the larger one folded) differ are at most as many as the differing elements.
    """
    bits = np.maximum(1 << np.ceil(np.log2(np.maximum(2 * size, 64))).astype(np.int64), 64)
    begin = np.cumsum(bits) - bits
    at = begin[row] + (textkit.mix(value + _U(0xB17)) & (bits[row] - 1).astype(_U)).astype(np.int64)
    flips = np.bincount(at, minlength=int(bits.sum())).astype(np.uint8) & 1
    packed = np.packbits(flips)
    return [packed[b : b + n].tobytes() for b, n in zip(begin // 8, bits // 8, strict=True)]


def _describe(words: int):
    """Pass 1: size, identity and sketch of each set, and the group's frequent shingles."""
    names = ["doc_id", "n", "cls", "sketch", "shingle", "df"]

    def run(batches):
        for batch in batches:
            for at, n in textkit.blocks(batch.column(1), GROUP_BYTES):
                seen = []
                for first, m, row, value, size, sign in _sets(batch.column(1).slice(at, n), words):
                    seen.append(value)
                    none = pa.nulls(m, pa.int64())
                    yield pa.record_batch([batch.column(0).slice(at + first, m), pa.array(size, pa.int64()), pa.array(sign.view(np.int64), mask=size == 0), pa.array(_sketches(row, value, size), pa.binary()), none, none], names=names)
                value = np.sort(np.concatenate(seen))
                start, count = _groups(value)
                often = count >= LOCAL_REPEATS
                value, count = value[start[often]], count[often]
                none = pa.nulls(len(value), pa.int64())
                yield pa.record_batch([none, none, none, pa.nulls(len(value), pa.binary()), pa.array(value.view(np.int64)), pa.array(count, pa.int64())], names=names)
                textkit.release()

    return run


def plan_keys(row, value, size, sign, bounds, percent, hot, hot_df):
    """Keys of a block of sets: (key, class), complete for every linked pair.

    row, value: members sorted by row; size, sign: by row; hot, hot_df: shingles known to
    be frequent, sorted, and their estimated counts.
    """
    band = np.searchsorted(bounds, size, side="right") - 1
    cost = np.ones(len(value), dtype=np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, value), len(hot) - 1)
        known = hot[at] == value
        cost[known] = hot_df[at[known]]
    keys, owners = [], []
    for upper in (False, True):
        scheme = band - upper
        top = bounds[np.clip(scheme + 1, 0, len(bounds) - 1)] - 1
        # the most elements in which a partner of this scheme can differ
        most = size * 100 // percent if not upper else size
        other = np.minimum(most, top) if upper else most
        budget = (100 - percent) * (size + other) // (100 + percent)
        live = (size > 0) & (scheme >= 0)
        width = np.maximum(top, 4)
        for level in range(40):
            wanted = live[row]
            if not wanted.any():
                break
            r, v, c = row[wanted], value[wanted], cost[wanted]
            parts = (width * (3 if level == 0 else 3 << level) // 4).astype(_U)
            seed = textkit.mix((scheme * 64 + level + 1).astype(_U))
            part = textkit.mix(v ^ seed[r]) % parts[r]
            order = np.argsort((r.astype(_U) << _U(32)) | part)
            r, v, c, part = r[order], v[order], c[order], part[order]
            head = np.ones(len(r), dtype=bool)
            head[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
            start = np.flatnonzero(head)
            owner = r[start]
            key = textkit.mix(np.add.reduceat(textkit.mix(v + seed[r]), start) + part[start] * _U(3) + seed[owner])
            low = np.minimum.reduceat(c, start)
            # the global order: estimated frequency of the subset (in eighths of a power of two), then the key itself
            rare = np.minimum(8 * np.log2(low), 255).astype(_U)
            order = np.argsort((owner.astype(_U) << _U(43)) | (rare << _U(35)) | (key >> _U(29)))
            owner, key = owner[order], key[order]
            filled = np.bincount(owner, minlength=len(size))
            rank = np.arange(len(owner)) - (np.cumsum(filled) - filled)[owner]
            keep = rank <= budget[owner]
            keys.append(key[keep])
            owners.append(sign[owner[keep]])
            live = live & (filled <= budget)
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, _U), np.zeros(0, np.int64))


def deletion_limit(percent: int) -> int:
    """Largest set size whose linked partners differ from it in one element at most."""
    size = 0
    while (100 - percent) * (size + 1 + (size + 1) * 100 // percent) // (100 + percent) <= 1:
        size += 1
    return size


def deletion_keys(row, value, size, sign, percent):
    """Keys of small sets: the set and its one-deletion neighbourhood.

    Two sets that differ in one element at most share one of these keys, so a set up to
    `deletion_limit` needs no other; its possible partners have these keys as well as
    their own. Returns the keys, their classes and which rows need no other key.
    """
    limit = deletion_limit(percent)
    covered = (size > 0) & (size <= limit)
    wanted = (size > 0) & (size <= limit * 100 // percent)
    total = np.zeros(len(size), dtype=_U)
    small_members = wanted[row]
    np.add.at(total, row[small_members], textkit.mix(value[small_members] + _U(0xD00D)))
    own = np.flatnonzero(wanted)
    mine = small_members & (size[row] > 1)
    less = total[row[mine]] - textkit.mix(value[mine] + _U(0xD00D))
    return (np.concatenate([textkit.mix(total[own] + _U(0xDE1)), textkit.mix(less + _U(0xDE1))]), np.concatenate([sign[own], sign[row[mine]]]), covered)


def _emit(words, percent, bounds, hot, hot_df, buckets):
    """Pass 2: one packed row per bucket and batch; large groups inside a batch are reduced here."""

    def run(batches):
        for batch in batches:
            for at, n in textkit.blocks(batch.column(0), GROUP_BYTES):
                keys, owners = [], []
                for _, _, row, value, size, sign in _sets(batch.column(0).slice(at, n), words):
                    sign = sign.view(np.int64)
                    key, owner, covered = deletion_keys(row, value, size, sign, percent)
                    keys.append(key)
                    owners.append(owner)
                    rest = ~covered[row]
                    key, owner = plan_keys(row[rest], value[rest], np.where(covered, 0, size), sign, bounds, percent, hot, hot_df)
                    keys.append(key)
                    owners.append(owner)
                # 48 bits tell the keys of a bucket apart; two that meet by chance are one more candidate
                key, owner = np.concatenate(keys) >> _U(16), np.concatenate(owners)
                order = np.lexsort((owner, key))
                key, owner = key[order], owner[order]
                keep = np.ones(len(key), dtype=bool)
                keep[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
                yield from _packed(key[keep], owner[keep], buckets)
                textkit.release()

    return run


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.ones(len(key), dtype=bool)
    head[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(head)
    return start, np.diff(np.append(start, len(key)))


def _packed(key, owner, buckets):
    """Rows (bucket, kind, data): kind 0 has the keys of a bucket, 1 star pairs, 2 members of large groups."""
    start, count = _groups(key)
    group = np.repeat(np.arange(len(start)), count)
    big = count[group] > PAIR_GROUP
    pairs, members = _star(key[big], owner[big])
    head = np.zeros(len(key), dtype=bool)
    head[start] = True
    stay = ~big | head
    key, owner, grouped = key[stay], owner[stay], big[stay]
    bucket = (key >> _U(17)) % _U(buckets)
    order = np.argsort(bucket, kind="stable")
    key, owner, bucket, grouped = key[order], owner[order], bucket[order], grouped[order]
    begin, n = _groups(bucket)
    for b, k in zip(begin, n, strict=True):
        names, code = np.unique(owner[b : b + k], return_inverse=True)
        wide = 16 if len(names) < 1 << 15 else 32
        code = code.astype(f"<u{wide // 8}") | (grouped[b : b + k].astype(f"<u{wide // 8}") << (wide - 1))
        some = key[b : b + k]
        data = np.array([k, len(names), wide], dtype="<i8").tobytes() + names.tobytes() + some.astype("<u4").tobytes() + (some >> _U(32)).astype("<u2").tobytes() + code.tobytes()
        yield pa.record_batch([pa.array([int(bucket[b])], pa.int32()), pa.array([0], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "kind", "data"])
    for kind, (x, y) in ((1, pairs), (2, members)):
        for b in range(0, len(x), 1 << 16):
            data = x[b : b + (1 << 16)].tobytes() + y[b : b + (1 << 16)].tobytes()
            yield pa.record_batch([pa.array([int(x[b] % buckets)], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "kind", "data"])


def _star(key, owner):
    """Pairs (member, smallest member) and all (key, member) of groups sorted by key, then member."""
    if not len(key):
        none = np.zeros(0, np.int64)
        return (none, none), (key, owner)
    start, count = _groups(key)
    hub = np.repeat(owner[start], count)
    other = owner != hub
    return (owner[other], hub[other]), (key, owner)


def _meet(batches):
    """Pass 3, by bucket: candidates of each key. Rows (kind, x, y): 1 a pair to verify, 2 a member of a large group."""
    keys, owners, flags, schema = [], [], [], ["kind", "x", "y"]

    def rows(kind, x, y):
        return pa.record_batch([pa.array(np.full(len(x), kind, np.int32)), pa.array(x.view(np.int64)), pa.array(np.ascontiguousarray(y).view(np.int64))], names=schema)

    for batch in batches:
        for kind, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = data.as_buffer()
            if kind:
                x, y = np.frombuffer(data, dtype=np.int64).reshape(2, -1)
                yield rows(kind, x, y)
                continue
            k, n, wide = np.frombuffer(data, dtype="<i8", count=3).tolist()
            names, at = np.frombuffer(data, dtype=np.int64, count=n, offset=24), 24 + 8 * n
            key = np.frombuffer(data, dtype="<u4", count=k, offset=at).astype(_U)
            keys.append(key | np.frombuffer(data, dtype="<u2", count=k, offset=at + 4 * k).astype(_U) << _U(32))
            code = np.frombuffer(data, dtype=f"<u{wide // 8}", count=k, offset=at + 6 * k)
            owners.append(names[code & ((1 << (wide - 1)) - 1)])
            flags.append(code >> (wide - 1) > 0)
    if not keys:
        return
    key, owner, grouped = np.concatenate(keys), np.concatenate(owners), np.concatenate(flags)
    order = np.argsort(key)
    key, owner, grouped = key[order], owner[order], grouped[order]
    same = np.zeros(len(key), dtype=bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    key, owner, grouped = key[same], owner[same], grouped[same]
    order = np.lexsort((~grouped, owner, key))
    key, owner, grouped = key[order], owner[order], grouped[order]
    if not len(key):
        return
    keep = np.ones(len(key), dtype=bool)
    keep[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner, grouped = key[keep], owner[keep], grouped[keep]
    start, count = _groups(key)
    # a group that had many members in some batch is large, whatever number of batches meet here
    large = np.repeat((count > PAIR_GROUP) | np.logical_or.reduceat(grouped, start), count)
    left, right = [], []
    for step in range(1, PAIR_GROUP):
        at = np.flatnonzero((key[:-step] == key[step:]) & ~large[step:]) if len(key) > step else np.zeros(0, int)
        left.append(owner[at + step])
        right.append(owner[at])
    (x, y), (gk, gm) = _star(key[large], owner[large])
    x, y = np.concatenate([*left, x]), np.concatenate([*right, y])
    if len(x):
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        keep = np.ones(len(x), dtype=bool)
        keep[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        yield rows(1, x[keep], y[keep])
    if len(gk):
        yield rows(2, gk, gm)
    del keys, owners, flags, key, owner, grouped
    textkit.release()


def _set_rows(words: int):
    def run(batches):
        for batch in batches:
            for _, n, row, value, size, sign in _sets(batch.column(0), words):
                ends = np.cumsum(size)
                data = [value[e - s : e].tobytes() for s, e in zip(size, ends, strict=True)]
                yield pa.record_batch([pa.array(sign.view(np.int64)), pa.array(data, pa.binary())], names=["cls", "members"])

    return run


def _verify(percent):
    def run(batches):
        for batch in batches:
            a, b, sa, sb = (batch.column(i) for i in range(4))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(s[i].as_buffer(), dtype=_U) for s in (sa, sb))
                # both sorted: members of the smaller set found in the larger
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < percent * len(y):
                    continue
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            keep = pa.array(keep)
            yield pa.record_batch([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


def _fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """A parity bitmap with fewer bits: its members keep the low bits of their place."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, size), axis=0)


def _near(percent):
    """Pairs whose sketches do not rule the similarity out."""

    def run(batches):
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(i) for i in range(6))
            most = (100 - percent) * (na.to_numpy() + nb.to_numpy()) // (100 + percent)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(s[i].as_buffer(), dtype=np.uint8) for s in (sa, sb))
                size = min(len(x), len(y))
                keep[i] = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum()) <= most[i]
            keep = pa.array(keep)
            yield pa.record_batch([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


class _Verifier:
    """Exact verification of candidate pairs: sketches first, then the whole sets of the pairs left."""

    def __init__(self, docs: DataFrame, filled: DataFrame, words: int, percent: int):
        self.docs, self.filled, self.words, self.percent = docs, filled, words, percent

    def sets_of(self, classes: DataFrame, name: str) -> DataFrame:
        """(cls, members) of the classes (cls), settled; a class may come more than once."""
        ids = settle(self.filled.join(classes, "cls").groupBy("cls").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), f"{name}-ids")
        # rows without an id cannot be named: all of them are read
        needed = keep_ids(self.docs, ids, "left_semi").union(self.docs.filter("doc_id is null")).select("text")
        return settle(needed.mapInArrow(_set_rows(self.words), "cls long, members binary"), f"{name}-members")

    @staticmethod
    def joined(rows: DataFrame, sets: DataFrame, column: str, name: str) -> DataFrame:
        """rows with the set of the class in a column."""
        once = sets.groupBy("cls").agg(F.first("members").alias(name)).withColumnRenamed("cls", column)
        return rows.join(once, column)

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose sets reach the similarity, settled."""
        near = settle(self._near(pairs), f"{name}-near")
        sets = self.sets_of(near.select(F.col("a").alias("cls")).union(near.select("b")).distinct(), name)
        both = self.joined(self.joined(near, sets, "a", "sa"), sets, "b", "sb")
        return settle(both.select("a", "b", "sa", "sb").mapInArrow(_verify(self.percent), "a long, b long"), name)

    def _near(self, pairs: DataFrame) -> DataFrame:
        one = self.filled.groupBy("cls").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        side = lambda c, k: one.select(F.col("cls").alias(c), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        # sizes alone rule many pairs out before any sketch moves
        sized = pairs.join(side("a", 1), "a").join(side("b", 2), "b")
        sized = sized.filter(F.expr(f"100 * least(n1, n2) >= {self.percent} * greatest(n1, n2)"))
        return sized.select("a", "b", "n1", "n2", "s1", "s2").mapInArrow(_near(self.percent), "a long, b long")


def similarity_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Jaccard join of documents on their word shingles.

    docs: columns doc_id, text (others are ignored). Returns one row per input row:
    doc_id, n_shingles, class_id (smallest doc_id with the same set), n_links (all links of
    its class to other classes) and component_id (smallest doc_id
    reachable by links, itself included). A document linked to nothing has its own id.
    Null and blank texts have no shingle, link to nothing and keep their id; a text with
    fewer than `words` words has its whole sequence as its only shingle. A row with a null
    doc_id is returned too; its component is that of its set's other rows, null if none.
    Repeated rows stay repeated; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = settle(docs.mapInArrow(_describe(words), "doc_id long, n long, cls long, sketch binary, shingle long, df long"), "sets")
    described = told.filter("n is not null").select("doc_id", "n", "cls", "sketch")
    totals = described.agg(F.max("n"), F.sum("n")).first()
    if not totals[0]:
        return described.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    top = told.filter("shingle is not null").groupBy("shingle").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "shingle").limit(HOT_SHINGLES).toArrow()
    hot = top.column("shingle").to_numpy().view(_U)
    hot_df = top.column("df").to_numpy()
    order = np.argsort(hot)
    shared = spark.sparkContext.broadcast((hot[order], hot_df[order]))
    bounds = size_bands(int(totals[0]), percent)
    filled = described.filter("n > 0")
    firsts = first_copies(docs, filled, "cls")
    buckets = max(64, int(totals[1]) // BUCKET_KEYS)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 4)

    def emit(batches):
        yield from _emit(words, percent, bounds, *shared.value, buckets)(batches)

    packed = firsts.select("text").mapInArrow(emit, "bucket int, kind int, data binary")
    met = settle(packed.repartition(parts, "bucket").mapInArrow(_meet, "kind int, x long, y long"), "candidates")
    pairs = settle(met.filter("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "pairs")
    members = met.filter("kind = 2").select(F.col("x").alias("key"), F.col("y").alias("node")).distinct()
    verifier = _Verifier(docs, filled, words, percent)
    counts, comp = _close_groups(verifier.links(pairs, "links"), members, verifier)
    return _by_document(described, counts, comp)


#: Bytes of sets and sketches in a block of a large group, and members that one comparison holds.
BLOCK_BYTES, STEP_WORDS = 4 << 20, 1 << 20


class _Lists:
    """Lists of values that are compared by their common values; those of one list only are left out."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        names, code, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = times[code] > 1
        row = np.repeat(np.arange(len(sizes)), sizes)[shared]
        self.code = code[shared].astype(np.int32)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])
        self.there = np.zeros(len(names), dtype=np.uint8)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many values each of the others (sorted) shares with list i."""
        own = self.code[self.ends[i] : self.ends[i + 1]]
        out = np.zeros(len(others), dtype=np.int64)
        if not len(own):
            return out
        self.there[own] = 1
        low, high = self.ends[others], self.ends[others + 1]
        step = (np.cumsum(high - low) - 1) // STEP_WORDS
        for k in np.unique(step).tolist():
            at = np.flatnonzero(step == k)
            a, b = low[at], high[at]
            n = b - a
            if 2 * n.sum() >= b[-1] - a[0]:
                hits = self.there[self.code[a[0] : b[-1]]]
                a, b = a - a[0], b - a[0]
            else:
                b = np.cumsum(n)
                hits, a = self.there[self.code[np.arange(b[-1]) + np.repeat(a - b + n, n)]], b - n
            total = np.concatenate([[0], np.cumsum(hits, dtype=np.int64)])
            out[at] = total[b] - total[a]
        self.there[own] = 0
        return out


def _unit_links(percent: int, whole: bool):
    """Links of a unit (one block of a cluster, or two), each pair in the first of its common clusters: how many each
    member has, and the components that they join. By sketches only, unless whole: the members that may have some."""

    def run(key, part):
        hub, first, second = (k.as_py() for k in key)
        order = np.argsort(part.column("n").to_numpy(), kind="stable")
        part = part.take(pa.array(order))
        node, size, block = (part.column(c).to_numpy() for c in ("node", "n", "block"))
        if whole:
            comp, sets = part.column("comp").to_numpy(), _Lists(np.frombuffer(b"".join(part.column("members").to_pylist()), dtype=_U), size)
        hubs = part.column("hubs").to_pylist()
        before = [[h for h in x if h < hub] for x in hubs]
        seen = _Lists(np.array([h for x in before for h in x], dtype=np.int64), np.array([len(x) for x in before], dtype=np.int64))
        sketches = part.column("sketch").to_pylist()
        # sorted by size, so sketches of one length lie together
        width = np.array([len(x) // 8 for x in sketches], dtype=np.int64)
        start, count = _groups(width)
        bits = [np.frombuffer(b"".join(sketches[a : a + n]), dtype=_U).reshape(n, -1) for a, n in zip(start.tolist(), count.tolist(), strict=True)]
        folded: dict[tuple[int, int], np.ndarray] = {}

        def fold(group: int, to: int) -> np.ndarray:
            if (group, to) not in folded:
                folded[group, to] = np.bitwise_xor.reduce(bits[group].reshape(len(bits[group]), -1, to), axis=1)
            return folded[group, to]

        last = np.searchsorted(size, size * 100 // percent, side="right")
        group_of = np.repeat(np.arange(len(start)), count)
        links, joined = np.zeros(len(node), dtype=np.int64), []
        for i in range(len(node)):
            others = np.arange(i + 1, last[i])
            if first != second:
                others = others[block[others] != block[i]]
            if len(others) and len(before[i]):
                others = others[seen.common(i, others) == 0]
            near = []
            mine = group_of[i]
            for g in range(mine, group_of[others[-1]] + 1 if len(others) else mine):
                some = others[(others >= start[g]) & (others < start[g] + count[g])]
                differ = np.bitwise_count(fold(g, width[i])[some - start[g]] ^ bits[mine][i - start[mine]]).sum(axis=1, dtype=np.int64)
                near.append(some[differ <= (100 - percent) * (size[i] + size[some]) // (100 + percent)])
            others = np.concatenate(near) if near else others
            if not len(others):
                continue
            if whole:
                common = sets.common(i, others)
                others = others[100 * common >= percent * (size[i] + size[others] - common)]
            links[i] += len(others)
            links[others] += 1
            if not whole:
                continue
            apart = np.unique(comp[others][comp[others] != comp[i]])
            joined.append(np.stack([np.full(len(apart), comp[i]), apart]))
        some = np.flatnonzero(links)
        if not whole:
            return pa.table({"hub": pa.array(np.full(len(some), hub)), "node": pa.array(node[some])})
        a, b = forest(*np.concatenate([np.zeros((2, 0), np.int64), *joined], axis=1))
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.table({"node": pa.concat_arrays([pa.array(node[some]), none(len(a))]), "k": pa.concat_arrays([pa.array(links[some]), none(len(a))]), "a": pa.concat_arrays([none(len(some)), pa.array(a)]), "b": pa.concat_arrays([none(len(some)), pa.array(b)])})

    return run


def _units(clusters, rows, heavy):
    """The rows of the members of clusters (hub, node), grouped into units of one or two blocks (hub, first, second)."""
    bytes_of = clusters.join(rows.select("node", (sum(F.octet_length(c) for c in heavy) + 8 * F.size("hubs") + 32).alias("bytes")), "node")
    sized = bytes_of.groupBy("hub").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = clusters.join(sized, "hub").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "hub", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block")
    return dealt.join(rows, "node").groupBy("hub", "first", "second")


def _close_groups(links, members, verifier):
    """(number of links by class, components) with the pairs that the stars left out: members of one large group.

    Members of the groups with one hub (their smallest member) make a cluster. All pairs of
    a cluster are compared in units of one or two blocks of bounded size: by sketches, then
    the members of pairs that these leave by whole sets. A unit gives the number of links of
    each member, not the links, and what joins components. A pair counts in the first
    cluster that both are in; a verified pair counts by itself if there is none.
    """
    comp = components(links)
    named = settle(members.join(members.groupBy("key").agg(F.min("node").alias("hub")), "key").select("hub", "node").distinct(), "named")
    # the star has compared both members of a cluster of two
    large = named.groupBy("hub").agg(F.count(F.lit(1)).alias("k")).filter("k > 2").select("hub")
    clusters = settle(named.join(large, "hub"), "clusters")
    ends = lambda rows: rows.select(F.col("a").alias("cls")).union(rows.select("b")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    if clusters.isEmpty():
        return ends(links), comp
    hubs = settle(clusters.groupBy("node").agg(F.sort_array(F.collect_list("hub")).alias("hubs")), "hubs")
    one = verifier.filled.groupBy("cls").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumnRenamed("cls", "node")
    told = settle(hubs.join(one, "node"), "cluster-sketches")
    maybe = settle(_units(clusters, told, ["sketch"]).applyInArrow(_unit_links(verifier.percent, False), "hub long, node long"), "maybe").distinct()
    maybe = settle(maybe, "maybe-linked")
    sets = verifier.sets_of(maybe.select(F.col("node").alias("cls")).distinct(), "clusters")
    told = verifier.joined(told, sets, "node", "members").join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    told = settle(told, "cluster-sets")
    within = settle(_units(maybe, told, ["sketch", "members"]).applyInArrow(_unit_links(verifier.percent, True), "node long, k long, a long, b long"), "within")
    side = lambda c: hubs.select(F.col("node").alias(c), F.col("hubs").alias(f"_{c}"))
    apart = links.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(~F.coalesce(F.arrays_overlap("_a", "_b"), F.lit(False)))
    counted = within.filter("node is not null").select(F.col("node").alias("cls"), F.col("k").alias("n_links"))
    counts = ends(apart).union(counted).groupBy("cls").agg(F.sum("n_links").alias("n_links"))
    # the components so far are stars, so their edges stand for all links
    more = within.filter("node is null").select("a", "b")
    return counts, components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def _by_document(described, counts, comp):
    filled = described.filter("n > 0")
    ids = filled.groupBy("cls").agg(F.min("doc_id").alias("class_id"))
    named = ids.join(comp.withColumnRenamed("node", "cls"), "cls", "left").join(counts, "cls", "left")
    named = named.select("cls", "class_id", F.coalesce("component", "cls").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    lowest = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = settle(named.join(lowest, "component").select("cls", "class_id", "n_links", "component_id"), "classes")
    out = described.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
