"""Approximate nearest neighbours in a hierarchical k-means tree.

The tree is fitted on a bounded sample and broadcast; every vector is indexed by its leaf.
A query walks the tree best bin first: a priority queue holds branches by the distance of
the query to their centre, and leaves come out nearest first. How many leaves a search
visits is calibrated on the whole table: some of the queries are compared with every row,
and visits are widened until the leaves seen hold the target share of their neighbours.
Neighbouring leaves share a part, large ones are dealt over several; a query meets a part
once, whatever number of its leaves it visits there, and gets at most k ids back from it.
Queries for which that finds fewer than k ids visit every leaf. Distances are those of the
original vectors.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import settle
from .textkit import mix

#: Vectors and components that the tree is fitted on at most (chosen by a hash of their id), its branching and vectors
#: per leaf there. Beyond that size leaves grow with the table and are dealt over several parts.
FIT_VECTORS, FIT_VALUES, BRANCH, LEAF = 20_000, 4 << 20, 8, 40
#: Queries at most that are compared with every row to steer how many leaves are visited, and the recall asked for.
CALIBRATION, RECALL = 200, 0.96
#: Components of the vectors of a part.
PART_VALUES = 512 << 10
#: Queries that a part meets in one step.
BLOCK = 128


class Tree:
    """Nodes with their children's centres; a leaf has a number."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self._node(data, rng)

    def _node(self, data: np.ndarray, rng) -> int:
        at = len(self.children)
        self.children.append([])
        self.centres.append(np.zeros((0, data.shape[1])))
        self.leaf.append(-1)
        centres, label = self._means(data, rng) if len(data) > LEAF else (None, None)
        if centres is None or len(centres) < 2:
            self.leaf[at] = self.leaves
            self.leaves += 1
            return at
        self.centres[at] = centres
        self.children[at] = [self._node(data[label == k], rng) for k in range(len(centres))]
        return at

    @staticmethod
    def _means(data: np.ndarray, rng):
        distinct = np.unique(data, axis=0)
        if len(distinct) < 2:
            return None, None
        centres = distinct[rng.choice(len(distinct), min(BRANCH, len(distinct)), replace=False)].astype(np.float64)
        label = None
        for _ in range(12):
            far = (centres**2).sum(1) - 2 * data @ centres.T
            new = far.argmin(axis=1)
            if label is not None and (new == label).all():
                break
            label = new
            centres = np.stack([data[label == k].mean(axis=0) if (label == k).any() else centres[k] for k in range(len(centres))])
        used = np.unique(label)
        return centres[used], np.searchsorted(used, label)

    def leaf_of(self, data: np.ndarray) -> np.ndarray:
        """The leaf that each vector is stored in."""
        out = np.zeros(len(data), dtype=np.int64)
        todo = [(0, np.arange(len(data)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[node]
            label = ((c**2).sum(1) - 2 * data[rows] @ c.T).argmin(axis=1)
            todo.extend((child, rows[label == k]) for k, child in enumerate(self.children[node]) if (label == k).any())
        return out

    def visit(self, query: np.ndarray, leaves: int) -> list[int]:
        """The first leaves of a best-bin-first search, nearest first."""
        queue, out, tie = [(0.0, 0, 0)], [], 1
        while queue and len(out) < leaves:
            _, _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                far = ((self.centres[node] - query) ** 2).sum(axis=1)
                near = int(far.argmin())
                for k, child in enumerate(self.children[node]):
                    if k != near:
                        heapq.heappush(queue, (float(far[k]), tie, child))
                        tie += 1
                node = self.children[node][near]
            out.append(self.leaf[node])
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def distances(query: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    return np.sqrt(((data - query) ** 2).sum(axis=1))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part: of any length, finite, not zero."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))


def _first(far: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest distances, nearest first, ties to the smaller id."""
    some = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1]) if len(far) > k else np.arange(len(far))
    return some[np.lexsort((ids[some], far[some]))][:k]


class Part:
    """Vectors of some leaves, for exact searches among the leaves that a query visits."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: np.ndarray):
        order = np.lexsort((ids, leaf))
        self.ids, self.points, self.leaf = ids[order], points[order], leaf[order]
        self.leaves, self.begin = np.unique(self.leaf, return_index=True)
        self.end = np.append(self.begin[1:], len(ids))
        self.repeats = len(np.unique(ids)) < len(ids)
        self.square = (self.points**2).sum(axis=1)
        # products of very large or small components would lose the order
        self.tame = 1e-200 < self.square.min(initial=1.0) <= self.square.max(initial=1.0) < 1e200

    def _rows(self, visited: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(np.isin(self.leaves, visited, assume_unique=True))
        return np.concatenate([np.arange(self.begin[i], self.end[i]) for i in at]) if len(at) else np.zeros(0, np.int64)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, visits: list[np.ndarray], k: int):
        """(ids, distances) of the k nearest ids of each query."""
        for at in range(0, len(queries), BLOCK):
            block = queries[at : at + BLOCK]
            scale = (block**2).sum(axis=1)
            rough = self.tame and not self.repeats and 1e-200 < scale.min() <= scale.max() < 1e200
            # without the query's own square, which changes no order
            near = self.square - 2 * block @ self.points.T if rough else None
            for i, q in enumerate(block):
                rows = self._rows(visits[at + i])
                rows = rows[self.ids[rows] != query_ids[at + i]]
                if rough and len(rows) > k:
                    some = near[i][rows]
                    slack = 1e-9 * (scale[i] + self.square[rows].max())
                    rows = rows[some <= np.partition(some, k - 1)[k - 1] + slack]
                far, ids = distances(q, self.points[rows]), self.ids[rows]
                if self.repeats:
                    # an id is as near as its nearest row
                    order = np.lexsort((far, ids))
                    order = order[np.append(True, np.diff(ids[order]) != 0)] if len(order) else order
                    far, ids = far[order], ids[order]
                best = _first(far, ids, k)
                yield ids[best], far[best]


@dataclass
class Index:
    """Trees by length of vector, and where the leaves are: for each length, part and salts of each leaf, and its rows."""

    trees: dict[int, Tree]
    place: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def leaf_of(self, dims: np.ndarray, vectors: pa.Array) -> np.ndarray:
        leaf = np.zeros(len(dims), dtype=np.int64)
        for dim in np.unique(dims).tolist():
            if dim in self.trees:
                rows = np.flatnonzero(dims == dim)
                leaf[rows] = self.trees[dim].leaf_of(_matrix(vectors.take(pa.array(rows))))
        return leaf

    def visit(self, query: np.ndarray, leaves: int | None, least: int) -> list[int]:
        """Leaves that a query visits: the first ones, and more until they hold `least` rows; all if leaves is None."""
        tree = self.trees.get(len(query))
        if tree is None:
            return [0]
        order = tree.visit(query, tree.leaves)
        if leaves is None:
            return order
        enough = int(np.searchsorted(np.cumsum(self.place[len(query)][2][order]), least)) + 1
        return order[: max(leaves, enough)]


def _parts(sizes: list, trees: dict[int, Tree]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of neighbouring leaves from (dim, leaf, rows); a leaf above the size of a part is dealt over salts."""
    out = {}
    for dim in sorted({r.dim for r in sizes}):
        rows = np.zeros(trees[dim].leaves if dim in trees else 1, dtype=np.int64)
        for r in sizes:
            if r.dim == dim:
                rows[r.leaf] = r.n
        most = max(1, PART_VALUES // dim)
        part, held = np.zeros(len(rows), dtype=np.int64), 0
        for leaf in range(1, len(rows)):
            held += rows[leaf - 1]
            new = held + rows[leaf] > most
            part[leaf] = part[leaf - 1] + new
            held = 0 if new else held
        out[dim] = (part, np.maximum(-(-rows // most), 1), rows)
    return out


def _widened(spark, index: Index, indexed: DataFrame, asked: DataFrame, k: int) -> dict[int, int]:
    """Leaves to visit, by length of vector, so that the calibration queries see the target share of their neighbours among all rows."""
    rows = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).toArrow()
    ids, vectors = rows.column(0).to_numpy(), rows.column(1).combine_chunks()
    dims = pc.list_value_length(vectors).to_numpy()
    queries = {}
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        if dim in index.trees:
            points = _matrix(vectors.take(pa.array(at)))
            turn = np.empty((len(at), index.trees[dim].leaves), dtype=np.int32)
            for i, q in enumerate(points):
                turn[i, index.trees[dim].visit(q, index.trees[dim].leaves)] = np.arange(index.trees[dim].leaves)
            queries[dim] = (ids[at], points, turn)
    if not queries:
        return {}
    shared = spark.sparkContext.broadcast(queries)

    def compare(batches):
        best: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for dim, (names, points, turn) in shared.value.items():
                at = np.flatnonzero(sizes == dim)
                if not len(at):
                    continue
                some = batch.take(pa.array(at))
                leaf = some.column(3).to_numpy()
                part = Part(some.column(0).to_numpy(), _matrix(some.column(1)), np.zeros(len(at), np.int64))
                where = dict(zip(some.column(0).to_pylist(), leaf.tolist(), strict=True))
                for i, (found, far) in enumerate(part.search(names, points, [np.zeros(1, np.int64)] * len(names), k)):
                    held = best.get((dim, i), (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)))
                    found, far, seen = (np.concatenate(c) for c in zip(held, (found, far, turn[i, [where[v] for v in found.tolist()]].astype(np.int64)), strict=True))
                    keep = _first(far, found, k)
                    best[dim, i] = (found[keep], far[keep], seen[keep])
        for (dim, i), (_, far, seen) in best.items():
            n = len(far)
            yield pa.record_batch([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, i)), pa.array(far), pa.array(seen)], names=["dim", "query", "far", "turn"])

    near = indexed.select("vec_id", "embedding", "dim", "leaf").mapInArrow(compare, "dim int, query long, far double, turn long")
    order = Window.partitionBy("dim", "query").orderBy("far", "turn")
    turns = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).groupBy("dim", "turn").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for dim in queries:
        found = np.zeros(index.trees[dim].leaves, dtype=np.int64)
        for r in turns:
            if r.dim == dim:
                found[r.turn] += r.n
        seen = np.cumsum(found)
        out[dim] = int(np.searchsorted(seen, RECALL * seen[-1])) + 1 if seen[-1] else 1
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest found rows of `vectors` for each row of `queries` (both vec_id, embedding).

    Returns query_id, rank (from 1), vec_id and score (Euclidean distance in double
    precision), nearest first, ties to the smaller vec_id; a query's own id is no
    candidate, nor is any row with that id. Vectors that are null, empty, zero or hold
    null or non-finite components take no part, nor do rows without an id or vectors of
    another length than the query. An id that repeats in `queries` is asked once (with
    the smallest of its vectors); one that repeats in `vectors` is as near as its nearest
    vector. There are fewer rows than k only where there are fewer candidates; empty
    tables give none.
    """
    spark = vectors.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = usable(vectors)
    asked = settle(usable(queries).repartition(width, "vec_id").groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "asked")
    longest = base.agg(F.max(F.size("embedding"))).first()[0]
    if not longest:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # one row of each sampled id: the places of neighbours belong to ids
    most = max(1, min(FIT_VECTORS, FIT_VALUES // longest))
    ids = settle(base.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(most), "fitted")
    rows = base.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").toArrow().column(0).combine_chunks()
    # one tree for each length of vector; lengths that the sample lacks get a single leaf
    dims = pc.list_value_length(sample).to_numpy()
    trees = {dim: Tree(_matrix(sample.filter(pa.array(dims == dim)))) for dim in np.unique(dims).tolist()}
    grown = spark.sparkContext.broadcast(Index(trees, {}))

    def store(batches):
        for batch in batches:
            dims = pc.list_value_length(batch.column(1)).to_numpy()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(grown.value.leaf_of(dims, batch.column(1)))], names=["vec_id", "embedding", "dim", "leaf"])

    indexed = settle(base.mapInArrow(store, "vec_id long, embedding array<double>, dim int, leaf long"), "leaves")
    # one row for each leaf of the trees and each other length of vector
    index = Index(trees, _parts(indexed.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("n")).collect(), trees))
    visits = _widened(spark, index, indexed, asked, k)
    shared = spark.sparkContext.broadcast(index)

    def place(batches):
        index = shared.value
        for batch in batches:
            dims, leaf = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            part, salts = np.zeros(len(dims), np.int64), np.ones(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                at = dims == dim
                part[at], salts[at] = index.place[dim][0][leaf[at]], index.place[dim][1][leaf[at]]
            salt = (mix(batch.column(0).to_numpy().view(np.uint64)) % salts.astype(np.uint64)).astype(np.int64)
            yield pa.record_batch([*batch.columns, pa.array(part), pa.array(salt)], names=["vec_id", "embedding", "dim", "leaf", "part", "salt"])

    def walk(visits):
        def run(batches):
            index = shared.value
            for batch in batches:
                rows = []
                for name, q in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    q = q.values.to_numpy()
                    if len(q) not in index.place:
                        continue
                    part, salts, _ = index.place[len(q)]
                    leaves = np.array(index.visit(q, None if visits is None else visits.get(len(q), 1), k + 1))
                    for p in np.unique(part[leaves]).tolist():
                        here = leaves[part[leaves] == p]
                        rows += [(name, q, len(q), p, s, here) for s in range(int(salts[here].max()))]
                kinds = [pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "query", "dim", "part", "salt", "visits"])

        return run

    def meet(key, left, right):
        found = [(q, *best) for q, best in _met(left, right, k) if len(best[0])]
        columns = zip(*found, strict=True) if found else [[]] * 3
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        return pa.table({n: pa.array(list(c), t) for n, c, t in zip(("query_id", "vec_id", "score"), columns, kinds, strict=True)})

    keys = ["dim", "part", "salt"]
    stored = indexed.mapInArrow(place, "vec_id long, embedding array<double>, dim int, leaf long, part long, salt long")

    def found(asked, visits, name):
        wanted = asked.mapInArrow(walk(visits), "query_id long, query array<double>, dim int, part long, salt long, visits array<long>")
        met = stored.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id array<long>, score array<double>")
        pairs = met.select("query_id", F.explode(F.arrays_zip("vec_id", "score")).alias("x")).select("query_id", "x.vec_id", "x.score")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        once = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return settle(once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), name)

    out = found(asked, visits, "found")
    # the last rank is there for all queries that found enough
    full = out.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = settle(asked.join(full, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return out
    again = found(short, None, "all-leaves")
    return out.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(*again.columns).union(again)


def _met(left: pa.Table, right: pa.Table, k: int):
    """(query id, (ids, distances)) of a part's queries."""
    if not left.num_rows or not right.num_rows:
        return
    part = Part(left.column("vec_id").to_numpy(), _matrix(left.column("embedding").combine_chunks()), left.column("leaf").to_numpy())
    names = right.column("query_id").to_numpy()
    visits = [v.values.to_numpy() for chunk in right.column("visits").chunks for v in chunk]
    yield from zip(names.tolist(), part.search(names, _matrix(right.column("query").combine_chunks()), visits, k), strict=True)
