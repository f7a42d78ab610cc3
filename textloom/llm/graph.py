"""Connected components over edges that never leave the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settle


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of a list of edges that are not the smallest."""
    names, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        # the roots of both ends move to the smaller one, then paths are halved until flat
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        if (label[x] == label[y]).all():
            break
    child = label != np.arange(len(names))
    return names[child], names[label[child]]


def _contract(batches):
    """The edges of a partition as stars: (a, b, moved), moved where a star has an edge that was not there."""
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(c) for c in zip(*parts, strict=True))
    node, root = forest(a, b)
    pair = np.dtype([("a", "<i8"), ("b", "<i8")])
    old, new = np.empty(len(a), pair), np.empty(len(node), pair)
    old["a"], old["b"], new["a"], new["b"] = np.maximum(a, b), np.minimum(a, b), node, root
    old = np.unique(old)
    at = np.minimum(np.searchsorted(old, new), len(old) - 1)
    changed = (old[at] != new) if len(old) == len(new) else np.ones(len(new), bool)
    yield pa.record_batch([pa.array(node), pa.array(root), pa.array(changed)], names=["a", "b", "moved"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node on an edge: columns (node, component), settled.

    edges: columns (a, b), any order, duplicates and loops allowed. In a round all edges
    of a child meet in one partition, whose edges become stars around their smallest
    nodes; then every parent is replaced by its own parent. A child has few parents
    (the hubs that it was compared with), and the join on parents, of which one may have
    very many children, can be split by adaptive execution. The rounds end when nothing
    has moved; each is written to the shared folder.
    """
    flat = "a long, b long, moved boolean"
    current = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_contract, flat)
    for _ in range(rounds):
        stars = settle(current.select("a", "b").repartition("a").mapInArrow(_contract, flat), "stars")
        up = stars.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jumped = stars.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), (F.col("moved") | F.col("c").isNotNull()).alias("moved"))
        current = settle(jumped, "jumped")
        if current.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return settle(current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), "components")
