"""Connected components over an edge table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges of a forest that one task labels; larger ones are labelled by rounds of joins. Both are exact.
FOREST = 400_000


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges(a, b), long columns.

    Tasks first contract the edges that they hold to a forest (an edge from each node to the smallest node that it reaches
    there), before anything is shuffled, then forests are dealt anew and contracted together while that shrinks them. A forest of
    at most FOREST edges is labelled by one task, a larger one by rounds of joins: a node takes the smallest label among
    itself and its neighbours, then the label of that label (pointer jumping), so the rounds follow the logarithm of the
    diameter. Tables are written to the shared folder; a number of rows a round goes to the driver.
    Loops, repeated edges and either direction are fine; rows with a null end count for nothing; an
    empty table gives no rows.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = written(e.mapInArrow(_forest, "a long, b long"), "forest")
    n = e.count()
    while n > FOREST:
        after = written(e.repartition(math.ceil(n / FOREST)).mapInArrow(_forest, "a long, b long"), "forest")
        e, before, n = after, n, after.count()
        if n > 0.7 * before:
            break
    return _labels_by_joins(e) if n > FOREST else e.repartition(1).mapInArrow(_labels, "node long, component long")


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and the smallest node that each reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, root = place[: len(a)], place[len(a) :], np.arange(len(nodes))
    while True:
        x, y = root[i], root[j]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _gathered(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A task's edges, contracted whenever there are many."""
    a, b, held = [], [], 0
    for batch in batches:
        a.append(batch.column("a").to_numpy())
        b.append(batch.column("b").to_numpy())
        held += len(a[-1])
        if held > most:
            node, root = _contracted(np.concatenate(a), np.concatenate(b))
            a, b, held = [node[node != root]], [root[node != root]], 0
    return _contracted(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, root = _gathered(batches)
    # a node without another is still a node
    alone = np.setdiff1d(node[node == root], root[node != root])
    yield pa.record_batch([pa.array(np.concatenate([node[node != root], alone])), pa.array(np.concatenate([root[node != root], alone]))], ["a", "b"])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, root = _gathered(batches)
    yield pa.record_batch([pa.array(node), pa.array(root)], ["node", "component"])


def _labels_by_joins(e: DataFrame) -> DataFrame:
    both = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after = written(lower.join(up, "component", "left").select("node", F.coalesce(F.least("component", "up"), "component").alias("component"), "was"), "labels")
        labels = after.select("node", "component")
        if after.where("component <> was").isEmpty():
            return labels


def roots(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For links between places i and j of ids: the smallest id that each place reaches."""
    places, low = _contracted(i, j)
    root = ids.copy()
    if len(places):
        _, group = np.unique(low, return_inverse=True)
        least = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids[places])
        root[places] = least[group]
    # equal ids at several places are one node
    while True:
        kinds, of = np.unique(ids, return_inverse=True)
        least = np.full(len(kinds), np.iinfo(np.int64).max)
        np.minimum.at(least, of, root)
        after = np.minimum(root, least[of])
        if len(places):
            low = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, group, after[places])
            after[places] = np.minimum(after[places], low[group])
        if (after == root).all():
            return root
        root = after
