"""Connected components by contraction, on stored tables; no links or labels pass the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges that one step of ``forest`` holds; bounds its memory, whatever the size of a task.
BLOCK = 1 << 18


def block_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 with edges (a, b) the least node that each can reach."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        live = x != y
        if not live.any():
            return root
        a, b = a[live], b[live]
        np.minimum.at(root, np.maximum(x, y)[live], np.minimum(x, y)[live])
        while not np.array_equal(up := root[root], root):
            root = up


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes: every block of rows of a task is replaced by stars
    around its components' nodes of least hash. No shuffle; a star has no more edges than its nodes."""
    kind = dict(edges.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            both = lambda x, y: pa.chunked_array([c for n in (x, y) for c in (b.column(n) for b in held)]).combine_chunks()
            coded = both("a", "b").dictionary_encode()
            code, ids = coded.indices.to_numpy(), coded.dictionary
            h = np.zeros(len(ids), np.int64)
            h[code] = both("ha", "hb").to_numpy()
            order = np.argsort(h, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            x = rank[code]
            root = block_roots(x[: len(x) // 2], x[len(x) // 2 :], len(ids))
            leaf = np.flatnonzero(root != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(order[root[leaf]])), ids.take(pa.array(order[leaf]))], ["a", "b"])

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BLOCK:
                yield stars(held)
                held, rows = [], 0
        if rows:
            yield stars(held)

    return edges.select("a", "b", F.xxhash64("a").alias("ha"), F.xxhash64("b").alias("hb")).mapInArrow(run, f"a {kind}, b {kind}")


def labels_of(edges: DataFrame) -> DataFrame:
    """node, label: nodes of one component share a label (some node of it). edges: a, b.

    Each round every task first replaces its edges by stars, then every node moves to the neighbour
    (or itself) of least hash, which at least halves the nodes of a component on average; edges
    inside a label go. Nodes without an edge have no row."""
    edges = stored(edges.where("a <> b"), "edges")
    labels = None
    while not edges.isEmpty():
        edges = stored(forest(edges), "stars")
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        step = both.groupBy("node").agg(F.min(order("other")).alias("m")).select("node", F.least(F.col("m"), order("node"))["id"].alias("label"))
        step = stored(step, "labels")
        at = lambda c: step.select(F.col("node").alias(c), F.col("label").alias("to_" + c))
        edges = stored(edges.join(at("a"), "a").join(at("b"), "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")), "edges")
        if labels is None:
            labels = step
        else:
            moved = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = stored(labels.join(moved, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def more_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels with more edges (a, b), which only join components of the former ones."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias("l" + c))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    moved = labels_of(between)
    old = labels.join(moved.toDF("label", "next"), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return stored(old.union(moved.join(labels, "node", "left_anti").select("node", "label")), "labels")
