"""Connected components of an edge list, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.llm.common import Scratch, lean

#: Edges that a partition contracts at a time.
HELD = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges' components as stars: each node but the smallest of its component, with that."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label
        least = np.minimum(label[x], label[y])
        label = label.copy()
        # Both ends' current labels take the smaller one, then every node jumps to its label's label.
        np.minimum.at(label, before[x], least)
        np.minimum.at(label, before[y], least)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            break
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def emitted() -> pa.RecordBatch:
        a, b = stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        n += batch.num_rows
        if n >= HELD:
            yield emitted()
            held, n = [], 0
    if n:
        yield emitted()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: the smallest node reachable, for every node of ``edges`` (a, b: bigint).

    Each partition first contracts its own edges to stars, so that a hub has no more parents than there are partitions. Then
    large-star and small-star steps alternate: a node's children move to its smallest parent, and its parents to the smallest of
    them. The join by parent, where a hub's children meet, has exchanged tables on both sides, which Spark splits where they
    are skewed. It ends when all parents are roots and every node has one. The tables of a round go with the next one.
    """
    simple = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = scratch.table(simple.mapInArrow(lean(_contracted), "a bigint, b bigint").distinct(), "edges")
    while True:
        least = scratch.table(now.groupBy("a").agg(F.min("b").alias("m")), "parents")
        single = now.count() == least.count()
        inner = now.select("b").distinct().join(least.select(F.col("a").alias("b")), "b", "left_semi")
        if single and inner.isEmpty():
            scratch.drop(least)
            break
        up = least.select(F.col("a").alias("b"), "m")
        large = scratch.table(now.join(up, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct(), "large")
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b")
        before, now = now, scratch.table(small.distinct(), "edges")
        scratch.drop(before, least, large)
    flat = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return flat.unionByName(flat.select(F.col("label").alias("node"), "label").distinct())
