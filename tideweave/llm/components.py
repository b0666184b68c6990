"""Connected components of a distributed list of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideweave.llm.common import dropped, stored

LINKS = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one link for each node but the smallest: (node, smallest node)."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        if (low == label[left]).all() and (low == label[right]).all():
            break
        # roots take the smaller label too, so that whole trees move at once
        for side in (left, right):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while (label != label[label]).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """forest() of the links of each batch."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy() for k in (0, 1))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(a, b)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node that links reach) of every node of the links a, b; both long, not null.

    Each round is two shuffles; partial minima come before them, so that a node with very many links is no hot spot.
    Links within a batch are contracted first. Every round is written to the shared folder.
    """
    edges = stored(links.filter("a <> b").mapInArrow(contracted, LINKS).distinct(), "links")
    size = edges.count()
    while True:
        # large star: neighbours that are larger move to the smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours, and the node itself, move to the smallest of them
        low = moved.groupBy("a").agg(F.min("b").alias("m"))
        after = moved.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        after = stored(after.select("e.a", "e.b").filter("a <> b").distinct(), "links")
        # rounds that change the number of links, most of them, need no join to tell
        before, size = size, after.count()
        same = size == before and after.join(edges, ["a", "b"], "left_semi").count() == size
        dropped(edges.sparkSession, edges)
        edges = after
        if same:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
