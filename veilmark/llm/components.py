"""Connected components of a graph of links, each named by its smallest node.

Alternating large-star and small-star steps: each node's links are moved to the smallest node next to it, first for
its larger neighbours, then for its smaller ones, until every node hangs on its component's smallest.  A step is a
minimum by node (combined map-side) and a join; the number of edges never grows beyond nodes plus links, however large
a component is, and nothing is collected.  Each round is staged, which cuts lineage.

Up to ``FEW_LINKS`` links, counted first, are joined by one task instead: they take a few megabytes, and rounds of joins
would take longer than the work.  Both ways give the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm import staging

MAX_ROUNDS = 50
FEW_LINKS = 300_000


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that pairs (a, b) connect it with."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all links (a, b) of one task."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        found = nodes[labels(len(nodes), at[: len(a)], at[len(a) :])]
        yield pa.RecordBatch.from_arrays([nodes, found], ["node", "component"])


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """edges (a > b).  Large star: links of u to larger nodes go to u's least neighbour; small star: those to smaller."""
    if larger:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = both.join(least, "u")
    if larger:
        moved = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) of all nodes that have a link; links are pairs of longs."""
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    edges = staging.stage(edges, "edges")
    if edges.count() <= FEW_LINKS:
        return staging.stage(edges.coalesce(1).mapInArrow(_together, "node long, component long"), "components")
    mark = None
    for _ in range(MAX_ROUNDS):
        edges = staging.stage(_star(_star(edges, True), False), "star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if tuple(now) == mark and now[0] == now[2]:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
