"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._spark import dropped, stored, swept


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest reachable node) for each node that isn't that node itself, by label spreading in numpy."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _local(batches):
    """Each batch of edges becomes stars: at most as many rows, same components."""
    for batch in batches:
        a, b = (np.asarray(batch.column(i)) for i in range(2))
        if len(a):
            u, v = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a long, b long); component is the smallest node reachable.

    The minimum of a node's neighbours is a partial aggregate, so a hub is never gathered in one task; the join that
    hands the minimum out is one that AQE may split. Rounds end when a round changes no edge."""
    now = stored(edges.select("a", "b").filter("a <> b").mapInArrow(_local, "a long, b long"), "cc")
    swept(edges.sparkSession)
    before = None
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        fresh = stored(small.filter("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "cc")
        dropped(now)
        now = fresh
        seen = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(seen) == before:
            break
        before = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    star = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = star.select(F.col("component").alias("node"), "component").distinct()
    return star.unionByName(roots)
