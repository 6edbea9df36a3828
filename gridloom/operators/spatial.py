"""Spatial indices as cell keys: quadtrees, kd-trees, polar quadtrees, radius queries and leaf graphs.

There is no mutable tree: a leaf is a row (level, cell). A level is one grouped count; only cells over capacity go on."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import hilbert
from gridloom.functions.scalars import distance, polar_distance
from gridloom.session import settle


def cell_at(axes: Sequence[str], box, level: Column | int) -> Column:
    """Array of cell positions of a point on the 2^level grid over the box."""
    side = F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(float(level)))
    return F.array(*[F.least(F.floor(hilbert.scaled(F.col(a), lo, hi) * side), (side - 1)).cast("long") for a, lo, hi in zip(axes, *box, strict=True)])


def quadtree(points: DataFrame, axes: Sequence[str], capacity: int, box=None, deepest: int = 20, key: str = "v") -> tuple[DataFrame, DataFrame]:
    """(v, level, cell) of each point's leaf, and leaves(level, cell, n, low, high): every leaf holds at most capacity
    points unless it is at the deepest level. Empty siblings of a split are leaves too, with n = 0."""
    box = box or hilbert.bounds(points, axes)
    dims, now = len(axes), settle(points.select(F.col(key).alias("v"), *axes))
    inner = [settle(now.sparkSession.createDataFrame([], "level int, cell array<long>"))]
    open_points = now
    for level in range(deepest):
        counts = open_points.withColumn("cell", cell_at(axes, box, level)).groupBy("cell").count().filter(F.col("count") > capacity).select(F.lit(level).alias("level"), "cell")
        full = settle(counts)
        if full.isEmpty():
            break
        inner.append(full)
        open_points = open_points.withColumn("cell", cell_at(axes, box, level)).join(full.select("cell"), "cell", "left_semi").drop("cell")
    splits = inner[0]
    for x in inner[1:]:
        splits = splits.unionByName(x)
    # A point's leaf lies one level below its deepest split cell.
    deep = len(inner) - 1
    up = now.select("v", *axes, F.explode(F.sequence(F.lit(0), F.lit(max(deep - 1, 0)))).alias("level")) if deep else None
    if up is None:
        leaf = now.select("v", F.lit(0).alias("level"), cell_at(axes, box, 0).alias("cell"))
    else:
        hit = up.withColumn("cell", cell_at(axes, box, F.col("level").cast("double"))).join(splits, ["level", "cell"], "left_semi").groupBy("v").agg(F.max("level").alias("at"))
        lev = F.coalesce(F.col("at") + 1, F.lit(0))
        leaf = now.join(hit, "v", "left").withColumn("level", lev).select("v", "level", cell_at(axes, box, F.col("level").cast("double")).alias("cell"))
    leaf = settle(leaf)
    half = F.array(*[F.struct(*[F.lit(i >> (dims - 1 - d) & 1).alias(f"d{d}") for d in range(dims)]) for i in range(1 << dims)])
    kids = splits.select((F.col("level") + 1).alias("level"), "cell", F.explode(half).alias("h")).select("level", F.array(*[F.col("cell")[d] * 2 + F.col(f"h.d{d}") for d in range(dims)]).alias("cell"))
    root = now.sparkSession.createDataFrame([(0, [0] * dims)], "level int, cell array<long>")
    cells = root.unionByName(kids).join(splits, ["level", "cell"], "left_anti")
    n = leaf.groupBy("level", "cell").agg(F.count("*").alias("n"))
    width = [F.lit(hi - lo) / F.pow(F.lit(2.0), F.col("level").cast("double")) for lo, hi in zip(*box, strict=True)]
    low = F.array(*[F.lit(lo) + F.col("cell")[d] * width[d] for d, lo in enumerate(box[0])])
    leaves = cells.join(n, ["level", "cell"], "left").select(F.col("level").cast("int").alias("level"), "cell", F.coalesce("n", F.lit(0)).alias("n"), low.alias("low"), F.array(*[F.lit(lo) + (F.col("cell")[d] + 1) * width[d] for d, lo in enumerate(box[0])]).alias("high"))
    return leaf, leaves


def tree_statistics(leaves: DataFrame, dims: int) -> DataFrame:
    """(height, leaves, nodes, elements) of a quadtree's leaves; a full tree of L leaves has (L - 1) / (2^d - 1) splits."""
    return leaves.agg((F.max("level") + 1).alias("height"), F.count("*").alias("leaves"), (F.count("*") + ((F.count("*") - 1) / ((1 << dims) - 1)).cast("long")).alias("nodes"), F.sum("n").alias("elements"))


def coarsened(leaves: DataFrame, dims: int, least: int = 4) -> DataFrame:
    """leaves(level, cell, n) after sibling leaves that together hold fewer than ``least`` points merge, once."""
    up = leaves.filter("level > 0").withColumn("parent", F.transform("cell", lambda x: F.floor(x / 2)))
    merged = up.groupBy((F.col("level") - 1).alias("level"), F.col("parent").alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("c")).filter((F.col("c") == 1 << dims) & (F.col("n") < least))
    gone = merged.select((F.col("level") + 1).alias("level"), F.col("cell").alias("parent"))
    return leaves.withColumn("parent", F.transform("cell", lambda x: F.floor(x / 2))).join(gone, ["level", "parent"], "left_anti").select("level", "cell", "n").unionByName(merged.select("level", "cell", "n"))


def leaf_graph(leaves: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """Vertices (v, centre) and edges of the leaves that share a face. A leaf asks for the cell beyond each face, at its
    own and all coarser levels: an equi-join on (level, cell), never a comparison of all pairs."""
    from gridloom.operators.ranks import with_rank

    v = settle(with_rank(leaves.withColumn("name", F.concat(F.lpad(F.col("level").cast("string"), 3, "0"), F.array_join(F.transform("cell", lambda c: F.lpad(c.cast("string"), 12, "0")), "_"))), ["name"], "v"))
    ways = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d in range(dims) for s in (-1, 1)])
    ask = v.select(F.col("v").alias("src"), "level", "cell", F.explode(ways).alias("w"))
    beyond = F.transform("cell", lambda c, i: c + F.when(i == F.col("w.d"), F.col("w.s")).otherwise(0))
    ask = ask.withColumn("to", beyond).filter(F.forall("to", lambda c: (c >= 0) & (c < F.shiftleft(F.lit(1).cast("long"), 62)) & (c.cast("double") < F.pow(F.lit(2.0), F.col("level").cast("double")))))
    ask = ask.select("src", F.col("level").alias("own"), "to", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("level"))
    ask = ask.withColumn("cell", F.transform("to", lambda c: F.floor(c / F.pow(F.lit(2.0), (F.col("own") - F.col("level")).cast("double")))))
    e = ask.join(v.select("level", "cell", F.col("v").alias("dst")), ["level", "cell"]).select("src", "dst").filter("src <> dst")
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("w", F.lit(1.0))
    return v.select("v", "level", "cell", F.zip_with("low", "high", lambda a, b: (a + b) / 2).alias("centre")), e


def within_radius(points: DataFrame, queries: DataFrame, axes: Sequence[str], radius: float, key: str = "v", query: str = "q") -> DataFrame:
    """(q, v, dist): points nearer than radius (strictly) to each query: grid cells of that width, an equi-join on the
    cell and its neighbours, then the exact distance."""
    dims = len(axes)
    cell = lambda p: [F.floor(F.col(f"{p}{a}") / F.lit(float(radius))).cast("long") for a in axes]
    p = points.select(F.col(key).alias("v"), *[F.col(a).cast("double").alias(f"p_{a}") for a in axes]).select("*", *[c.alias(f"c{i}") for i, c in enumerate(cell("p_"))])
    q = queries.select(F.col(query).alias("q"), *[F.col(a).cast("double").alias(f"q_{a}") for a in axes]).select("*", *[c.alias(f"b{i}") for i, c in enumerate(cell("q_"))])
    for i in range(dims):
        q = q.withColumn(f"c{i}", F.explode(F.sequence(F.col(f"b{i}") - 1, F.col(f"b{i}") + 1)))
    j = q.join(p, [f"c{i}" for i in range(dims)]).withColumn("dist", distance([F.col(f"p_{a}") for a in axes], [F.col(f"q_{a}") for a in axes]))
    return j.filter(F.col("dist") < radius).select("q", "v", "dist")


def sampled_by_distance(points: DataFrame, query: Sequence[float], axes: Sequence[str], probability: Callable[[Column], Column], seed: int = 0, key: str = "v", polar: bool = False) -> DataFrame:
    """(v, dist): each point with the given probability of its distance; the draw depends on the seed and the id alone."""
    if polar:
        d = polar_distance(F.col(axes[0]), F.col(axes[1]), F.lit(float(query[0])), F.lit(float(query[1])))
    else:
        d = distance([F.col(a).cast("double") for a in axes], [F.lit(float(x)) for x in query])
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return points.select(F.col(key).alias("v"), d.alias("dist"), draw.alias("u")).filter(F.col("u") < probability(F.col("dist"))).select("v", "dist")


def polar_split(low: Sequence[float], high: Sequence[float], balance: float = 0.5) -> tuple[float, float]:
    """Where a polar cell (angle, radius) splits: at the middle angle and at a radius that shares its area."""
    return (low[0] + high[0]) / 2, float(np.sqrt(high[1] ** 2 * (1 - balance) + low[1] ** 2 * balance))


def polar_cells(points: DataFrame, angle: str, radius: str, level: int, most: float, key: str = "v") -> DataFrame:
    """(v, cell): cells of the polar quadtree of that level over radius [0, most], area-balanced: the angle is cut
    evenly, the squared radius too."""
    side = 1 << level
    a = F.least(F.floor(F.pmod(F.col(angle), F.lit(2 * np.pi)) / (2 * np.pi) * side), F.lit(side - 1))
    r = F.least(F.floor(F.col(radius) * F.col(radius) / float(most * most) * side), F.lit(side - 1))
    return points.select(F.col(key).alias("v"), (a * side + r).cast("long").alias("cell"))


def kd_tree(points: DataFrame, axes: Sequence[str], levels: int, key: str = "v", accuracy: int = 10_000) -> DataFrame:
    """(v, leaf): at each level every node splits at the (approximate) median of its widest-spread axis. Node statistics,
    at most 2^levels rows, are the only thing joined back."""
    now = points.select(F.col(key).alias("v"), *[F.col(a).cast("double").alias(a) for a in axes], F.lit(0).alias("leaf"))
    for _ in range(levels):
        stats = now.groupBy("leaf").agg(*[(F.max(a) - F.min(a)).alias(f"s_{a}") for a in axes], *[F.percentile_approx(a, 0.5, accuracy).alias(f"m_{a}") for a in axes])
        widest = F.greatest(*[F.col(f"s_{a}") for a in axes]) if len(axes) > 1 else F.col(f"s_{axes[0]}")
        side = F.lit(0)
        for a in reversed(axes):
            side = F.when(F.col(f"s_{a}") == widest, (F.col(a) > F.col(f"m_{a}")).cast("int")).otherwise(side)
        now = settle(now.join(F.broadcast(stats), "leaf").select("v", *axes, (F.col("leaf") * 2 + side).alias("leaf")))
    return now.select("v", "leaf")
