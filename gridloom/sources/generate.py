"""Mesh generators: vertices(v, x, y[, z], w0) and edges(src, dst, w) straight from spark.range."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import grid_position

AXES = ("x", "y", "z")


def grid(spark: SparkSession, sides: Sequence[int], extent: Sequence[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """A structured grid, row-major ids, point i * extent / side on each axis, unit edges to the axis neighbours. Three
    sides A, B, C give 3ABC - AB - AC - BC undirected edges; a z side of 1 is a plane."""
    extent = list(extent or sides)
    if len(sides) == 2:
        extent = extent[:2]
    n = math.prod(sides)
    ids = spark.range(n).select(F.col("id").alias("v"))
    pos = grid_position(F.col("v"), sides)
    vertices = ids.select("v", *[(p * (e / s)).cast("double").alias(a) for p, s, e, a in zip(pos, sides, extent, AXES, strict=False)], F.lit(1.0).alias("w0"))
    step, ways = n, []
    for p, s in zip(pos, sides, strict=True):
        step //= s
        ways += [F.when(p > 0, F.col("v") - step), F.when(p < s - 1, F.col("v") + step)]
    edges = ids.select(F.col("v").alias("src"), F.explode(F.filter(F.array(*ways), lambda x: x.isNotNull())).alias("dst")).withColumn("w", F.lit(1.0))
    return vertices, edges


def random_grid(spark: SparkSession, sides: Sequence[int], extent: Sequence[float] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Grid points with random near edges: an interior vertex draws 3 to 11 distinct partners, one on a face 3, from the
    box of radius r = 1 + 2 % of the shortest side within squared index distance 3 r^2; edges are symmetrised."""
    vertices, _ = grid(spark, sides, extent)
    r = 1 + int(0.02 * min(sides))
    offsets = [(i, j, k) for i in range(-r, r + 1) for j in range(-r, r + 1) for k in (range(-r, r + 1) if len(sides) == 3 else (0,)) if 0 < i * i + j * j + k * k <= 3 * r * r]
    pos = grid_position(F.col("v"), sides)
    inner = F.lit(True)
    for p, s in zip(pos, sides, strict=True):
        inner = inner & (p > 0) & (p < s - 1)
    degree = F.when(inner, 3 + F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(9))).otherwise(F.lit(3))
    o = F.explode(F.array(*[F.array(*[F.lit(x) for x in t[: len(sides)]]) for t in offsets]))
    cand = vertices.select("v", degree.alias("degree"), F.array(*pos).alias("p")).withColumn("o", o)
    to, ok = F.lit(0).cast("long"), F.lit(True)
    for d, s in enumerate(sides):
        q = F.col("p")[d] + F.col("o")[d]
        ok = ok & (q >= 0) & (q < s)
        to = to * s + q
    from pyspark.sql import Window

    draw = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("v", "dst", F.lit(seed + 1)), "dst"))
    e = cand.filter(ok).select("v", "degree", to.alias("dst")).withColumn("r", draw).filter("r <= degree").select(F.col("v").alias("src"), "dst")
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("w", F.lit(1.0))
    return vertices, e


def random_points(spark: SparkSession, n: int, dims: int, most: float = 1.0, seed: int = 0) -> DataFrame:
    """Uniform points in [0, most]^dims; a point depends on the seed and its id alone."""
    draw = lambda i: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1 << 40)) / float(1 << 40) * most
    return spark.range(n).select(F.col("id").alias("v"), *[draw(i).alias(AXES[i] if dims <= 3 else f"x{i}") for i in range(dims)])


def quad_mesh(spark: SparkSession, areas: int, points_per_area: int, dims: int, most: float = 1.0, capacity: int = 4, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Points in normal clusters around random areas and twice as many uniform ones as an area has, in a quadtree whose
    leaves are the vertices and share edges with their face neighbours."""
    from gridloom.operators.spatial import leaf_graph, quadtree

    axes = AXES[:dims]
    centres = random_points(spark, areas, dims, most, seed).withColumnRenamed("v", "area")
    u = lambda c, i: (F.pmod(F.xxhash64(c, F.lit(seed + 7), F.lit(i)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    normal = lambda i: F.sqrt(-2 * F.log(u("id", 2 * i))) * F.cos(2 * math.pi * u("id", 2 * i + 1))
    around = spark.range(areas * points_per_area).withColumn("area", F.floor(F.col("id") / points_per_area)).join(F.broadcast(centres), "area")
    near = around.select(F.col("id").alias("v"), *[F.least(F.lit(most), F.greatest(F.lit(0.0), F.col(a) + normal(i) * (most / 20))).alias(a) for i, a in enumerate(axes)])
    wide = random_points(spark, 2 * points_per_area, dims, most, seed + 1).withColumn("v", F.col("v") + areas * points_per_area)
    _, leaves = quadtree(near.unionByName(wide), axes, capacity, ([0.0] * dims, [most] * dims))
    v, e = leaf_graph(leaves, dims)
    return v.select("v", *[F.col("centre")[i].alias(a) for i, a in enumerate(axes)], F.lit(1.0).alias("w0")), e


def block_constraint_weights(vertices: DataFrame, partition: DataFrame, weights: int, kind: str = "random", seed: int = 0) -> DataFrame:
    """(v, w0...): one random weight of 1..18 for each block and weight (``random``), or such weights that are zeroed for
    0, 25, 45, 65, 85 % of the blocks (``phase``)."""
    zero = (0.0, 0.25, 0.45, 0.65, 0.85)
    draw = lambda i: (1 + F.pmod(F.xxhash64("blk", F.lit(seed), F.lit(i)), F.lit(18))).cast("double")
    off = lambda i: F.pmod(F.xxhash64("blk", F.lit(seed + 1), F.lit(i)), F.lit(1000)) / 1000.0 < zero[i % len(zero)]
    return vertices.select("v").join(partition, "v").select("v", *[(F.when(off(i), F.lit(0.0)).otherwise(draw(i)) if kind == "phase" else draw(i)).alias(f"w{i}") for i in range(weights)])


def random_tree_rows(levels: Sequence[int], weights: int = 2, seed: int = 0) -> list[tuple[tuple[int, ...], list[float]]]:
    """Rows (label, weights) of a random processor tree."""
    import itertools
    import random

    rnd = random.Random(seed)
    return [(label, [float(rnd.randint(1, 64)) for _ in range(weights)]) for label in itertools.product(*[range(m) for m in levels])]
