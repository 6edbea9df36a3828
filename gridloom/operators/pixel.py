"""Pixel grids over points: density, pixel graphs, greedy growth of blocks, spectral order. The grid has at most side^d
cells whatever the number of points, so the sequential parts run on the driver."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import hilbert


def pixel(axes: Sequence[str], box, side: int) -> Column:
    """Row-major pixel of a point on a side^d grid; the upper border belongs to the last pixel."""
    out = F.lit(0).cast("long")
    for a, lo, hi in zip(axes, *box, strict=True):
        out = out * side + F.least(F.floor(hilbert.scaled(F.col(a), lo, hi) * float(side)), F.lit(side - 1)).cast("long")
    return out


def with_pixel(points: DataFrame, axes: Sequence[str], side: int, box=None) -> DataFrame:
    return points.withColumn("pixel", pixel(axes, box or hilbert.bounds(points, axes), side))


def density(points: DataFrame, axes: Sequence[str], side: int, box=None, weight: str | None = None) -> DataFrame:
    """(pixel, weight) of the occupied pixels."""
    w = F.sum(F.col(weight).cast("double")) if weight else F.count("*").cast("double")
    return with_pixel(points, axes, side, box).groupBy("pixel").agg(w.alias("weight"))


def neighbours(pixel_id: int, side: int, dims: int) -> list[int]:
    """Von-Neumann neighbours on the grid, ascending by axis."""
    out, step = [], 1
    for _ in range(dims):
        at = pixel_id // step % side
        if at > 0:
            out.append(pixel_id - step)
        if at < side - 1:
            out.append(pixel_id + step)
        step *= side
    return out


def neighbour_column(p: Column, side: int, dims: int) -> Column:
    """Array of the von-Neumann neighbours of a pixel column."""
    parts = []
    for i in range(dims):
        step = side**i
        at = F.floor(p / F.lit(step)) % side
        parts += [F.when(at > 0, p - step), F.when(at < side - 1, p + step)]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def pixel_graph(points: DataFrame, edges: DataFrame, axes: Sequence[str], side: int, key: str = "v", least: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """Vertices (v = pixel, w0 = points) of the whole grid, and edges (src, dst, w): graph edges that cross each facet, at
    least ``least`` so that the grid stays connected. Edges between pixels that don't share a facet are left out."""
    dims = len(axes)
    p = with_pixel(points, axes, side).select(F.col(key).alias("v"), "pixel")
    grid = points.sparkSession.range(side**dims).select(F.col("id").alias("v"))
    v = grid.join(p.groupBy(F.col("pixel").alias("v")).agg(F.count("*").cast("double").alias("w0")), "v", "left").select("v", F.coalesce("w0", F.lit(0.0)).alias("w0"))
    e = edges.join(p.select(F.col("v").alias("src"), F.col("pixel").alias("ps")), "src").join(p.select(F.col("v").alias("dst"), F.col("pixel").alias("pd")), "dst").filter("ps <> pd")
    crossed = e.groupBy(F.col("ps").alias("src"), F.col("pd").alias("dst")).agg(F.count("*").cast("double").alias("c"))
    facets = grid.select(F.col("v").alias("src"), F.explode(neighbour_column(F.col("v"), side, dims)).alias("dst"))
    return v, facets.join(crossed, ["src", "dst"], "left").select("src", "dst", F.coalesce("c", F.lit(least)).alias("w"))


def pixel_partition(points: DataFrame, axes: Sequence[str], k: int, side: int = 10, weight: str | None = None, slack: float = 0.02, key: str = "v", box=None) -> DataFrame:
    """(v, blk): blocks grow from the densest free pixel over the free border pixel of best score, its density by its
    distance to the block's start, up to (1 + slack) * n / k; what is left joins the last block."""
    dims = len(axes)
    box = box or hilbert.bounds(points, axes)
    w = np.zeros(side**dims)
    for r in density(points, axes, side, box, weight).collect():
        w[r["pixel"]] = r["weight"]
    place = np.stack(np.unravel_index(np.arange(side**dims), (side,) * dims), axis=1)
    most, blk = (1 + slack) * w.sum() / k, np.full(side**dims, k - 1)
    free = np.ones(side**dims, dtype=bool)
    for b in range(k - 1):
        if not free.any():
            break
        seed = int(np.argmax(np.where(free, w, -1)))
        held, queue, seen = 0.0, [(0.0, seed)], {seed}
        while queue:
            _, p = heapq.heappop(queue)
            if held + w[p] > most and held:
                continue
            free[p], blk[p] = False, b
            held += w[p]
            if held >= w.sum() / k:
                break
            for q in neighbours(p, side, dims):
                if free[q] and q not in seen:
                    seen.add(q)
                    heapq.heappush(queue, (-(w[q] + 1) / (1 + float(((place[q] - place[seed]) ** 2).sum())), q))
    m = points.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(blk)], "pixel long, blk int")
    return with_pixel(points, axes, side, box).join(F.broadcast(m), "pixel").select(F.col(key).alias("v"), "blk")


def fiedler(n: int, edges: Sequence[tuple[int, int, float]]) -> np.ndarray:
    """Second eigenvector of the Laplacian of a small connected graph, its first non-zero entry positive."""
    a = np.zeros((n, n))
    for s, d, w in edges:
        a[s, d] = w
    values, vectors = np.linalg.eigh(np.diag(a.sum(axis=1)) - a)
    x = vectors[:, np.argsort(values, kind="stable")[1]]
    lead = x[np.argmax(np.abs(x) > 1e-12)]
    return x if lead >= 0 else -x


def spectral_partition(points: DataFrame, edges: DataFrame, axes: Sequence[str], k: int, side: int = 10, key: str = "v") -> DataFrame:
    """(v, blk): the pixels in the order of the pixel graph's Fiedler vector, filled into blocks of n / k points."""
    v, e = pixel_graph(points, edges, axes, side, key)
    w = np.zeros(side ** len(axes))
    for r in v.collect():
        w[r["v"]] = r["w0"]
    order = np.argsort(fiedler(len(w), [tuple(r) for r in e.collect()]), kind="stable")
    mid = np.cumsum(w[order]) - w[order] / 2
    blk = np.minimum((mid * k / max(w.sum(), 1)).astype(int), k - 1)
    m = points.sparkSession.createDataFrame([(int(p), int(b)) for p, b in zip(order, blk, strict=True)], "pixel long, blk int")
    return with_pixel(points, axes, side).join(F.broadcast(m), "pixel").select(F.col(key).alias("v"), "blk")
