"""Partitions and orders along the Hilbert curve."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import hilbert
from gridloom.operators.ranks import with_rank


def sorted_indices(points: DataFrame, axes: Sequence[str], depth: int = 9, key: str = "v", box=None) -> DataFrame:
    """points with h (curve index) and rank by (h, key)."""
    return with_rank(hilbert.with_hilbert(points, axes, depth, box), ["h", key])


def sfc_partition(points: DataFrame, axes: Sequence[str], k: int, depth: int = 9, key: str = "v", box=None) -> DataFrame:
    """(key, blk): k contiguous pieces of the curve order whose sizes differ by at most one."""
    n = F.lit(points.count())
    return sorted_indices(points, axes, depth, key, box).select(key, F.floor(F.col("rank") * k / n).cast("int").alias("blk"))


def redistribute(points: DataFrame, axes: Sequence[str], parts: int, depth: int = 9, key: str = "v") -> DataFrame:
    """points in Spark partitions that are ranges of the curve, each sorted: locality for later scans, no new result."""
    return hilbert.with_hilbert(points, axes, depth).repartitionByRange(parts, "h", key).sortWithinPartitions("h", key)


def ranges(points: DataFrame, index: str = "h") -> DataFrame:
    """(part, low, high, ordered): index range of each Spark partition and whether it starts after the one before."""
    own = points.groupBy(F.spark_partition_id().alias("part")).agg(F.min(index).alias("low"), F.max(index).alias("high"))
    return own.withColumn("ordered", F.coalesce(F.lag("high").over(Window.orderBy("part")) <= F.col("low"), F.lit(True)))


def curve_centres(points: DataFrame, axes: Sequence[str], k: int, depth: int = 9, key: str = "v", block: str | None = None, blocks: dict[int, int] | None = None) -> DataFrame:
    """(parent, i, key, axes): centre i of each old block is the point at rank i * (n // k) + (n // k) // 2 in it.

    Without a block column there is one old block and k centres; else blocks says how many centres each old block gets."""
    h = hilbert.with_hilbert(points, axes, depth)
    if block is None:
        r = with_rank(h, ["h", key])
        r = r.withColumn("parent", F.lit(0))
        counts = {0: points.count()}
        wanted = {0: k}
    else:
        r = h.withColumn("rank", F.row_number().over(Window.partitionBy(block).orderBy("h", key)) - 1).withColumn("parent", F.col(block))
        wanted = dict(blocks or {})
        counts = {row[0]: row[1] for row in points.groupBy(block).count().collect()}
    rows = [(b, i, i * (counts.get(b, 0) // m) + (counts.get(b, 0) // m) // 2) for b, m in wanted.items() for i in range(m)]
    want = points.sparkSession.createDataFrame(rows, "parent int, i int, rank long")
    return r.join(F.broadcast(want), ["parent", "rank"]).select("parent", "i", key, *axes)


def centres_from_curve(k: int, dims: int, depth: int, box) -> np.ndarray:
    """Points of the curve at (i + 0.5) / k, in the box: k centres without a look at the data."""
    return hilbert.inverse((np.arange(k) + 0.5) / k, dims, depth, box)


def curve_renumbering(points: DataFrame, partition: DataFrame, axes: Sequence[str], depth: int = 9, key: str = "v") -> DataFrame:
    """(blk, new_blk): blocks numbered by the curve index of their centres of mass."""
    box = hilbert.bounds(points, axes)
    centres = points.join(partition, key).groupBy("blk").agg(*[F.avg(F.col(a).cast("double")).alias(a) for a in axes])
    return hilbert.with_hilbert(centres, axes, depth, box).select("blk", (F.row_number().over(Window.orderBy("h", "blk")) - 1).cast("int").alias("new_blk"))


def renumber(partition: DataFrame, mapping: DataFrame, key: str = "v") -> DataFrame:
    """partition with the block ids of mapping(blk, new_blk)."""
    return partition.join(F.broadcast(mapping), "blk").select(key, F.col("new_blk").cast("int").alias("blk"))
