"""Points that arrive as a stream: they take the nearest block of fixed clusters, and watermarked windows watch the
blocks' loads, so that a repartition can be asked for when they drift."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.kmeans import Clusters


def nearest_block(axes: Sequence[str], clusters: Clusters) -> Column:
    """Block of least squared distance times influence, as a built-in expression that streams and batches share."""
    best = None
    for i, p in enumerate(clusters.centres):
        d = sum(((F.col(a) - float(x)) * (F.col(a) - float(x)) for a, x in zip(axes, p, strict=True)), F.lit(0.0)) * float(clusters.influence[0, i])
        s = F.struct(d.alias("d"), F.lit(i).alias("blk"))
        best = s if best is None else F.least(best, s)
    return best["blk"]


def assign_stream(points: DataFrame, axes: Sequence[str], clusters: Clusters) -> DataFrame:
    return points.withColumn("blk", nearest_block(axes, clusters))


def windowed_loads(assigned: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes", weight: str | None = None) -> DataFrame:
    """(start, blk, load) in event-time windows; rows later than the watermark don't count."""
    w = F.sum(F.col(weight).cast("double")) if weight else F.count("*").cast("double")
    return assigned.withWatermark(time, late).groupBy(F.window(time, width), "blk").agg(w.alias("load")).select(F.col("window.start").alias("start"), "blk", "load")


def watch(assigned: DataFrame, k: int, epsilon: float, alarm: Callable[[int, float], None], checkpoint: str, weight: str | None = None):
    """Start a query that calls alarm(batch, imbalance) for each micro-batch whose own load is out of balance."""

    def each(batch: DataFrame, number: int) -> None:
        w = F.sum(F.col(weight).cast("double")) if weight else F.count("*").cast("double")
        r = batch.groupBy("blk").agg(w.alias("w")).agg(F.max("w"), F.sum("w")).first()
        if r[1] and r[0] / (r[1] / k) - 1 > epsilon:
            alarm(number, r[0] / (r[1] / k) - 1)

    return assigned.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
