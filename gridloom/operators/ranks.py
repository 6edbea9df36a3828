"""Global ranks and prefix sums without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import settle

#: Rows that one sorted bucket should hold at most, if the keys allow it.
BUCKET_ROWS = 500_000


def _bucketed(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Adds __b: the range bucket of the key. Bounds are approximate quantiles, the same for every task; a key value that
    alone exceeds a bucket stays whole, as its rows are ordered by the later keys. Rows of several buckets are settled, as
    conditions on __b would otherwise be moved below the key's own columns: where those are nested, like the curve's
    levels, the condition grows by a factor with each level until the driver's memory is full."""
    n = df.count()
    parts = min(4096, max(1, -(-n // rows)))
    if parts == 1:
        return df.withColumn("__b", F.lit(0))
    df = settle(df)
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)).first()[0]
    cuts = sorted(set(cuts))
    return df.withColumn("__b", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(key))))


def with_rank(df: DataFrame, keys: Sequence[str], out: str = "rank", rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds the 0-based rank by the keys, which must be a total order: bucket counts, their offsets, ranks in buckets."""
    b = _bucketed(df, keys[0], rows)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy("__b").count().select("__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__o"))
    own = F.row_number().over(Window.partitionBy("__b").orderBy(*keys)) - 1
    return b.withColumn("__r", own).join(F.broadcast(offsets), "__b").withColumn(out, (F.col("__r") + F.col("__o")).cast("long")).drop("__b", "__r", "__o")


def with_prefix_sum(df: DataFrame, value: str, keys: Sequence[str], out: str = "prefix", rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds the inclusive prefix sum of value in the order of the keys, in two passes over range buckets."""
    b = _bucketed(df, keys[0], rows)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy("__b").agg(F.sum(value).alias("__s")).select("__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    upto = Window.partitionBy("__b").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("__r", F.sum(value).over(upto)).join(F.broadcast(offsets), "__b").withColumn(out, F.col("__r") + F.col("__o")).drop("__b", "__r", "__o")


def dyadic_order(index: Column, bits: int) -> Column:
    """Sort key of the dyadic (van der Corput) order: the index's bits reversed, so every prefix spreads evenly."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out + F.call_function("shiftright", index.cast("long"), F.lit(i)).bitwiseAND(F.lit(1)) * F.lit(1 << (bits - 1 - i))
    return out
