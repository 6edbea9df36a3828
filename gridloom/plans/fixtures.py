"""Points, graphs and partitions that the catalogue's queries build from the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_points(spark: SparkSession, d: str) -> DataFrame:
    """(v, x, y, w0): parts by size and price, weighted by size."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("v"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("w0"))


def order_points(spark: SparkSession, d: str) -> DataFrame:
    """(v, x, y, w0): orders by price and day."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("v"), F.col("o_totalprice").alias("x"), F.datediff("o_orderdate", F.lit("1995-01-01")).cast("double").alias("y"), F.lit(1.0).alias("w0"))


def order_points_3d(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("v"), F.col("o_totalprice").alias("x"), F.datediff("o_orderdate", F.lit("1995-01-01")).cast("double").alias("y"), (F.col("o_custkey") % 101).cast("double").alias("z"))


def supply_graph(spark: SparkSession, d: str) -> DataFrame:
    """edges between parts 2p and suppliers 2s + 1, weighted by their number of line items; both directions."""
    e = table(spark, d, "lineitem").groupBy((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).agg(F.count("*").cast("double").alias("w"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def supply_partition(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    """(v, blk): vertices of the supply graph by id modulo k."""
    return supply_graph(spark, d).select(F.col("src").alias("v")).distinct().select("v", (F.col("v") % k).cast("int").alias("blk"))


def supply_points(spark: SparkSession, d: str) -> DataFrame:
    """(v, x, y, w0): vertices of the supply graph by the mean quantity and day of their line items."""
    rows = table(spark, d, "lineitem").select(F.explode(F.array(F.col("l_partkey") * 2, F.col("l_suppkey") * 2 + 1)).alias("v"), F.col("l_quantity").cast("double").alias("x"), F.datediff("l_shipdate", F.lit("1995-01-01")).cast("double").alias("y"))
    return rows.filter("v is not null").groupBy("v").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.lit(1.0).alias("w0"))


def supply_blocks(spark: SparkSession, d: str, k: int = 4) -> DataFrame:
    """(v, blk): parts and suppliers of one key modulo k together, so that blocks have inner edges."""
    return supply_points(spark, d).select("v", (F.floor(F.col("v") / 2) % k).cast("int").alias("blk"))


def embedding_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").cast("array<double>").alias("x"))
