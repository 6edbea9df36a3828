"""Writers of graphs, coordinates and partitions. Text goes out as a folder of part files in vertex order, which the
readers take back whole; ``single`` streams one file through the Hadoop file system, row by row."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stream(df: DataFrame, path: str, chunks: Iterable[bytes]) -> None:
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    held = bytearray()
    try:
        for c in chunks:
            held += c
            if len(held) > 1 << 20:
                out.write(held)
                held = bytearray()
        if held:
            out.write(held)
    finally:
        out.close()


def _text(df: DataFrame, order: Sequence[str], line: Column, path: str, head: str | None, single: bool, parts: int | None = None) -> None:
    rows = df.select(*order, line.alias("__line"))
    if single:
        own = rows.orderBy(*order).select("__line").toLocalIterator(prefetchPartitions=True)
        _stream(df, path, _with_head(head, own))
        return
    rows = rows.repartitionByRange(parts or max(1, df.sparkSession.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order)
    if head is not None:
        first = df.sparkSession.createDataFrame([(head,)], "__line string")
        rows = rows.select("__line")
        first.coalesce(1).unionByName(rows).write.mode("overwrite").text(path)
    else:
        rows.select("__line").write.mode("overwrite").text(path)


def _with_head(head: str | None, rows) -> Iterable[bytes]:
    if head is not None:
        yield f"{head}\n".encode()
    for r in rows:
        yield f"{r[0]}\n".encode()


def _number(c: Column) -> Column:
    """A number without a needless fraction."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def write_metis(vertices: DataFrame, edges: DataFrame, path: str, edge_weights: bool = False, single: bool = False) -> None:
    """METIS text; format flag 001 with edge weights."""
    item = F.concat_ws(" ", (F.col("dst") + 1).cast("string"), _number(F.col("w"))) if edge_weights else (F.col("dst") + 1).cast("string")
    near = edges.groupBy(F.col("src").alias("v")).agg(F.array_sort(F.collect_list(F.struct("dst", item.alias("s")))).alias("a"))
    rows = vertices.select("v").join(near, "v", "left").select("v", F.coalesce(F.array_join(F.transform("a", lambda x: x["s"]), " "), F.lit("")).alias("s"))
    n, m = vertices.count(), edges.count() // 2
    _text(rows, ["v"], F.col("s"), path, f"{n} {m}" + (" 001" if edge_weights else ""), single)


def write_graph_binary(vertices: DataFrame, edges: DataFrame, path: str, version: int = 3) -> None:
    """Header [version, n, m], byte offsets, targets: two streams in vertex order."""
    n, m = vertices.count(), edges.count() // 2
    degree = vertices.select("v").join(edges.groupBy(F.col("src").alias("v")).count(), "v", "left").orderBy("v")

    def chunks():
        yield struct.pack("<3Q", version, n, m)
        at = (3 + n + 1) * 8
        yield struct.pack("<Q", at)
        for r in degree.toLocalIterator():
            at += 8 * (r["count"] or 0)
            yield struct.pack("<Q", at)
        for r in edges.orderBy("src", "dst").select("dst").toLocalIterator():
            yield struct.pack("<Q", r[0])

    _stream(vertices, path, chunks())


def write_metis_parts(edges: DataFrame, partition: DataFrame, path: str) -> None:
    """One file for each block: the 1-based neighbours of its vertices."""
    near = edges.groupBy(F.col("src").alias("v")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: (x + 1).cast("string")), " ").alias("value"))
    rows = partition.join(near, "v", "left").select("v", "blk", F.coalesce("value", F.lit("")).alias("value"))
    rows.repartition("blk").sortWithinPartitions("blk", "v").select("blk", "value").write.mode("overwrite").partitionBy("blk").text(path)


def write_edge_list_binary(vertices: DataFrame, edges: DataFrame, path: str, version: int = 3) -> None:
    """[version, n, m], then both directions of every edge as pairs."""
    n, m = vertices.count(), edges.count()

    def chunks():
        yield struct.pack("<3Q", version, n, m)
        for r in edges.orderBy("src", "dst").select("src", "dst").toLocalIterator():
            yield struct.pack("<2Q", r[0], r[1])

    _stream(vertices, path, chunks())


def write_edges(edges: DataFrame, path: str) -> None:
    """Parquet, ranged by source: what a later scan prunes by."""
    edges.repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(path)


def write_vtk(points: DataFrame, partition: DataFrame, axes: Sequence[str], path: str) -> None:
    """VTK 2.0 ASCII points with the scalar block id / greatest id."""
    rows = points.join(partition, "v").orderBy("v").select(*axes, "blk")
    n, top = rows.count(), max(1, partition.agg(F.max("blk")).first()[0] or 1)

    def chunks():
        yield f"# vtk DataFile Version 2.0\npartition\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS {n} float\n".encode()
        for r in rows.toLocalIterator():
            yield (" ".join(f"{r[a]:g}" for a in axes) + " 0" * (3 - len(axes)) + "\n").encode()
        yield f"POINT_DATA {n}\nSCALARS block float 1\nLOOKUP_TABLE default\n".encode()
        for r in rows.toLocalIterator():
            yield f"{r['blk'] / top:g}\n".encode()

    _stream(points, path, chunks())


def write_coordinates(points: DataFrame, axes: Sequence[str], path: str, single: bool = False) -> None:
    """Text, 15 significant digits."""
    _text(points, ["v"], F.concat_ws(" ", *[F.format_string("%.15g", F.col(a).cast("double")) for a in axes]), path, None, single)


def write_coordinates_binary(points: DataFrame, axes: Sequence[str], path: str) -> None:
    """Three doubles a point, the missing ones 0."""
    rows = points.orderBy("v").select(*axes)
    _stream(points, path, (struct.pack("<3d", *[float(x) for x in r], *[0.0] * (3 - len(axes))) for r in rows.toLocalIterator()))


def write_coordinates_by_block(points: DataFrame, partition: DataFrame, axes: Sequence[str], path: str) -> None:
    """A folder for each block."""
    if len(axes) not in (2, 3):
        raise ValueError("2 or 3 dimensions")
    value = F.concat_ws(" ", *[F.format_string("%.15g", F.col(a).cast("double")) for a in axes])
    points.join(partition, "v").repartition("blk").sortWithinPartitions("blk", "v").select("blk", value.alias("value")).write.mode("overwrite").partitionBy("blk").text(path)


def write_points_with_weight(points: DataFrame, axes: Sequence[str], path: str, weight: str = "w0", single: bool = False) -> None:
    """Coordinates and the weight on each line."""
    _text(points, ["v"], F.concat_ws(" ", *[F.format_string("%.15g", F.col(a).cast("double")) for a in (*axes, weight)]), path, None, single)


def write_partition(partition: DataFrame, path: str, single: bool = False) -> None:
    """``% n``, then a block id a line in vertex order."""
    _text(partition, ["v"], F.col("blk").cast("string"), path, f"% {partition.count()}", single)


def write_vector(values: DataFrame, column: str, path: str, single: bool = False) -> None:
    """A value a line in vertex order."""
    _text(values, ["v"], F.col(column).cast("string"), path, None, single)
