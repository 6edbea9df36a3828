"""Readers of graph, coordinate, partition, block-size and topology files. All data come through Spark's readers, so any
store that Spark reads will do; only headers and tables with a row for each block or processor reach the driver."""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.graph import symmetrised
from gridloom.session import settle

AXES = ("x", "y", "z")
#: Rows that a table of blocks or processors may have, as the driver holds it.
LINES_MOST = 1_000_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): text lines with dense 0-based numbers over all files in name order. Rows are counted in their file
    block and shifted by the counts of the blocks before, so no task sees more than a block."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    raw = settle(raw)
    own = F.row_number().over(Window.partitionBy("f", "b").orderBy("m")) - 1
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    shift = raw.groupBy("f", "b").count().select("f", "b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("s"))
    return raw.withColumn("r", own).join(F.broadcast(shift), ["f", "b"]).select((F.col("r") + F.col("s")).alias("line"), "value")


def _from(df: DataFrame, start: int) -> DataFrame:
    return df.filter(F.col("line") >= start).withColumn("line", F.col("line") - start)


def _head(all_lines: DataFrame, comment: str = "%") -> tuple[int, str]:
    """Number and text of the first line that is neither blank nor a comment."""
    row = all_lines.filter((F.trim("value") != "") & ~F.trim("value").rlike(f"^[{comment}]")).orderBy("line").first()
    if row is None:
        raise ValueError("the file has no header")
    return row["line"], row["value"]


def _numbers(kind: str = "double") -> Column:
    return F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast(kind))


def _axes(d: int) -> list[str]:
    return list(AXES[:d]) if d <= 3 else [f"x{i}" for i in range(d)]


def _checked(df: DataFrame, bad: Column, message: str) -> DataFrame:
    if not df.filter(bad).limit(1).isEmpty():
        raise ValueError(message)
    return df


def read_metis(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (v, w0...) and edges of a METIS file; raises on a bad neighbour, a wrong number of lines or of edges."""
    everything = settle(lines(spark, path))
    at, head = _head(everything)
    h = [int(x) for x in head.split()]
    n, m, fmt = h[0], h[1], h[2] if len(h) > 2 else 0
    weighted, n_w = fmt % 10 == 1, (h[3] if len(h) > 3 else 1) if fmt // 10 % 10 == 1 else 0
    body = _from(everything, at + 1)
    extra = body.filter((F.col("line") >= n) & (F.trim("value") != ""))
    if not extra.limit(1).isEmpty():
        raise ValueError("more lines than vertices")
    rows = body.filter(F.col("line") < n).select(F.col("line").alias("v"), F.filter(_numbers("double"), lambda x: x.isNotNull()).alias("a"))
    if rows.count() != n:
        raise ValueError("fewer lines than vertices")
    vertices = rows.select("v", *([F.col("a")[i].alias(f"w{i}") for i in range(n_w)] or [F.lit(1.0).alias("w0")]))
    rest = F.slice("a", n_w + 1, 1 << 30)
    e = rows.select(F.col("v").alias("src"), F.posexplode(rest).alias("p", "x"))
    if weighted:
        e = rows.select(F.col("v").alias("src"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(1) * F.floor(F.size(rest) / 2).cast("int") - 1), lambda i: F.struct(F.get(rest, i * 2).alias("d"), F.get(rest, i * 2 + 1).alias("w")))).alias("s")).filter("s.d is not null")
        edges = e.select("src", (F.col("s.d") - 1).cast("long").alias("dst"), F.col("s.w").alias("w"))
    else:
        edges = e.select("src", (F.col("x") - 1).cast("long").alias("dst"), F.lit(1.0).alias("w"))
    edges = settle(edges)
    _checked(edges, (F.col("dst") < 0) | (F.col("dst") >= n), "a neighbour id is out of range")
    if edges.count() != 2 * m:
        raise ValueError("the number of edges isn't that of the header")
    return vertices, edges


def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a coordinate file; a symmetric one has its reverse added, values become weights."""
    everything = settle(lines(spark, path))
    banner = everything.filter("line = 0").first()["value"].lower()
    at, head = _head(everything)
    rows, cols, _ = (int(x) for x in head.split()[:3])
    if rows != cols:
        raise ValueError("the matrix isn't square")
    a = _from(everything, at + 1).filter(F.trim("value") != "").select(_numbers().alias("a"))
    e = a.select((F.col("a")[0] - 1).cast("long").alias("src"), (F.col("a")[1] - 1).cast("long").alias("dst"), (F.lit(1.0) if "pattern" in banner else F.coalesce(F.get("a", F.lit(2)), F.lit(1.0))).alias("w"))
    if "symmetric" in banner:
        e = e.unionByName(e.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return spark.range(rows).select(F.col("id").alias("v"), F.lit(1.0).alias("w0")), e


def read_edge_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header ``n m``, then a pair for each edge; the base (0 or 1) is found from the ids before they are checked."""
    everything = settle(lines(spark, path))
    at, head = _head(everything, "%#")
    n, m = (int(x) for x in head.split()[:2])
    a = _from(everything, at + 1).filter(F.trim("value") != "").select(_numbers("long").alias("a"))
    pairs = settle(a.select(F.col("a")[0].alias("u"), F.col("a")[1].alias("v")))
    if pairs.count() != m:
        raise ValueError("the number of edges isn't that of the header")
    edges = symmetrised(pairs)
    _checked(edges, (F.col("dst") < 0) | (F.col("dst") >= n), "a vertex id is out of range")
    return spark.range(n).select(F.col("id").alias("v"), F.lit(1.0).alias("w0")), edges


def read_edge_list_parts(spark: SparkSession, prefix: str, reverse: bool = True, drop_loops: bool = True) -> tuple[DataFrame, DataFrame]:
    """All files prefix*: pairs without a header, # and % comments."""
    a = spark.read.text(f"{prefix}*").filter((F.trim("value") != "") & ~F.col("value").rlike(r"^\s*[#%]")).select(_numbers("long").alias("a"))
    e = settle(symmetrised(a.select(F.col("a")[0].alias("u"), F.col("a")[1].alias("v")), reverse, drop_loops))
    v = e.select(F.explode(F.array("src", "dst")).alias("v")).distinct().withColumn("w0", F.lit(1.0))
    return v, e


def _records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(i, data): the fixed-size binary records of a file, numbered; the splits are Hadoop's."""
    return spark.sparkContext.binaryRecords(path, size).zipWithIndex().map(lambda t: (t[1], bytearray(t[0]))).toDF("i long, data binary")


def _unsigned(c: Column, at: int) -> Column:
    """Little-endian 8-byte integer at a byte offset of a binary column."""
    return F.conv(F.concat(*[F.hex(F.substring(c, at + 8 - i, 1)) for i in range(8)]), 16, 10).cast("long")


def read_graph_binary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header [version, n, m], n + 1 byte offsets, 0-based targets, 8 bytes each; unweighted."""
    w = settle(_records(spark, path, 8).select("i", _unsigned(F.col("data"), 0).alias("x")))
    _, n, m = (r["x"] for r in w.filter("i < 3").orderBy("i").collect())
    base = (3 + n + 1) * 8
    off = w.filter((F.col("i") >= 3) & (F.col("i") < 3 + n + 1)).select((F.col("i") - 3).alias("v"), ((F.col("x") - base) / 8).cast("long").alias("o"))
    ends = off.select((F.col("v") - 1).alias("v"), F.col("o").alias("e"))
    spans = off.join(ends, "v").filter("e > o").select(F.col("v").alias("src"), F.explode(F.sequence("o", F.col("e") - 1)).alias("p"))
    to = w.filter(F.col("i") >= 3 + n + 1).select((F.col("i") - (3 + n + 1)).alias("p"), F.col("x").alias("dst"))
    edges = settle(spans.join(to, "p").select("src", "dst", F.lit(1.0).alias("w")))
    _checked(edges, (F.col("dst") < 0) | (F.col("dst") >= n), "a neighbour id is out of range")
    if edges.count() != 2 * m:
        raise ValueError("the number of edges isn't that of the header")
    return spark.range(n).select(F.col("id").alias("v"), F.lit(1.0).alias("w0")), edges


def read_edge_list_binary(spark: SparkSession, path: str, header: int = 2) -> tuple[DataFrame, DataFrame]:
    """8-byte integers: a header of ``header`` numbers whose last two are n and m, then pairs."""
    w = settle(_records(spark, path, 8).select("i", _unsigned(F.col("data"), 0).alias("x")))
    n, _ = (r["x"] for r in w.filter(F.col("i").between(header - 2, header - 1)).orderBy("i").collect())
    p = w.filter(F.col("i") >= header).select(F.floor((F.col("i") - header) / 2).alias("e"), ((F.col("i") - header) % 2).alias("s"), "x")
    pairs = settle(p.groupBy("e").agg(F.max(F.when(F.col("s") == 0, F.col("x"))).alias("u"), F.max(F.when(F.col("s") == 1, F.col("x"))).alias("v")).drop("e"))
    return spark.range(n).select(F.col("id").alias("v"), F.lit(1.0).alias("w0")), symmetrised(pairs)


def read_coordinates(spark: SparkSession, path: str, dims: int, n: int | None = None, weight: bool = False) -> DataFrame:
    """(v, x, y[, z][, w0]): a point on each line after % comments; with ``weight`` the column after the coordinates."""
    rows = settle(lines(spark, path).filter((F.trim("value") != "") & ~F.col("value").rlike(r"^\s*%")))
    first = rows.agg(F.min("line")).first()[0] or 0
    out = _from(rows, first).select(F.col("line").alias("v"), _numbers().alias("a"))
    if n is not None and out.count() != n:
        raise ValueError("the number of points isn't that of the vertices")
    _checked(out, F.size("a") < dims + weight, "a line has too few numbers")
    return out.select("v", *[F.col("a")[i].alias(x) for i, x in enumerate(_axes(dims))], *([F.col("a")[dims].alias("w0")] if weight else []))


def read_adcirc(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """First line n; then an index and the coordinates on each line."""
    everything = settle(lines(spark, path).filter(F.trim("value") != ""))
    at, head = _head(everything)
    rows = _from(everything, at + 1).select(F.col("line").alias("v"), _numbers().alias("a"))
    if rows.count() != int(head.split()[0]):
        raise ValueError("the number of points isn't that of the header")
    return rows.select("v", *[F.col("a")[i + 1].alias(x) for i, x in enumerate(_axes(dims))])


def read_teec(spark: SparkSession, path: str, dims: int) -> DataFrame:
    return read_coordinates(spark, path, dims, weight=True)


def read_coordinates_binary(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """Always three doubles a point, also in 2-D."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = np.frombuffer(b"".join(v.as_py() for v in b.column(1)), dtype="<f8").reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, i]) for i in range(dims)]], names=["v", *_axes(dims)])

    return _records(spark, path, 24).mapInArrow(run, "v long, " + ", ".join(f"{a} double" for a in _axes(dims)))


def matrix_market_shape(spark: SparkSession, path: str) -> tuple[int, int]:
    _, head = _head(lines(spark, path))
    a, b = head.split()[:2]
    return int(a), int(b)


def read_coordinates_matrix_market(spark: SparkSession, path: str, point_major: bool = False) -> DataFrame:
    """Header ``n dims``, then a number a line: by column, as the format has it, or by point."""
    everything = settle(lines(spark, path))
    at, head = _head(everything)
    n, d = (int(x) for x in head.split()[:2])
    s = _from(everything.filter(F.trim("value") != ""), at + 1).select("line", F.trim("value").cast("double").alias("x"))
    v, i = (F.floor(F.col("line") / d), F.col("line") % d) if point_major else (F.col("line") % n, F.floor(F.col("line") / n))
    return s.select(v.cast("long").alias("v"), i.alias("i"), "x").groupBy("v").agg(*[F.max(F.when(F.col("i") == j, F.col("x"))).alias(a) for j, a in enumerate(_axes(d))])


def _rings(cells: DataFrame, all_pairs: bool) -> DataFrame:
    """Edges of cells(c array<long>): every pair of a cell, or its closed ring."""
    if all_pairs:
        p = cells.select(F.explode("c").alias("src"), "c").select("src", F.explode("c").alias("dst"))
    else:
        p = cells.select(F.explode(F.zip_with("c", F.concat(F.slice("c", 2, 1 << 20), F.slice("c", 1, 1)), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).alias("s")).select("s.src", "s.dst")
    p = p.filter("src <> dst")
    return p.unionByName(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("w", F.lit(1.0))


def read_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """OFF: N 3-D points, then faces; the vertices of a face are pairwise joined."""
    everything = settle(lines(spark, path).filter((F.trim("value") != "") & ~F.col("value").rlike("^#")))
    rows = everything.orderBy("line").limit(2).collect()
    n, f = (int(x) for x in rows[1]["value"].split()[:2])
    body = _from(everything, rows[1]["line"] + 1).withColumn("a", _numbers())
    vertices = body.filter(F.col("line") < n).select(F.col("line").alias("v"), *[F.col("a")[i].alias(x) for i, x in enumerate(AXES)], F.lit(1.0).alias("w0"))
    faces = body.filter((F.col("line") >= n) & (F.col("line") < n + f)).select(F.slice(F.col("a").cast("array<long>"), 2, 1 << 20).alias("c"))
    return vertices, _rings(faces, True)


def read_alya(spark: SparkSession, path: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """ELEMENTS .. END_ELEMENTS: index and 1-based vertices, a ring each; COORDINATES .. END_COORDINATES: index and point."""
    everything = settle(lines(spark, path))
    at = {r["value"].strip().upper().split()[0]: r["line"] for r in everything.filter(F.upper(F.trim("value")).rlike("^(END_)?(ELEMENTS|COORDINATES)")).collect()}
    part = lambda a: everything.filter((F.col("line") > at[a]) & (F.col("line") < at[f"END_{a}"]) & (F.trim("value") != "")).withColumn("a", _numbers())
    vertices = part("COORDINATES").select((F.col("a")[0] - 1).cast("long").alias("v"), *[F.col("a")[i + 1].alias(x) for i, x in enumerate(_axes(dims))], F.lit(1.0).alias("w0"))
    cells = part("ELEMENTS").select(F.transform(F.slice("a", 2, 1 << 20), lambda x: x.cast("long") - 1).alias("c"))
    return vertices, _rings(cells, False)


def cell_bounds(centre: Sequence[Column], level: Column) -> tuple[list[Column], list[Column]]:
    """Box of a cell: centre +/- half of 2^level."""
    half = F.pow(F.lit(2.0), level.cast("double")) / 2
    return [c - half for c in centre], [c + half for c in centre]


def read_quadtree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """3-D tree records of 25 numbers: centre, level, parent's centre, six neighbours' centres (-1: none), up to a line
    ``timestep``. Leaves (cells that are no cell's parent) are the vertices; edges join leaves that name each other or a
    leaf's neighbour. A leaf without an edge raises."""
    everything = settle(lines(spark, path))
    stop = everything.filter(F.col("value").startswith("timestep")).agg(F.min("line")).first()[0]
    rows = (everything if stop is None else everything.filter(F.col("line") < stop)).filter((F.trim("value") != "") & ~F.col("value").rlike("^[%#]"))
    rows = settle(rows.select(_numbers().alias("a")))
    _checked(rows, F.size("a") != 25, "a record hasn't 25 numbers")
    name = lambda c, i: F.concat_ws(",", *[F.format_string("%.9g", F.get(c, F.lit(i + j))) for j in range(3)])
    own = rows.select(name("a", 0).alias("id"), F.get("a", F.lit(3)).alias("level"), F.slice("a", 1, 3).alias("p"), F.when(F.get("a", F.lit(4)) != -1, name("a", 4)).alias("parent"), F.array(*[F.when(F.get("a", F.lit(7 + 3 * i)) != -1, name("a", 7 + 3 * i)) for i in range(6)]).alias("near"))
    own = own.dropDuplicates(["id"])
    leaves = settle(own.join(own.select(F.col("parent").alias("id")).filter("id is not null").distinct(), "id", "left_anti"))
    from gridloom.operators.ranks import with_rank

    v = settle(with_rank(leaves, ["id"], "v"))
    e = v.select(F.col("v").alias("src"), F.explode("near").alias("id")).filter("id is not null").join(v.select("id", F.col("v").alias("dst")), "id").select("src", "dst").filter("src <> dst")
    e = settle(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("w", F.lit(1.0)))
    if not v.join(e.select(F.col("src").alias("v")), "v", "left_anti").limit(1).isEmpty():
        raise ValueError("a leaf has no neighbour")
    return v.select("v", *[F.col("p")[i].alias(x) for i, x in enumerate(AXES)], F.lit(1.0).alias("w0")), e


def read_partition(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(v, blk): a block id a line after % comments."""
    rows = settle(lines(spark, path).filter((F.trim("value") != "") & ~F.col("value").rlike(r"^\s*%")))
    out = _from(rows, rows.agg(F.min("line")).first()[0] or 0).select(F.col("line").alias("v"), F.trim("value").cast("int").alias("blk"))
    if n is not None and out.count() != n:
        raise ValueError("the number of lines isn't that of the vertices")
    return out


def _small(spark: SparkSession, path: str, comment: str = "%#") -> list[str]:
    """Lines of a table with a row for each block or processor; more than LINES_MOST raise."""
    rows = lines(spark, path).filter((F.trim("value") != "") & ~F.col("value").rlike(rf"^\s*[{comment}]")).orderBy("line").limit(LINES_MOST + 1).collect()
    if len(rows) > LINES_MOST:
        raise ValueError(f"more than {LINES_MOST} blocks or processors")
    return [r["value"].strip() for r in rows]


def read_block_sizes(spark: SparkSession, path: str) -> list[list[float]]:
    """[weight][block]: header ``k w``, then w numbers a line."""
    head, *rows = _small(spark, path)
    k, w = int(head.split()[0]), int(head.split()[1]) if len(head.split()) > 1 else 1
    values = [[float(x) for x in r.split()] for r in rows]
    if len(values) != k or any(len(r) != w for r in values):
        raise ValueError("the numbers of rows or weights aren't those of the header")
    return [list(c) for c in zip(*values, strict=True)]


def read_pe_tree(spark: SparkSession, path: str) -> tuple[list[tuple[tuple[int, ...], list[float]]], list[bool]]:
    """Rows (label, weights) and which weights are proportional: header ``p w`` and w bits, then ``label # weights``."""
    # A comment starts with % or #; the # inside a row parts label and weights.
    head, *rows = _small(spark, path)
    h = head.split()
    p, w = int(h[0]), int(h[1])
    proportional = [x == "1" for x in h[2 : 2 + w]]
    out = []
    for r in rows:
        label, weights = r.split("#")
        out.append((tuple(int(x) for x in label.replace(",", " ").split()), [float(x) for x in weights.split()]))
    if len(out) != p or any(len(x) != w for _, x in out):
        raise ValueError("the numbers of rows or weights aren't those of the header")
    return out, proportional


def read_flat_topology(spark: SparkSession, path: str) -> dict[str, tuple[float, float, float]]:
    """host -> (cpu, memory, cores)."""
    return {p[0]: (float(p[1]), float(p[2]), float(p[3])) for p in (r.split() for r in _small(spark, path))}


def block_sizes_from_topology(spark: SparkSession, path: str, hosts: Sequence[str]) -> list[list[float]]:
    """[weight][block] for blocks on the named hosts: cpu as a share of all, and memory."""
    known = read_flat_topology(spark, path)
    missing = [h for h in hosts if h not in known]
    if missing:
        raise ValueError(f"unknown host {missing[0]}")
    cpu = [known[h][0] for h in hosts]
    return [[c / sum(cpu) for c in cpu], [known[h][1] for h in hosts]]


def from_csr(spark: SparkSession, starts: Sequence[int], targets: Sequence[int], coordinates: Sequence[float] = (), dims: int = 2, weights: Sequence[float] = (), edge_weights: Sequence[float] = ()) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of compressed-row arrays in memory, coordinates point by point."""
    n = len(starts) - 1
    v = [(i, *([float(coordinates[i * dims + d]) for d in range(dims)] if len(coordinates) else []), float(weights[i]) if len(weights) else 1.0) for i in range(n)]
    names = ["v bigint", *([f"{a} double" for a in _axes(dims)] if len(coordinates) else []), "w0 double"]
    e = [(i, int(targets[j]), float(edge_weights[j]) if len(edge_weights) else 1.0) for i in range(n) for j in range(starts[i], starts[i + 1])]
    return spark.createDataFrame(v, ", ".join(names)), spark.createDataFrame(e, "src bigint, dst bigint, w double")


def to_csr(edges: DataFrame, n: int):
    """(starts, targets, weights) arrays for a program that takes compressed rows; for graphs that fit the driver."""
    import numpy as np

    t = edges.orderBy("src", "dst").select("src", "dst", F.col("w").cast("double").alias("w")).toArrow()
    return np.searchsorted(np.asarray(t.column("src")), np.arange(n + 1)), np.asarray(t.column("dst")), np.asarray(t.column("w"))


def csr_rows(edges: DataFrame, n: int) -> DataFrame:
    """(v, start, targets, weights): the compressed rows of the vertices 0 to n - 1 as a table, for graphs of any size."""
    from gridloom.operators.ranks import with_prefix_sum

    one = F.struct("dst", F.col("w").cast("double").alias("w"))
    rows = edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list(one)).alias("row"))
    rows = edges.sparkSession.range(n).withColumnRenamed("id", "v").join(rows, "v", "left")
    rows = rows.select("v", F.coalesce(F.col("row.dst"), F.array().cast("array<bigint>")).alias("targets"), F.coalesce(F.col("row.w"), F.array().cast("array<double>")).alias("weights"))
    ends = with_prefix_sum(rows.withColumn("degree", F.size("targets").cast("long")), "degree", ["v"], "end")
    return ends.select("v", (F.col("end") - F.col("degree")).alias("start"), "targets", "weights")


def csr_edges(rows: DataFrame) -> DataFrame:
    """The edges of csr_rows()."""
    return rows.select(F.col("v").alias("src"), F.explode(F.arrays_zip("targets", "weights")).alias("e")).select("src", F.col("e.targets").alias("dst"), F.col("e.weights").alias("w"))


def file_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_graph(spark: SparkSession, path: str, kind: str = "auto", dims: int = 2) -> tuple[DataFrame, DataFrame]:
    """Reader by format; ``auto`` takes names ending in bgf or bfg as binary, others as METIS."""
    kind = str(getattr(kind, "value", kind)).lower()
    if kind == "auto":
        kind = "binary" if path.endswith(("bgf", "bfg")) else "metis"
    readers = {"metis": read_metis, "binary": read_graph_binary, "edgelist": read_edge_list, "edgelist_binary": read_edge_list_binary, "edgelist_distributed": read_edge_list_parts, "matrixmarket": read_matrix_market, "off": read_off, "alya": lambda s, p: read_alya(s, p, dims), "quadtree": read_quadtree}
    if kind not in readers:
        raise ValueError(f"{kind} isn't a graph format")
    return readers[kind](spark, path)


def read_points(spark: SparkSession, path: str, dims: int, kind: str = "metis", n: int | None = None) -> DataFrame:
    kind = str(getattr(kind, "value", kind)).lower()
    readers = {"adcirc": read_adcirc, "binary": read_coordinates_binary, "teec": read_teec}
    if kind == "matrixmarket":
        return read_coordinates_matrix_market(spark, path)
    return readers[kind](spark, path, dims) if kind in readers else read_coordinates(spark, path, dims, n)


def read_input(spark: SparkSession, path: str, kind: str = "auto", coordinates: str | None = None, coordinate_kind: str = "metis", dims: int = 2, n_weights: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices with coordinates and weights, and edges; coordinates default to path + ".xyz". Missing weights are 1,
    surplus ones are dropped."""
    v, e = read_graph(spark, path, kind, dims)
    if "x" not in v.columns:
        p = read_points(spark, coordinates or f"{path}.xyz", dims, coordinate_kind).drop("w0")
        v = v.join(p, "v")
    if n_weights is not None:
        have = [c for c in v.columns if c[0] == "w" and c[1:].isdigit()]
        v = v.drop(*have[n_weights:]).withColumns({f"w{i}": F.lit(1.0) for i in range(len(have), n_weights)})
    return v, e


def pack_unsigned(*numbers: int) -> bytes:
    return struct.pack(f"<{len(numbers)}Q", *numbers)
