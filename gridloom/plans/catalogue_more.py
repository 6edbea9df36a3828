"""Further queries of the catalogue: files written and read back, processor trees, solvers, indices, and exact properties of
partitions that SQL can't compute itself."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import hilbert, scalars
from gridloom.operators import diffusion, graph, kmeans, metrics, multilevel, multisection, pixel, sfc, spatial, topology
from gridloom.plans import run as plan
from gridloom.plans.fixtures import order_points, part_points, supply_blocks, supply_graph, supply_partition, supply_points, table
from gridloom.session import gone_at_exit, settle, shared_folder
from gridloom.settings import Settings
from gridloom.sources import files, sinks

AXES = ["x", "y"]
K = 8
_folders: dict[str, str] = {}


def _path(s: SparkSession, tail: str = "") -> str:
    """A new name in a folder of the session, which goes with it."""
    app = s.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_folder(s)}/gridloom-files-{uuid.uuid4().hex}"
        p = s._jvm.org.apache.hadoop.fs.Path(_folders[app])
        p.getFileSystem(s._jsc.hadoopConfiguration()).mkdirs(p)
        gone_at_exit(s, _folders[app])
    return f"{_folders[app]}/{uuid.uuid4().hex}{tail}"


def _written(df: DataFrame, order: str, line: Column, head: str | None = None) -> str:
    path = _path(df.sparkSession)
    sinks._text(df, [order], line, path, head, False)
    return path


def _dense(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts and, numbered after them, suppliers, all with a line item; edges weighted by their number of line items."""
    n, m = table(s, d, "part").count(), table(s, d, "supplier").count()
    e = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + n).alias("dst")).agg(F.count("*").cast("double").alias("w"))
    v = s.range(n + m).select(F.col("id").alias("v"), F.lit(1.0).alias("w0"))
    return v, settle(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))


def _metis(s, d):
    v, e = _dense(s, d)
    sinks.write_metis(v, e, path := _path(s), edge_weights=True)
    return files.read_graph(s, path)[1]


def _input(s, d):
    v, e = _dense(s, d)
    path = _path(s)
    sinks.write_metis(v, e, path)
    sinks.write_coordinates(v.select("v", (F.col("v") % 97).alias("x"), F.floor(F.col("v") / 97).alias("y")), AXES, f"{path}.xyz")
    return files.read_input(s, path, dims=2, n_weights=2)[0].select("v", "x", "y", "w0", "w1")


def _graph_binary(s, d):
    v, e = _dense(s, d)
    sinks.write_graph_binary(v, e, path := _path(s, ".bgf"))
    return files.read_graph(s, path)[1]


def _edges_binary(s, d):
    v, e = _dense(s, d)
    sinks.write_edge_list_binary(v, e, path := _path(s))
    return files.read_edge_list_binary(s, path, header=3)[1]


def _edge_list(s, d):
    v, e = _dense(s, d)
    one = e.filter("src < dst")
    path = _written(one, "src", F.concat_ws(" ", "src", "dst"), f"{v.count()} {one.count()}")
    return files.read_edge_list(s, path)[1]


def _edge_parts(s, d):
    one = _dense(s, d)[1].filter("src < dst")
    path = _written(one, "src", F.concat_ws(" ", "src", "dst"))
    v, e = files.read_edge_list_parts(s, f"{path}/part")
    return e.join(v, e.src == v.v, "left_semi")


def _matrix_market(s, d):
    v, e = _dense(s, d)
    one, n = e.filter("src > dst"), v.count()
    path = _written(one, "src", F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, "w"), f"%%MatrixMarket matrix coordinate real symmetric\n{n} {n} {one.count()}")
    return files.read_graph(s, path, "matrixmarket")[1]


def _xy_matrix_market(s, d):
    p = part_points(s, d)
    n = p.count()
    rows = p.select(F.posexplode(F.array(*AXES)).alias("i", "x"), "v").withColumn("at", F.col("i") * n + F.col("v"))
    path = _written(rows, "at", F.col("x").cast("string"), f"%%MatrixMarket matrix array real general\n{n} 2")
    assert files.matrix_market_shape(s, path) == (n, 2)
    return files.read_coordinates_matrix_market(s, path)


def _xy(write, read):
    def query(s, d):
        write(part_points(s, d), path := _path(s))
        return read(s, path)

    return query


def _xy_blocks(s, d):
    p = part_points(s, d)
    sinks.write_coordinates_by_block(p, p.select("v", (F.col("v") % 5).cast("int").alias("blk")), AXES, path := _path(s))
    a = s.read.text(path).select("blk", F.split("value", " ").alias("a"))
    return a.groupBy(F.col("blk").cast("int").alias("blk")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("a")[0].cast("double")), 3).alias("x"), F.round(F.sum(F.col("a")[1].cast("double")), 3).alias("y"))


def _adcirc(s, d):
    p = part_points(s, d)
    path = _written(p, "v", F.concat_ws(" ", F.col("v") + 1, "x", "y"), str(p.count()))
    return files.read_points(s, path, 2, "adcirc")


def _cells(s, d) -> DataFrame:
    """Triangles of every three parts in a row."""
    n = table(s, d, "part").count()
    return s.range(n // 3).select(F.col("id").alias("c"), *[(F.col("id") * 3 + i).alias(f"a{i}") for i in range(3)])


def _off(s, d):
    p, c = part_points(s, d), _cells(s, d)
    n = p.count()
    rows = p.select(F.col("v").alias("at"), F.concat_ws(" ", "x", "y", F.lit("0.0")).alias("line")).unionByName(c.select((F.col("c") + n).alias("at"), F.concat_ws(" ", F.lit("3"), "a0", "a1", "a2").alias("line")))
    v, e = files.read_graph(s, _written(rows, "at", F.col("line"), f"OFF\n{n} {c.count()} 0"), "off")
    return e.join(v.select(F.col("v").alias("src"), "x"), "src").select("src", "dst", "w", "x")


def _alya(s, d):
    p, c = part_points(s, d), _cells(s, d)
    n, m = p.count(), c.count()
    rows = c.select(F.col("c").alias("at"), F.concat_ws(" ", F.col("c") + 1, *[F.col(f"a{i}") + 1 for i in range(3)]).alias("line"))
    rows = rows.unionByName(s.createDataFrame([(m, "END_ELEMENTS"), (m + 1, "COORDINATES"), (m + 2 + n, "END_COORDINATES")], "at long, line string"))
    rows = rows.unionByName(p.select((F.col("v") + m + 2).alias("at"), F.concat_ws(" ", F.col("v") + 1, "x", "y").alias("line")))
    v, e = files.read_alya(s, _written(rows, "at", F.col("line"), "ELEMENTS"), 2)
    return e.join(v.select(F.col("v").alias("src"), "x"), "src").select("src", "dst", "w", "x")


def _octree(s, d):
    """A 4 x 4 x 4 grid of leaves under 8 cells under a root, as tree records, and its leaves' degrees by box."""
    def record(c, level, parent, near):
        flat = [*c, level, *(parent or (-1, -1, -1))]
        for x in near:
            flat += x or (-1, -1, -1)
        return " ".join(str(x) for x in flat)

    rows = [record((4.0, 4.0, 4.0), 3, None, [None] * 6)]
    for size in (4.0, 2.0):
        at = np.arange(size / 2, 8, size)
        for c in ((x, y, z) for x in at for y in at for z in at):
            near = [tuple(float(v + (w if i == j else 0)) for j, v in enumerate(c)) for i in range(3) for w in (-size, size)]
            up = tuple(float(x // (2 * size) * 2 * size + size) for x in c)
            rows.append(record(tuple(map(float, c)), int(math.log2(size)), up, [x if all(0 < v < 8 for v in x) else None for x in near]))
    lines = s.createDataFrame(list(enumerate(rows)), "at long, line string")
    v, e = files.read_graph(s, _written(lines, "at", F.col("line")), "quadtree")
    low, high = files.cell_bounds([F.col("x"), F.col("y"), F.col("z")], F.lit(1))
    return v.join(graph.degrees(e), "v").select(*[x.alias(f"low_{a}") for x, a in zip(low, "xyz", strict=True)], high[0].alias("high_x"), F.col("degree"))


def _vtk(s, d):
    p = part_points(s, d)
    sinks.write_vtk(p, p.select("v", (F.col("v") % 5).cast("int").alias("blk")), AXES, path := _path(s))
    n = p.count()
    rows = files.lines(s, path)
    xy = rows.filter(F.col("line").between(5, n + 4)).select((F.col("line") - 5).alias("v"), F.split("value", " ").alias("a"))
    blk = rows.filter(F.col("line") >= n + 8).select((F.col("line") - n - 8).alias("v"), F.col("value").cast("double").alias("b"))
    return xy.join(blk, "v").select("v", *[F.col("a")[i].cast("double").alias(a) for i, a in enumerate(AXES)], F.round("b", 4).alias("b"))


def _metis_parts(s, d):
    v, e = _dense(s, d)
    sinks.write_metis_parts(e, v.select("v", (F.col("v") % 4).cast("int").alias("blk")), path := _path(s))
    a = s.read.text(path).select("blk", F.expr("filter(split(value, ' '), x -> x <> '')").alias("a"))
    return a.groupBy(F.col("blk").cast("int").alias("blk")).agg(F.count("*").alias("lines"), F.sum(F.size("a")).cast("long").alias("ids"), F.sum(F.expr("aggregate(a, 0L, (t, x) -> t + cast(x as bigint))")).alias("total"))


def _partition_file(s, d):
    v, _ = _dense(s, d)
    sinks.write_partition(v.select("v", (F.col("v") * 7 % 13).cast("int").alias("blk")), path := _path(s))
    return files.read_partition(s, path, v.count())


def _vector_file(single):
    def query(s, d):
        sinks.write_vector(part_points(s, d), "y", path := _path(s), single=single)
        return files.lines(s, path).select(F.col("line").alias("v"), F.col("value").cast("double").alias("y"))

    return query


def _nations(s, d) -> DataFrame:
    """(k, region, name, customers, suppliers) of each nation."""
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    p = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"))
    return n.join(c, "k", "left").join(p, "k", "left").fillna(0, ["customers", "suppliers"])


def _block_sizes(s, d):
    path = _written(_nations(s, d), "k", F.concat_ws(" ", F.col("customers") + 1, F.col("suppliers") + 1), f"{_nations(s, d).count()} 2")
    w = files.read_block_sizes(s, path)
    return s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(*w, strict=True))], "blk int, w0 double, w1 double")


def _nation_tree(s, d) -> tuple[DataFrame, list[bool]]:
    path = _written(_nations(s, d), "k", F.concat(F.col("region"), F.lit(","), F.col("k"), F.lit(" # "), F.col("customers") + 1, F.lit(" "), F.col("suppliers") + 1), f"{_nations(s, d).count()} 2 1 0")
    rows, proportional = files.read_pe_tree(s, path)
    return topology.from_options(s, len(rows), pe_rows=rows), proportional


def _pe_tree(s, d):
    leaves, proportional = _nation_tree(s, d)
    topology.check_tree(leaves)
    return topology.adapt_weights(leaves, [1000.0, 1.0], proportional).select("leaf_id", F.array_join(F.transform("label", lambda x: x.cast("string")), ".").alias("label"), F.round(F.col("weights")[0], 6).alias("w0"), F.col("weights")[1].alias("w1"))


def _flat_topology(s, d):
    n = _nations(s, d).withColumn("host", F.regexp_replace("name", " ", "_"))
    path = _written(n, "k", F.concat_ws(" ", "host", F.col("customers") + 1, F.col("suppliers") + 2, F.lit("4")))
    hosts = [r["host"] for r in n.orderBy("k").collect()]
    w = files.block_sizes_from_topology(s, path, hosts)
    return s.createDataFrame([(i, round(a, 9), b) for i, (a, b) in enumerate(zip(*w, strict=True))], "blk int, cpu double, memory double")


def _csr(s, d):
    v, e = _dense(s, d)
    return files.csr_edges(files.csr_rows(e, v.count()))


def _there(s, d):
    path = _written(s.range(3), "id", F.col("id").cast("string"))
    return s.createDataFrame([("written", files.file_exists(s, path)), ("missing", files.file_exists(s, path + "x"))], "file string, found boolean")


def _label(leaves: DataFrame, *more: Column) -> DataFrame:
    return leaves.select("leaf_id", F.array_join(F.transform("label", lambda x: x.cast("string")), ".").alias("label"), *more)


def _flat_tree(s, d):
    w = _nations(s, d).orderBy("k").select("customers", "suppliers").collect()
    return _label(topology.flat(s, len(w), [[float(r[i] + 1) for r in w] for i in range(2)]), F.col("weights")[0].alias("w0"), F.col("weights")[1].alias("w1"))


def _balance(s, d):
    b = topology.balance_vectors(_nation_tree(s, d)[0], 1)
    return s.createDataFrame([(i, j, float(x)) for i, row in enumerate(b) for j, x in enumerate(row)], "weight int, node int, value double")


def _homogeneous(s, d):
    kinds = {"levels": topology.from_levels(s, [2, 3]), "flat": topology.flat(s, 5), "nations": _nation_tree(s, d)[0]}
    for x in kinds.values():
        topology.check_tree(x)
    return s.createDataFrame([(n, topology.is_homogeneous(x)) for n, x in kinds.items()], "tree string, homogeneous boolean")


def _memory(s, d):
    r = _nations(s, d).orderBy("k").collect()
    out = topology.sizes_for_memory([float(x["k"] % 5 + 1) for x in r], [float(40 + 13 * x["k"] % 77) for x in r], 900.0)
    return s.createDataFrame([(i, round(x, 6)) for i, x in enumerate(out)], "k int, size double")


def _mapping(s, d):
    e, p = supply_graph(s, d), supply_partition(s, d, K)
    blocks = [tuple(r) for r in graph.block_graph(e, p).collect()]
    pe = [(a, b, 1.0) for a in range(K) for b in range(K) if a != b]
    return s.createDataFrame(sorted(topology.identity_mapping_metrics(blocks, pe, K).items()), "metric string, value double")


def _qap(s, d):
    m = s.range(K).select(F.col("id").cast("int").alias("blk"), (F.col("id") * 3 % K).cast("int").alias("pe"))
    return topology.qap_cost(graph.block_graph(supply_graph(s, d), supply_partition(s, d, K)), topology.tree_graph(topology.from_levels(s, [2, 2, 2]), [1, 2, 4]), m)


def _greedy(s, d):
    blocks = [tuple(r) for r in graph.block_graph(supply_graph(s, d), supply_partition(s, d, K)).collect()]
    pe = [tuple(r) for r in topology.tree_graph(topology.from_levels(s, [2, 2, 2])).collect()]
    m = topology.greedy_mapping(blocks, pe, K, start=0)
    return s.createDataFrame([(topology.is_mapping(m), len(m), topology.is_mapping([0, 0, 1]))], "valid boolean, k int, wrong boolean")


def _overlap(s, d):
    old = part_points(s, d).select("v", (F.col("v") % K).cast("int").alias("blk"))
    return topology.heaviest_overlap(old, old.select("v", ((F.col("blk") * 3 + 1) % K).cast("int").alias("blk")), K)


def _averaged(s, d):
    e = supply_graph(s, d)
    vs = e.select(F.col("src").alias("v")).distinct()
    one = lambda c: metrics.edge_imbalance(e, vs.select("v", c.cast("int").alias("blk")), K).select(F.lit("edgeImbalance").alias("metric"), F.col("edgeImbalance").alias("value"))
    return metrics.averaged([one(F.col("v") % K), one(F.floor(F.col("v") / 3) % K)]).select("metric", F.round("value", 9).alias("value"))


def _metrics_all(s, d):
    e, p = supply_graph(s, d), supply_partition(s, d, K)
    old = p.select("v", (F.floor(F.col("v") / 3) % K).cast("int").alias("blk"))
    m = metrics.metrics(e, p, K, "all", old=old)
    return m.filter(F.col("metric").isin("finalCut", "edgeImbalance", "maxRedistVol", "totRedistVol", "maxBlockDiameter", "numDisconBlocks")).select("metric", F.round("value", 9).alias("value"))


def _regions(s, d) -> tuple[DataFrame, DataFrame]:
    """The tree of regions, nations and customers: a block is a region with all below it."""
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))
    c = table(s, d, "customer").select((F.col("c_custkey") + 100).alias("c"), F.col("c_nationkey").cast("long").alias("n"))
    up = n.select((F.col("n") + 10).alias("src"), F.col("r").alias("dst")).unionByName(c.select(F.col("c").alias("src"), (F.col("n") + 10).alias("dst")))
    e = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("w", F.lit(1.0))
    p = n.select(F.col("r").alias("v"), "r").distinct().unionByName(n.select((F.col("n") + 10).alias("v"), "r")).unionByName(c.join(n, "n").select(F.col("c").alias("v"), "r"))
    return e, p.select("v", F.col("r").cast("int").alias("blk"))


def _applied(e: DataFrame, x: DataFrame, column: str, factor: float = 1.0, digits: int = 2) -> DataFrame:
    """(v, b): the Laplacian times a solution, which must give the right-hand side back."""
    m = graph.laplacian(e, factor).join(x.select(F.col("v").alias("col"), F.col(column).alias("x")), "col")
    # Adding 0.0 makes a rounded -0.0 a 0.0.
    return m.groupBy(F.col("row").alias("v")).agg((F.round(F.sum(F.col("value") * F.col("x")), digits) + 0.0).alias("b"))


def _cg(s, d):
    e = supply_graph(s, d)
    b = e.select(F.col("src").alias("v")).distinct().select("v", (F.col("v") % 5).cast("double").alias("b"))
    return _applied(e, metrics.conjugate_gradient(e, b, 1.1)[0], "x", 1.1)


def _flow(s, d):
    e = supply_graph(s, d)
    v = e.select(F.col("src").alias("v")).distinct().withColumn("w0", F.lit(1.0))
    lo, hi = v.agg(F.min("v"), F.max("v")).first()
    p = diffusion.landmark_potentials(v, e, [lo, hi])
    return _applied(e, p, "p0").withColumnRenamed("b", "b0").join(_applied(e, p, "p1").withColumnRenamed("b", "b1"), "v")


def _curve_back(s, d):
    """Whether the point of a point's curve index lies in the point's cell, whose sides are 1 / 512 of the box."""
    box = ([0.0, 0.0], [500000.0, 2500.0])
    h = hilbert.with_hilbert(order_points(s, d), AXES, 9, box)
    x, y = hilbert.inverse_column(hilbert.fraction(F.col("h"), 2, 9), 2, 9)
    near = [F.abs(back - hilbert.scaled(F.col(a), lo, hi)) <= 1 / 512 + 1e-12 for back, a, lo, hi in zip((x, y), AXES, *box, strict=True)]
    return h.select("v", (near[0] & near[1]).alias("near"))


def _sorted_curve(s, d):
    return sfc.sorted_indices(order_points(s, d), AXES, 9, box=([0.0, 0.0], [500000.0, 2500.0])).select("v", "rank")


def _curve_ranges(s, d):
    r = sfc.ranges(sfc.redistribute(order_points(s, d), AXES, 6))
    return r.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("ordered").alias("ordered"))


def _curve_centres(s, d):
    c = sfc.centres_from_curve(16, 2, 9, ([0.0, 0.0], [512.0, 512.0]))
    p = s.createDataFrame([(i, *map(float, x)) for i, x in enumerate(c)], "i int, x double, y double")
    h = hilbert.with_hilbert(p, AXES, 4, ([0.0, 0.0], [512.0, 512.0]))
    return h.select("i", F.floor(F.col("h") / 16).cast("int").alias("part"))


def _bounds(s, d):
    low, high = hilbert.bounds(order_points(s, d), AXES)
    return s.createDataFrame([tuple([*low, *high])], "x0 double, y0 double, x1 double, y1 double")


def _histogram(s, d):
    p = part_points(s, d)
    data = p.select("v", F.array("x", "y").alias("x"), F.col("w0").alias("w"))
    c, w = multisection.histogram(data, multisection.Box(*hilbert.bounds(p, AXES)), [0])[0]
    return s.createDataFrame([(float(a), float(b)) for a, b in zip(c, w, strict=True)], "x double, w double")


def _splits(s, d):
    w = [r["w"] for r in _histogram(s, d).orderBy("x").collect()]
    starts, best = multisection.splits_optimal(w, 3)
    ends = [*starts[1:], len(w)]
    greedy = multisection.splits_greedy(w, 3)
    return s.createDataFrame([(float(best), max(sum(w[a:b]) for a, b in zip(starts, ends, strict=True)), len(greedy) == 3 and greedy == sorted(set(greedy)))], "best double, most double, greedy boolean")


def _multisection4(s, d):
    return multisection.multisection(order_points(s, d), AXES, 4)[0]


def _quadtree_leaves(s, d):
    leaf, _ = spatial.quadtree(order_points(s, d), AXES, 64, ([0.0, 0.0], [500000.0, 2500.0]))
    return leaf.groupBy("level", F.array_join(F.transform("cell", lambda c: c.cast("string")), ",").alias("cell")).agg(F.count("*").alias("n")).select(F.col("level").cast("int").alias("level"), "cell", "n")


def _leaf_graph(s, d):
    _, leaves = spatial.quadtree(order_points(s, d), AXES, 256, ([0.0, 0.0], [500000.0, 2500.0]))
    v, e = spatial.leaf_graph(leaves, 2)
    return v.join(graph.degrees(e), "v").select(F.col("level").cast("int").alias("level"), F.array_join(F.transform("cell", lambda c: c.cast("string")), ",").alias("cell"), "degree")


def _kd(s, d):
    return spatial.kd_tree(part_points(s, d), AXES, 2, accuracy=10_000_000).select("v", F.col("leaf").cast("int").alias("leaf"))


def _polar(s, d):
    return spatial.polar_cells(part_points(s, d).select("v", (F.col("x") / 8).alias("a"), F.col("y").alias("r")), "a", "r", 3, 1000.0)


def _near(s, d):
    inside = lambda dist: F.when(dist < 5, 1.0).otherwise(0.0)
    return spatial.sampled_by_distance(part_points(s, d), [25.0, 950.0], AXES, inside).select("v", F.round("dist", 6).alias("dist"))


def _hadamard(s, d):
    h = graph.hadamard(16)
    return s.createDataFrame([(i, j, float(h[i, j])) for i in range(16) for j in range(16)], "i int, j int, value double")


def _colouring(s, d):
    pairs = [(r["bs"], r["bd"], r["w"]) for r in graph.block_graph(supply_graph(s, d), supply_partition(s, d, K)).collect()]
    c = graph.edge_colouring(pairs)
    ends = [(colour, x) for colour, a, b in c for x in (a, b)]
    rounds = graph.communication_pairs(supply_graph(s, d), supply_partition(s, d, K))
    return s.createDataFrame([(len({(a, b) for _, a, b in c}), len(ends) - len(set(ends)), len(rounds))], "pairs int, conflicts int, rounds int")


def _matching(s, d):
    e, v = supply_graph(s, d), supply_points(s, d)
    m = settle(multilevel.matching(e, v))
    used = m.select(F.explode(F.array("a", "b")).alias("v"))
    foreign = m.join(e, (m.a == e.src) & (m.b == e.dst), "left_anti").count()
    repeat = used.groupBy("v").count().filter("count > 1").count()
    return s.createDataFrame([(m.count() > 0, foreign, repeat)], "some boolean, foreign int, repeated int")


def _coarse(s, d):
    p = part_points(s, d)
    m = p.select("v", F.floor(F.col("v") / 3).cast("long").alias("c"))
    mean = multilevel.to_coarse(p, m, "x").select("v", F.round("x", 6).alias("x"))
    return multilevel.to_fine(mean, m).select("v", "x")


def _interface(s, d):
    return multilevel.interface(supply_graph(s, d), supply_blocks(s, d), 0, 1, 1).select("v", F.col("hop").cast("int").alias("hop"))


def _sizes_hold(spark: SparkSession, part: DataFrame, points: DataFrame, k: int, slack: float) -> DataFrame:
    """One row: vertices, vertices that aren't in exactly one block, ids out of range, blocks beyond ceil(n / k) * slack."""
    n = points.count()
    part = settle(part)
    out = part.filter(~F.col("blk").between(0, k - 1)).count()
    lost = points.select("v").join(part.groupBy("v").count(), "v", "left").filter("count is null or count <> 1").count()
    over = part.groupBy("blk").count().filter(F.col("count") > math.ceil(n / k) * slack + 1e-9).count()
    return spark.createDataFrame([(n, lost, out, over, part.count())], "n long, lost long, foreign long, over long, rows long")


def _orders(f, k: int = 4, slack: float = 1.03):
    return lambda s, d: _sizes_hold(s, f(order_points(s, d)), order_points(s, d), k, slack)


def _again(p: DataFrame) -> DataFrame:
    old = p.select("v", F.least(F.floor(F.col("x") / 125000), F.lit(3)).cast("int").alias("blk"))
    return kmeans.repartition(p, old, AXES, 4)[0]


def _balanced(p: DataFrame) -> DataFrame:
    old = p.select("v", F.least(F.floor(F.col("x") / 150000), F.lit(3)).cast("int").alias("blk"))
    return kmeans.balance(p, old, AXES, 4)


def _nearest_block(s, d):
    """Every point of a k-means partition lies in the block of least distance times influence: rows that don't."""
    p = order_points(s, d)
    part, c = kmeans.kmeans_partition(p, AXES, 4)
    own = F.array(*[((F.col("x") - float(q[0])) * (F.col("x") - float(q[0])) + (F.col("y") - float(q[1])) * (F.col("y") - float(q[1]))) * float(c.influence[0, i]) for i, q in enumerate(c.centres)])
    far = p.join(part, "v").withColumn("d", own).filter(F.element_at("d", F.col("blk") + 1) > F.array_min("d") * (1 + 1e-9))
    return s.createDataFrame([(far.count(),)], "wrong long")


def _refined(s, d):
    """Cut before and after refinement, and whether blocks keep their bounds."""
    v, e, p = supply_points(s, d), supply_graph(s, d), supply_blocks(s, d)
    n = v.count()
    out, gain = multilevel.refine(v, e, p, 4, np.full(4, n / 4 * 1.03), Settings(num_blocks=4))
    a, b = (graph.edge_cut(e, x).first()[0] for x in (p, out))
    over = out.groupBy("blk").count().filter(F.col("count") > n / 4 * 1.03).count()
    return s.createDataFrame([(float(a), bool(b <= a), abs((a - b) - gain) < 1e-6, over)], "before double, better boolean, told boolean, over long")


def _registered(s, d):
    plan.register_partitioner("by_remainder", lambda p: p.vertices.select("v", (F.col("v") % p.settings.num_blocks).cast("int").alias("blk")))
    return plan.partition_graph(supply_points(s, d), supply_graph(s, d), Settings(num_blocks=5, dimensions=2, tool="by_remainder"))


def _placed(s, d):
    p = part_points(s, d)
    part = p.select("v", (F.col("v") * 5 % 7).cast("int").alias("blk"))
    where = plan.placed(p, part, 4).select("v", "x", "blk", F.spark_partition_id().alias("task"))
    return where.groupBy("blk").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.countDistinct("task").alias("tasks"))


def _unbalanced(s, d):
    p = part_points(s, d)
    part = p.select("v", F.least(F.floor(F.col("x") / 13), F.lit(3)).cast("int").alias("blk"))
    w, off = diffusion.unbalanced_weights(p, part, AXES, 4, 0.5, [5.0, 910.0])
    got = graph.block_weights(part, 4, w).agg(F.max("weight") / (F.sum("weight") / 4) - 1).first()[0]
    return s.createDataFrame([(0.5 <= off <= 0.55, abs(got - off) < 1e-9, w.count())], "within boolean, told boolean, n long")


def _normalised(s, d):
    c = kmeans.Clusters(np.array([(5.0, 910.0), (15.0, 930.0), (25.0, 950.0), (35.0, 970.0), (45.0, 990.0)]), np.array([[1.0, 1.25, 0.75, 1.5, 1.0]]), np.zeros(5, dtype=np.int32))
    m = kmeans.membership(kmeans.fuzzify(part_points(s, d), AXES, c, 3))
    return kmeans.membership_normalised(m, part_points(s, d).select("v", (F.col("v") % 4).cast("int").alias("blk"))).select("v", F.round("value", 6).alias("value"))


def _range_of_blocks(s, d):
    return graph.block_ranges(part_points(s, d).select("v", (F.col("v") * 3 % 7).cast("int").alias("blk"))).select("blk", F.col("first").cast("long").alias("first"), F.col("stop").cast("long").alias("stop"))


def _prefix(s, d):
    p = graph.shuffled_prefix(part_points(s, d), 100, 7)
    return p.agg(F.count("*").alias("n"), F.countDistinct("v").alias("ids"))


def _named(s, d):
    """Parts of the words of a name, and distances of a part from a point."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("v"), "p_name", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    at = F.array("x", "y")
    return p.select("v", F.size(scalars.text_parts(F.col("p_name"))).alias("words"), F.round(scalars.distance([F.col("x"), F.col("y")], [F.lit(3.0), F.lit(4.0)]), 6).alias("far"), F.round(scalars.array_distance(at, F.array(F.lit(3.0), F.lit(4.0))), 6).alias("array_far"), F.round(scalars.length(at), 6).alias("length"), scalars.squared_distance([F.col("x")], [F.lit(7.0)]).alias("squared"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "file_metis": _metis, "file_input": _input, "file_graph_binary": _graph_binary, "file_edges_binary": _edges_binary, "file_edge_list": _edge_list, "file_edge_parts": _edge_parts,
        "file_matrix_market": _matrix_market, "file_xy_matrix_market": _xy_matrix_market,
        "file_xy": _xy(lambda p, f: sinks.write_coordinates(p, AXES, f), lambda s, f: files.read_points(s, f, 2)),
        "file_xy_single": _xy(lambda p, f: sinks.write_coordinates(p, AXES, f, single=True), lambda s, f: files.read_points(s, f, 2)),
        "file_xy_binary": _xy(lambda p, f: sinks.write_coordinates_binary(p, AXES, f), lambda s, f: files.read_points(s, f, 2, "binary")),
        "file_xy_weight": _xy(lambda p, f: sinks.write_points_with_weight(p, AXES, f), lambda s, f: files.read_points(s, f, 2, "teec")),
        "file_xy_blocks": _xy_blocks, "file_adcirc": _adcirc, "file_off": _off, "file_alya": _alya, "file_octree": _octree, "file_vtk": _vtk, "file_metis_parts": _metis_parts,
        "file_partition": _partition_file, "file_vector": _vector_file(False), "file_vector_single": _vector_file(True), "file_block_sizes": _block_sizes, "file_pe_tree": _pe_tree, "file_flat_topology": _flat_topology, "file_exists": _there, "csr_arrays": _csr,
        "tree_from_levels": lambda s, d: _label(topology.from_levels(s, [2, 3, 4], 2), F.col("weights")[1].alias("w1")),
        "tree_flat": _flat_tree,
        "tree_grouping": lambda s, d: s.createDataFrame([(i, n) for i, n in enumerate(topology.grouping(_nation_tree(s, d)[0], 1))], "node int, children int"),
        "tree_balance": _balance, "tree_homogeneous": _homogeneous, "memory_sizes": _memory,
        "mapping_metrics": _mapping, "mapping_cost": _qap, "mapping_greedy": _greedy, "heaviest_overlap": _overlap,
        "metrics_averaged": _averaged, "metrics_all": _metrics_all,
        "block_diameter_regions": lambda s, d: graph.block_diameter(*_regions(s, d)).select("blk", "diameter"),
        "diameter_metrics": lambda s, d: metrics.diameter_metrics(*_regions(s, d)).select("metric", F.round("value", 9).alias("value")),
        "cg_solution": _cg, "diffusion_potentials": _flow,
        "curve_inverse": _curve_back, "curve_order": _sorted_curve, "curve_ranges": _curve_ranges, "curve_only_centres": _curve_centres, "coordinate_bounds": _bounds,
        "histogram_operator": _histogram, "splits_1d": _splits, "multisection_4": _multisection4, "quadtree_leaves": _quadtree_leaves, "quadtree_graph": _leaf_graph, "kd_tree_exact": _kd, "polar_cells": _polar, "sampled_by_distance": _near,
        "hadamard": _hadamard, "edge_colouring": _colouring, "matching_valid": _matching, "coarse_means": _coarse, "interface_nodes": _interface,
        "degree_sum": lambda s, d: multilevel.degree_sum(supply_graph(s, d), supply_points(s, d).filter("v % 2 = 0")),
        "self_loops": lambda s, d: s.createDataFrame([(graph.has_self_loops(supply_graph(s, d)), graph.has_self_loops(supply_graph(s, d).withColumn("dst", F.col("src"))))], "graph boolean, loops boolean"),
        "kmeans_sizes": _orders(lambda p: kmeans.kmeans_partition(p, AXES, 4)[0]),
        "kmeans_nearest": _nearest_block,
        "kmeans_hierarchical_sizes": _orders(lambda p: kmeans.hierarchical(p, AXES, [2, 2])),
        "kmeans_again_sizes": _orders(_again),
        "kmeans_hierarchical_again_sizes": _orders(lambda p: kmeans.hierarchical_repartition(p, AXES, [2, 2])),
        "kmeans_balanced_sizes": _orders(_balanced),
        "bisection_sizes": _orders(lambda p: multisection.coordinate_bisection(p, AXES, 4), slack=1.05),
        "pixel_sizes": _orders(lambda p: pixel.pixel_partition(p, AXES, 4), slack=1.2),
        "refinement_valid": _refined, "registered_partitioner": _registered, "placed_blocks": _placed, "unbalanced_weights": _unbalanced, "membership_normalised": _normalised, "block_ranges": _range_of_blocks, "shuffled_prefix": _prefix, "scalar_functions": _named,
        "relabelled_edges": lambda s, d: graph.relabelled(supply_graph(s, d).select(F.col("src").alias("v")).distinct(), supply_graph(s, d))[1],
    }


_DENSE = """WITH n AS (SELECT (SELECT count(*) FROM part) AS n, (SELECT count(*) FROM supplier) AS m),
o AS (SELECT l_partkey AS p, l_suppkey + (SELECT n FROM n) AS s, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2),
e AS (SELECT p AS src, s AS dst, w FROM o UNION ALL SELECT s, p, w FROM o)"""
_XY = "SELECT p_partkey AS v, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part"
_NATION = """n AS (SELECT n_nationkey AS k, n_regionkey AS r, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + 1 AS c, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + 1 AS p FROM nation)"""
_TRIANGLES = "t AS (SELECT i * 3 AS a FROM range((SELECT count(*) FROM part) // 3) z(i)), e AS (SELECT a + i AS src, a + j AS dst, CAST(1.0 AS DOUBLE) AS w FROM t, range(3) x(i), range(3) y(j) WHERE i <> j)"
_REGIONS = """n AS (SELECT CAST(n_nationkey AS BIGINT) + 10 AS v, CAST(n_regionkey AS BIGINT) AS r FROM nation),
c AS (SELECT c_custkey + 100 AS v, CAST(c_nationkey AS BIGINT) + 10 AS n FROM customer),
up AS (SELECT v AS a, r AS b FROM n UNION ALL SELECT v, n FROM c),
e AS (SELECT a, b FROM up UNION ALL SELECT b, a FROM up),
p AS (SELECT DISTINCT r AS v, r FROM n UNION ALL SELECT v, r FROM n UNION ALL SELECT c.v, n.r FROM c JOIN n ON n.v = c.n),
w AS (SELECT v AS s, v, r, 0 AS d FROM p UNION SELECT w.s, e.b, w.r, w.d + 1 FROM w JOIN e ON e.a = w.v WHERE w.d < 4),
f AS (SELECT r, s, v, min(d) AS d FROM w GROUP BY ALL),
g AS (SELECT CAST(r AS INTEGER) AS blk, CASE WHEN count(*) = (SELECT count(*) * count(*) FROM p WHERE p.r = f.r) THEN max(d) END AS diameter FROM f GROUP BY f.r)"""


def oracle_sql() -> dict[str, str]:
    from gridloom.plans.catalogue import _ORDERS, _P, _S, _SUPPLY, _hilbert_sql

    box = [(0.0, 0.0), (500000.0, 2500.0)]
    hold = "SELECT count(*) AS n, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS \"foreign\", CAST(0 AS BIGINT) AS over, count(*) AS rows FROM orders"
    cells = f"""WITH RECURSIVE q AS ({_ORDERS}), l AS (SELECT v, lv, CAST(least(floor(x / 500000.0::DOUBLE * power(2.0::DOUBLE, lv)), power(2.0::DOUBLE, lv) - 1) AS BIGINT) AS a, CAST(least(floor(y / 2500.0::DOUBLE * power(2.0::DOUBLE, lv)), power(2.0::DOUBLE, lv) - 1) AS BIGINT) AS b FROM q, range(14) t(lv)),
full_cells AS (SELECT lv, a, b FROM l GROUP BY ALL HAVING count(*) > CAP)"""
    fuzzy_rows = "(0, 5.0::DOUBLE, 910.0::DOUBLE, 1.0::DOUBLE), (1, 15.0::DOUBLE, 930.0::DOUBLE, 1.25::DOUBLE), (2, 25.0::DOUBLE, 950.0::DOUBLE, 0.75::DOUBLE), (3, 35.0::DOUBLE, 970.0::DOUBLE, 1.5::DOUBLE), (4, 45.0::DOUBLE, 990.0::DOUBLE, 1.0::DOUBLE)"
    sides = "CASE WHEN max(x) OVER (PARTITION BY LEAF) - min(x) OVER (PARTITION BY LEAF) = greatest(max(x) OVER (PARTITION BY LEAF) - min(x) OVER (PARTITION BY LEAF), max(y) OVER (PARTITION BY LEAF) - min(y) OVER (PARTITION BY LEAF)) THEN x ELSE y END"
    order = lambda leaf: sides.replace("LEAF", leaf)
    return {
        "file_metis": f"{_DENSE} SELECT * FROM e",
        "file_input": f"{_DENSE} SELECT i AS v, CAST(i % 97 AS DOUBLE) AS x, CAST(i // 97 AS DOUBLE) AS y, CAST(1.0 AS DOUBLE) AS w0, CAST(1.0 AS DOUBLE) AS w1 FROM range((SELECT n + m FROM n)) t(i)",
        "file_graph_binary": f"{_DENSE} SELECT src, dst, CAST(1.0 AS DOUBLE) AS w FROM e",
        "file_edges_binary": f"{_DENSE} SELECT src, dst, CAST(1.0 AS DOUBLE) AS w FROM e",
        "file_edge_list": f"{_DENSE} SELECT src, dst, CAST(1.0 AS DOUBLE) AS w FROM e",
        "file_edge_parts": f"{_DENSE} SELECT src, dst, CAST(1.0 AS DOUBLE) AS w FROM e",
        "file_matrix_market": f"{_DENSE} SELECT * FROM e",
        "file_xy_matrix_market": _XY, "file_xy": _XY, "file_xy_single": _XY, "file_xy_binary": _XY, "file_adcirc": _XY,
        "file_xy_weight": _XY.replace(" FROM", ", CAST(p_size AS DOUBLE) AS w0 FROM"),
        "file_xy_blocks": f"SELECT CAST(v % 5 AS INTEGER) AS blk, count(*) AS n, round(sum(x), 3) AS x, round(sum(y), 3) AS y FROM ({_XY}) GROUP BY 1",
        "file_off": f"WITH {_TRIANGLES} SELECT src, dst, w, CAST(p_size AS DOUBLE) AS x FROM e JOIN part ON p_partkey = src",
        "file_alya": f"WITH {_TRIANGLES} SELECT src, dst, w, CAST(p_size AS DOUBLE) AS x FROM e JOIN part ON p_partkey = src",
        "file_octree": "WITH c AS (SELECT i, j, k FROM range(4) a(i), range(4) b(j), range(4) c(k)) SELECT i * 2.0::DOUBLE AS low_x, j * 2.0::DOUBLE AS low_y, k * 2.0::DOUBLE AS low_z, i * 2.0::DOUBLE + 2 AS high_x, (SELECT count(*) FROM c d WHERE abs(c.i - d.i) + abs(c.j - d.j) + abs(c.k - d.k) = 1) AS degree FROM c",
        "file_vtk": f"SELECT v, x, y, round(CAST(v % 5 AS DOUBLE) / 4, 4) AS b FROM ({_XY})",
        "file_metis_parts": f"{_DENSE} SELECT CAST(i % 4 AS INTEGER) AS blk, count(DISTINCT i) AS lines, count(dst) AS ids, CAST(coalesce(sum(dst + 1), 0) AS BIGINT) AS total FROM range((SELECT n + m FROM n)) t(i) LEFT JOIN e ON src = i GROUP BY 1",
        "file_partition": f"{_DENSE} SELECT i AS v, CAST(i * 7 % 13 AS INTEGER) AS blk FROM range((SELECT n + m FROM n)) t(i)",
        "file_vector": "SELECT p_partkey AS v, p_retailprice AS y FROM part", "file_vector_single": "SELECT p_partkey AS v, p_retailprice AS y FROM part",
        "file_block_sizes": f"WITH {_NATION} SELECT k AS blk, CAST(c AS DOUBLE) AS w0, CAST(p AS DOUBLE) AS w1 FROM n",
        "file_pe_tree": f"WITH {_NATION} SELECT k AS leaf_id, r || '.' || k AS label, round(c * (1000.0::DOUBLE / (SELECT sum(c) FROM n)), 6) AS w0, CAST(p AS DOUBLE) AS w1 FROM n",
        "file_flat_topology": f"WITH {_NATION} SELECT k AS blk, round(CAST(c AS DOUBLE) / (SELECT sum(c) FROM n), 9) AS cpu, CAST(p + 1 AS DOUBLE) AS memory FROM n",
        "file_exists": "SELECT * FROM (VALUES ('written', true), ('missing', false)) t(file, found)",
        "csr_arrays": f"{_DENSE} SELECT * FROM e",
        "tree_from_levels": "SELECT CAST(i AS INTEGER) AS leaf_id, (i // 12) || '.' || (i // 4 % 3) || '.' || (i % 4) AS label, CAST(1.0 AS DOUBLE) AS w1 FROM range(24) t(i)",
        "tree_flat": f"WITH {_NATION} SELECT k AS leaf_id, CAST(k AS VARCHAR) AS label, CAST(c AS DOUBLE) AS w0, CAST(p AS DOUBLE) AS w1 FROM n",
        "tree_grouping": f"WITH {_NATION} SELECT CAST(row_number() OVER (ORDER BY r) - 1 AS INTEGER) AS node, CAST(count(*) AS INTEGER) AS children FROM n GROUP BY r",
        "tree_balance": f"WITH {_NATION}, g AS (SELECT CAST(row_number() OVER (ORDER BY r) - 1 AS INTEGER) AS node, sum(c) AS c, sum(p) AS p FROM n GROUP BY r) SELECT 0 AS weight, node, CAST(c AS DOUBLE) AS value FROM g UNION ALL SELECT 1, node, CAST(p AS DOUBLE) FROM g",
        "tree_homogeneous": f"WITH {_NATION} SELECT 'levels' AS tree, true AS homogeneous UNION ALL SELECT 'flat', true UNION ALL SELECT 'nations', count(DISTINCT (c, p)) = 1 FROM n",
        "memory_sizes": "WITH RECURSIVE p AS (SELECT n_nationkey AS k, CAST(n_nationkey % 5 + 1 AS DOUBLE) AS s, CAST(40 + 13 * n_nationkey % 77 AS DOUBLE) AS m FROM nation), o AS (SELECT *, row_number() OVER (ORDER BY s / m DESC, k) AS i FROM p), r AS (SELECT CAST(0 AS BIGINT) AS i, 0 AS k, 900.0::DOUBLE AS left_over, (SELECT sum(s) FROM p) AS fast, 0.0::DOUBLE AS size UNION ALL SELECT o.i, o.k, left_over - least(left_over * s / fast, m), fast - s, least(left_over * s / fast, m) FROM r JOIN o ON o.i = r.i + 1) SELECT k, round(size, 6) AS size FROM r WHERE i > 0",
        "mapping_metrics": f"{_S}, b AS (SELECT bs, bd, sum(w) AS w FROM x WHERE bs <> bd GROUP BY 1, 2) SELECT 'maxDilation' AS metric, max(w) AS value FROM b UNION ALL SELECT 'avgDilation', sum(w) / 2 / 28 FROM b UNION ALL SELECT 'maxCongestion', max(w) FROM b UNION ALL SELECT 'qapCost', sum(w) / 2 FROM b UNION ALL SELECT 'blockEdges', count(*) / 2 FROM b",
        "mapping_cost": f"{_S}, b AS (SELECT bs * 3 % 8 AS s, bd * 3 % 8 AS t, sum(w) AS w FROM x WHERE bs <> bd GROUP BY 1, 2) SELECT CAST(sum(w * CASE WHEN s // 4 <> t // 4 THEN 4 WHEN s // 2 <> t // 2 THEN 2 ELSE 1 END) / 2 AS DOUBLE) AS cost FROM b",
        "mapping_greedy": "SELECT true AS valid, 8 AS k, false AS wrong",
        "heaviest_overlap": "SELECT CAST((i * 3 + 1) % 8 AS INTEGER) AS blk, CAST(i AS INTEGER) AS new_blk FROM range(8) t(i)",
        "metrics_averaged": f"{_S}, a AS (SELECT max(n) / (sum(n) / 8) - 1 AS i FROM (SELECT count(*) AS n FROM e GROUP BY src % 8) UNION ALL SELECT max(n) / (sum(n) / 8) - 1 FROM (SELECT count(*) AS n FROM e GROUP BY src // 3 % 8)) SELECT 'edgeImbalance' AS metric, round(CAST(avg(i) AS DOUBLE), 9) AS value FROM a",
        "metrics_all": f"{_S}, m AS (SELECT v // 3 % 8 AS a, blk AS b FROM p WHERE blk <> v // 3 % 8) SELECT 'finalCut' AS metric, round(CAST(sum(w) / 2 AS DOUBLE), 9) AS value FROM x WHERE bs <> bd UNION ALL SELECT 'edgeImbalance', round(CAST(max(n) / (sum(n) / 8) - 1 AS DOUBLE), 9) FROM (SELECT count(*) AS n FROM x GROUP BY bs) UNION ALL SELECT 'maxRedistVol', CAST(max(n) AS DOUBLE) FROM (SELECT count(*) AS n FROM m GROUP BY a UNION ALL SELECT count(*) FROM m GROUP BY b) UNION ALL SELECT 'totRedistVol', CAST(count(*) AS DOUBLE) FROM m UNION ALL SELECT 'maxBlockDiameter', CAST(0 AS DOUBLE) UNION ALL SELECT 'numDisconBlocks', CAST(count(*) AS DOUBLE) FROM (SELECT blk FROM p WHERE NOT EXISTS (SELECT 1 FROM x WHERE bs = bd AND bs = p.blk) GROUP BY blk HAVING count(*) > 1)",
        "block_diameter_regions": f"WITH RECURSIVE {_REGIONS} SELECT blk, CAST(diameter AS BIGINT) AS diameter FROM g",
        "diameter_metrics": f"WITH RECURSIVE {_REGIONS} SELECT 'maxBlockDiameter' AS metric, CAST(coalesce(max(diameter), 0) AS DOUBLE) AS value FROM g UNION ALL SELECT 'harmMeanDiam', round(CAST(coalesce(count(diameter) / sum(1.0::DOUBLE / nullif(diameter, 0)), 0) AS DOUBLE), 9) FROM g UNION ALL SELECT 'numDisconBlocks', CAST(count(*) - count(diameter) AS DOUBLE) FROM g",
        "cg_solution": f"{_S} SELECT DISTINCT src AS v, CAST(src % 5 AS DOUBLE) AS b FROM e",
        "diffusion_potentials": f"{_S}, z AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM p) SELECT v, CAST(CASE WHEN v = lo THEN n - 1 ELSE -1 END AS DOUBLE) AS b0, CAST(CASE WHEN v = hi THEN n - 1 ELSE -1 END AS DOUBLE) AS b1 FROM p, z",
        "curve_inverse": "SELECT o_orderkey AS v, true AS near FROM orders",
        "curve_order": _hilbert_sql(2, 9, "SELECT v, row_number() OVER (ORDER BY h, v) - 1 AS rank FROM hb", *box),
        "curve_ranges": _hilbert_sql(2, 9, "SELECT min(h) AS low, max(h) AS high, true AS ordered FROM hb"),
        "curve_only_centres": "SELECT CAST(i AS INTEGER) AS i, CAST(i AS INTEGER) AS part FROM range(16) t(i)",
        "coordinate_bounds": f"WITH q AS ({_ORDERS}) SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM q",
        "histogram_operator": f"{_P} SELECT x, sum(w0) AS w FROM q GROUP BY x",
        "splits_1d": f"{_P}, h AS (SELECT x, sum(w0) AS w FROM q GROUP BY x), c AS (SELECT row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS s FROM h), t AS (SELECT max(s) AS t FROM c), b AS (SELECT min(greatest(a.s, b.s - a.s, t - b.s)) AS best FROM c a JOIN c b ON a.i < b.i, t) SELECT best, best AS most, true AS greedy FROM b",
        "multisection_4": f"""WITH q AS ({_ORDERS}), s AS (SELECT CAST(CAST(trunc(sqrt(CAST(count(*) - 1 AS DOUBLE))) AS BIGINT) AS DOUBLE) AS g, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM q),
i AS (SELECT v, floor((x - x0) / (x1 - x0) * g) AS a, floor((y - y0) / (y1 - y0) * g) AS b FROM q, s),
h AS (SELECT a, count(*) AS n FROM i GROUP BY a), c AS (SELECT a, sum(n) OVER (ORDER BY a) AS s FROM h), t AS (SELECT max(s) AS t FROM c),
m AS (SELECT min(greatest(s, t - s)) AS best FROM c, t), cut AS (SELECT max(a) AS a FROM c, m WHERE s <= best),
j AS (SELECT v, b, CASE WHEN i.a <= cut.a THEN 0 ELSE 1 END AS half FROM i, cut),
h2 AS (SELECT half, b, count(*) AS n FROM j GROUP BY ALL), c2 AS (SELECT half, b, sum(n) OVER (PARTITION BY half ORDER BY b) AS s, sum(n) OVER (PARTITION BY half) AS t FROM h2),
m2 AS (SELECT half, min(greatest(s, t - s)) AS best FROM c2 GROUP BY half), cut2 AS (SELECT c2.half, max(b) AS b FROM c2 JOIN m2 USING (half) WHERE s <= best GROUP BY c2.half)
SELECT v, CAST(half * 2 + CASE WHEN j.b <= cut2.b THEN 0 ELSE 1 END AS INTEGER) AS blk FROM j JOIN cut2 USING (half)""",
        "quadtree_leaves": f"{cells.replace('CAP', '64')}, w AS (SELECT l.v, max(l.lv) + 1 AS lv FROM l JOIN full_cells f ON f.lv = l.lv AND f.a = l.a AND f.b = l.b GROUP BY l.v) SELECT CAST(l.lv AS INTEGER) AS level, l.a || ',' || l.b AS cell, count(*) AS n FROM l LEFT JOIN w ON w.v = l.v WHERE l.lv = coalesce(w.lv, 0) GROUP BY 1, 2",
        "quadtree_graph": f"{cells.replace('CAP', '256')}, k AS (SELECT lv + 1 AS lv, a * 2 + i AS a, b * 2 + j AS b FROM full_cells, range(2) x(i), range(2) y(j) UNION ALL SELECT 0, 0, 0), leaf AS (SELECT lv, a, b, a << (20 - lv) AS x0, (a + 1) << (20 - lv) AS x1, b << (20 - lv) AS y0, (b + 1) << (20 - lv) AS y1 FROM k WHERE (lv, a, b) NOT IN (SELECT (lv, a, b) FROM full_cells)) SELECT CAST(p.lv AS INTEGER) AS level, p.a || ',' || p.b AS cell, count(*) AS degree FROM leaf p JOIN leaf q ON ((p.x1 = q.x0 OR q.x1 = p.x0) AND p.y0 < q.y1 AND q.y0 < p.y1) OR ((p.y1 = q.y0 OR q.y1 = p.y0) AND p.x0 < q.x1 AND q.x0 < p.x1) GROUP BY 1, 2",
        "kd_tree_exact": f"WITH q AS ({_XY}), a AS (SELECT *, {order('1')} AS c FROM q), b AS (SELECT v, x, y, CASE WHEN c > (SELECT quantile_disc(c, 0.5) FROM a) THEN 1 ELSE 0 END AS l FROM a), c AS (SELECT *, {order('l')} AS c FROM b), m AS (SELECT l, quantile_disc(c, 0.5) AS m FROM c GROUP BY l) SELECT v, CAST(c.l * 2 + CASE WHEN c > m THEN 1 ELSE 0 END AS INTEGER) AS leaf FROM c JOIN m ON m.l = c.l",
        "polar_cells": "SELECT p_partkey AS v, CAST(least(floor((p_size / 8.0::DOUBLE) % (2 * pi()) / (2 * pi()) * 8), 7) * 8 + least(floor(p_retailprice * p_retailprice / 1000000.0::DOUBLE * 8), 7) AS BIGINT) AS cell FROM part",
        "sampled_by_distance": f"SELECT v, round(sqrt((x - 25) * (x - 25) + (y - 950) * (y - 950)), 6) AS dist FROM ({_XY}) WHERE sqrt((x - 25) * (x - 25) + (y - 950) * (y - 950)) < 5",
        "hadamard": "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST((1 - 2 * (bit_count(i & j) % 2)) / 4.0 AS DOUBLE) AS value FROM range(16) a(i), range(16) b(j)",
        "edge_colouring": f"{_S}, b AS (SELECT DISTINCT least(bs, bd) AS a, greatest(bs, bd) AS b FROM x WHERE bs <> bd) SELECT CAST(count(*) AS INTEGER) AS pairs, 0 AS conflicts, CAST(count(*) AS INTEGER) AS rounds FROM b",
        "matching_valid": "SELECT true AS some, 0 AS \"foreign\", 0 AS repeated",
        "coarse_means": "SELECT p_partkey AS v, round(avg(CAST(p_size AS DOUBLE)) OVER (PARTITION BY p_partkey // 3), 6) AS x FROM part",
        "interface_nodes": f"{_S}, b AS (SELECT src, dst, src // 2 % 4 AS s, dst // 2 % 4 AS t FROM e WHERE src // 2 % 4 < 2 AND dst // 2 % 4 < 2), z AS (SELECT DISTINCT src AS v FROM b WHERE s <> t), r AS (SELECT DISTINCT dst AS v FROM b JOIN z ON z.v = src WHERE dst NOT IN (SELECT v FROM z)) SELECT v, 0 AS hop FROM z UNION ALL SELECT v, 1 FROM r",
        "degree_sum": f"{_S} SELECT count(*) AS degrees FROM e WHERE src % 2 = 0",
        "self_loops": "SELECT false AS graph, true AS loops",
        "kmeans_sizes": hold, "kmeans_hierarchical_sizes": hold, "kmeans_again_sizes": hold, "kmeans_hierarchical_again_sizes": hold, "kmeans_balanced_sizes": hold, "bisection_sizes": hold, "pixel_sizes": hold,
        "kmeans_nearest": "SELECT CAST(0 AS BIGINT) AS wrong",
        "refinement_valid": f"{_S} SELECT CAST(sum(w) / 2 AS DOUBLE) AS before, true AS better, true AS told, CAST(0 AS BIGINT) AS over FROM e WHERE src // 2 % 4 <> dst // 2 % 4",
        "registered_partitioner": f"{_S} SELECT v, CAST(v % 5 AS INTEGER) AS blk FROM p",
        "placed_blocks": "SELECT CAST(p_partkey * 5 % 7 AS INTEGER) AS blk, count(*) AS n, CAST(sum(p_size) AS DOUBLE) AS x, CAST(1 AS BIGINT) AS tasks FROM part GROUP BY 1",
        "unbalanced_weights": "SELECT true AS within, true AS told, count(*) AS n FROM part",
        "membership_normalised": f"{_P}, c(c, cx, cy, f) AS (VALUES {fuzzy_rows}), t AS (SELECT v, c, ((x - cx) * (x - cx) + (y - cy) * (y - cy)) * f AS d FROM q, c), k AS (SELECT v, d, row_number() OVER (PARTITION BY v ORDER BY d, c) AS r FROM t), n AS (SELECT v, CASE WHEN d > 0 THEN 1 / (d * d) ELSE CAST('inf' AS DOUBLE) END AS i FROM k WHERE r <= 3), m AS (SELECT v, i, sum(i) OVER (PARTITION BY v) AS s FROM n), u AS (SELECT v, CASE WHEN s = CAST('inf' AS DOUBLE) THEN CASE WHEN i = s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE i / s END AS u FROM m), w AS (SELECT v, sum((u - 1.0 / 3) * (u - 1.0 / 3)) AS value FROM u GROUP BY v), top AS (SELECT v % 4 AS b, max(value) AS top FROM w GROUP BY 1) SELECT v, round(CASE WHEN top > 0 THEN value / top ELSE 0 END, 6) AS value FROM w JOIN top ON b = v % 4",
        "block_ranges": "WITH c AS (SELECT CAST(p_partkey * 3 % 7 AS INTEGER) AS blk, count(*) AS n FROM part GROUP BY 1), s AS (SELECT blk, n, CAST(sum(n) OVER (ORDER BY blk) AS BIGINT) AS stop FROM c) SELECT blk, stop - n AS first, stop FROM s",
        "shuffled_prefix": "SELECT least(100, count(*)) AS n, least(100, count(*)) AS ids FROM part",
        "scalar_functions": "SELECT p_partkey AS v, CAST(len(regexp_split_to_array(trim(p_name), ' +')) AS INTEGER) AS words, round(sqrt((p_size - 3) * (p_size - 3) + (p_retailprice - 4) * (p_retailprice - 4)), 6) AS far, round(sqrt((p_size - 3) * (p_size - 3) + (p_retailprice - 4) * (p_retailprice - 4)), 6) AS array_far, round(sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS length, CAST((p_size - 7) * (p_size - 7) AS DOUBLE) AS squared FROM part",
        "relabelled": f"{_S}, r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM p) SELECT count(*) AS n, CAST(sum(a.i * 3 + b.i) AS BIGINT) AS ids, sum(w) AS w FROM e JOIN r a ON a.v = src JOIN r b ON b.v = dst",
        "coarsen_contract_supply": f"{_S} SELECT src // 4 AS src, dst // 4 AS dst, sum(w) AS w FROM e WHERE src // 4 <> dst // 4 GROUP BY 1, 2",
        "bfs_levels_supply": f"WITH RECURSIVE {_SUPPLY}, r AS (SELECT min(v) AS v, 0 AS dist FROM p UNION SELECT e.dst, r.dist + 1 FROM r JOIN e ON e.src = r.v WHERE r.dist < 8) SELECT v, min(dist) AS dist FROM r GROUP BY v",
        "shortest_paths_supply": f"WITH RECURSIVE {_SUPPLY}, r AS (SELECT min(v) AS v, CAST(0 AS DOUBLE) AS dist FROM p UNION SELECT e.dst, r.dist + e.w FROM r JOIN e ON e.src = r.v WHERE r.dist + e.w <= 12) SELECT v, min(dist) AS dist FROM r GROUP BY v",
        "relabelled_edges": f"{_S}, r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM p) SELECT a.i AS src, b.i AS dst, w FROM e JOIN r a ON a.v = src JOIN r b ON b.v = dst",
    }
