"""Queries of the partitioning operators on the driver's tables, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import hilbert, scalars
from gridloom.operators import diffusion, graph, kmeans, metrics, multilevel, multisection, pixel, ranks, sfc, spatial, topology
from gridloom.plans import catalogue_more
from gridloom.plans.fixtures import embedding_points, order_points, order_points_3d, part_points, supply_blocks, supply_graph, supply_partition, supply_points
from gridloom.plans.run import heatmap, partition_graph
from gridloom.settings import Settings
from gridloom.sources import generate

K = 8
CENTRES = [(5.0, 910.0), (15.0, 930.0), (25.0, 950.0), (35.0, 970.0), (45.0, 990.0)]
INFLUENCE = [1.0, 1.25, 0.75, 1.5, 1.0]
BOX = ([0.0, 0.0, 0.0], [500000.0, 2500.0, 101.0])


def _clusters() -> kmeans.Clusters:
    return kmeans.Clusters(np.array(CENTRES), np.array([INFLUENCE]), np.zeros(len(CENTRES), dtype=np.int32))


def _both(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return supply_graph(s, d), supply_partition(s, d, K)


def _part_blocks(s: SparkSession, d: str, k: int = 4) -> DataFrame:
    return part_points(s, d).select("v", (F.col("v") % k).cast("int").alias("blk"))


def _grid(s: SparkSession):
    return generate.grid(s, (32, 32))


def _grid_blocks(s: SparkSession) -> DataFrame:
    v, _ = _grid(s)
    return v.select("v", (F.floor(F.col("x") / 16) * 2 + F.floor(F.col("y") / 16)).cast("int").alias("blk"))


def _flagship(s: SparkSession, d: str) -> DataFrame:
    """Metrics of the supply graph under blocks by id: the two joins and grouped sums that every quality check runs."""
    e, p = _both(s, d)
    return metrics.easy_metrics(e, p, K).select("metric", F.round("value", 6).alias("value"))


def _sizes(part: DataFrame) -> DataFrame:
    return part.groupBy("blk").agg(F.count("*").alias("n"))


def _laplacian_rows(s: SparkSession, d: str) -> DataFrame:
    return graph.laplacian(supply_graph(s, d)).groupBy("row").agg(F.count("*").alias("entries"), F.sum("value").alias("total"), F.max("value").alias("diagonal"))


def _kmeans(s: SparkSession, d: str) -> DataFrame:
    return _sizes(kmeans.kmeans_partition(order_points(s, d), ["x", "y"], K, settings=Settings(num_blocks=K, min_sampling_nodes=-1))[0])


def _fuzzy(s: SparkSession, d: str) -> DataFrame:
    return kmeans.fuzzify(part_points(s, d), ["x", "y"], _clusters(), 3)


def _tree(s: SparkSession) -> DataFrame:
    rows = [((a, b, c), [float(a + b + c + 1), float(2 * a + c + 1)]) for a in range(2) for b in range(3) for c in range(2)]
    return topology.from_leaves(s, rows)


def _refined(s: SparkSession, d: str) -> DataFrame:
    v, e = supply_points(s, d), supply_graph(s, d)
    out, _ = multilevel.refine(v, e, supply_blocks(s, d), 4, np.full(4, v.count() / 4 * 1.03), Settings(num_blocks=4, min_border_nodes=3))
    return graph.edge_cut(e, out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    grid_cut = lambda f: lambda s, d: f(_grid(s)[1], _grid_blocks(s))
    return {
        "flagship": _flagship,
        "easy_metrics": _flagship,
        "edge_cut": lambda s, d: graph.edge_cut(*_both(s, d)),
        "edge_cut_unweighted": lambda s, d: graph.edge_cut(*_both(s, d), weighted=False),
        "edge_cut_grid": grid_cut(graph.edge_cut),
        "imbalance_unweighted": lambda s, d: graph.imbalance(_part_blocks(s, d, 3), 3).select(F.round("imbalance", 9).alias("imbalance")),
        "imbalance_weighted": lambda s, d: graph.imbalance(_part_blocks(s, d), 4, part_points(s, d)).select(F.round("imbalance", 9).alias("imbalance")),
        "imbalance_targets": lambda s, d: graph.imbalance(_part_blocks(s, d), 4, part_points(s, d), "w0", s.createDataFrame([(b, 1000.0 * (b + 1)) for b in range(4)], "blk int, target double")).select(F.round("imbalance", 9).alias("imbalance")),
        "block_weights": lambda s, d: graph.block_weights(_part_blocks(s, d), 5, part_points(s, d)),
        "border_nodes": lambda s, d: graph.border_nodes(*_both(s, d)),
        "border_vertices": lambda s, d: graph.border_vertices(*_both(s, d)),
        "border_counts": lambda s, d: graph.border_counts(*_both(s, d), K),
        "comm_volume": lambda s, d: graph.communication_volume(*_both(s, d), K),
        "communication": lambda s, d: graph.communication(*_both(s, d), K),
        "foreign_neighbours": lambda s, d: graph.foreign_neighbours(*_both(s, d)).groupBy("blk").agg(F.count("*").alias("n"), F.sum("v").alias("ids")),
        "block_graph": lambda s, d: graph.block_graph(*_both(s, d)),
        "owner_graph": lambda s, d: graph.owner_graph(*_both(s, d)),
        "block_degree": lambda s, d: graph.block_graph_degree(*_both(s, d)),
        "outgoing_weight": lambda s, d: graph.outgoing_weight(*_both(s, d)),
        "degrees": lambda s, d: graph.degrees(supply_graph(s, d)),
        "max_degree": lambda s, d: graph.max_degree(supply_graph(s, d)),
        "edge_symmetry": lambda s, d: graph.asymmetric(supply_graph(s, d).filter("src % 5 <> 1")).groupBy((F.col("src") % 4).alias("m")).agg(F.count("*").alias("n")),
        "symmetrised_edges": lambda s, d: graph.symmetrised(s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_partkey") + 1).alias("u"), (F.col("l_suppkey") + 1).alias("v"))),
        "laplacian": _laplacian_rows,
        "laplacian_definite": lambda s, d: graph.laplacian(supply_graph(s, d), 1.1).filter("row = col").select("row", F.round("value", 6).alias("value")),
        "edge_imbalance": lambda s, d: metrics.edge_imbalance(*_both(s, d), K).select(F.round("edgeImbalance", 9).alias("edgeImbalance")),
        "redistribution_volume": lambda s, d: metrics.redistribution_volume(supply_partition(s, d, K), supply_graph(s, d).select(F.col("src").alias("v")).distinct().select("v", (F.floor(F.col("v") / 3) % K).cast("int").alias("blk"))),
        "spmv": lambda s, d: metrics.spmv(supply_graph(s, d), supply_graph(s, d).select(F.col("src").alias("v")).distinct().withColumn("x", (F.col("v") % 7).cast("double"))),
        "bfs_levels": lambda s, d: graph.bfs(_grid(s)[1].filter("(src + dst) % 5 <> 0"), s.createDataFrame([(0,)], "v long")),
        "shortest_paths": lambda s, d: graph.shortest_paths(generate.grid(s, (10, 10))[1].withColumn("w", ((F.col("src") * F.col("dst")) % 5 + 1).cast("double")), 0).select("v", "dist"),
        "relabelled": lambda s, d: graph.relabelled(supply_graph(s, d).select(F.col("src").alias("v")).distinct(), supply_graph(s, d))[1].agg(F.count("*").alias("n"), F.sum(F.col("src") * 3 + F.col("dst")).alias("ids"), F.sum("w").alias("w")),
        "grid2d": lambda s, d: _grid(s)[0],
        "grid2d_edges": lambda s, d: _grid(s)[1],
        "grid3d": lambda s, d: generate.grid(s, (7, 5, 4), (14.0, 5.0, 8.0))[0],
        "grid3d_edges": lambda s, d: generate.grid(s, (7, 5, 4))[1],
        "hilbert2d": lambda s, d: hilbert.with_hilbert(order_points(s, d), ["x", "y"], 9, ([0.0, 0.0], BOX[1][:2])).select("v", "h"),
        "hilbert3d": lambda s, d: hilbert.with_hilbert(order_points_3d(s, d), ["x", "y", "z"], 7, BOX).select("v", "h"),
        "sfc_partition": lambda s, d: sfc.sfc_partition(order_points(s, d), ["x", "y"], K, 9, box=([0.0, 0.0], BOX[1][:2])),
        "sfc_centers": lambda s, d: sfc.curve_centres(order_points(s, d), ["x", "y"], 16).select("i", "v", "x", "y"),
        "sfc_renumber": lambda s, d: sfc.curve_renumbering(part_points(s, d), part_points(s, d).select("v", (F.floor(F.col("x") / 13) * 2 + F.when(F.col("y") > 950, 1).otherwise(0)).cast("int").alias("blk")), ["x", "y"], 6),
        "prefix_sum": lambda s, d: ranks.with_prefix_sum(part_points(s, d).select("v", "w0"), "w0", ["v"]).select("v", "prefix"),
        "sampling_order": lambda s, d: graph.sampling_order(part_points(s, d).select("v"), 20),
        "kmeans_step": lambda s, d: kmeans.assign(kmeans.prepared(part_points(s, d), ["x", "y"]), _clusters()),
        "block_centers": lambda s, d: kmeans.block_centres(part_points(s, d), _part_blocks(s, d), ["x", "y"], ["w0"]).select("blk", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")),
        "fuzzy_topk": lambda s, d: _fuzzy(s, d).select("v", F.transform("near", lambda n: n["c"]).alias("centres")).select("v", F.array_join("centres", ",").alias("centres")),
        "membership": lambda s, d: kmeans.membership(_fuzzy(s, d)).select("v", F.posexplode("member").alias("pos", "u")).select("v", F.col("pos").cast("int").alias("pos"), F.round("u", 6).alias("u")),
        "membership_value": lambda s, d: kmeans.membership_value(kmeans.membership(_fuzzy(s, d))).select("v", F.round("value", 6).alias("value")),
        "histogram1d": lambda s, d: part_points(s, d).groupBy("x").agg(F.sum("w0").alias("w")),
        "bbox_weight": lambda s, d: multisection.box_weight(part_points(s, d), ["x", "y"], [10, 920], [30, 960], "w0"),
        "pixel_density": lambda s, d: pixel.density(order_points(s, d), ["x", "y"], 10, ([0.0, 0.0], BOX[1][:2])),
        "pixel_graph": lambda s, d: pixel.pixel_graph(*_grid(s), ["x", "y"], 4)[1],
        "heatmap": lambda s, d: heatmap(part_points(s, d), 8),
        "tree_levels": lambda s, d: topology.tree_nodes(_tree(s)).select("height", F.array_join(F.transform("label", lambda x: x.cast("string")), ".").alias("label"), F.col("weights")[0].alias("w0"), F.col("weights")[1].alias("w1"), "cores", "children"),
        "tree_distance": lambda s, d: topology.tree_graph(_tree(s), [1, 2, 3]),
        "tree_adapted": lambda s, d: topology.adapt_weights(_tree(s), [1000.0, 1.0], [True, False]).select("leaf_id", F.round(F.col("weights")[0], 6).alias("w0"), F.col("weights")[1].alias("w1")),
        "coarsen_contract": lambda s, d: multilevel.contract(_grid(s)[1], _grid(s)[0].select("v", F.floor(F.col("v") / 4).cast("long").alias("c"))),
        "coarse_sums": lambda s, d: multilevel.to_coarse(part_points(s, d).select("v", "w0"), part_points(s, d).select("v", (F.col("v") % 17).alias("c")), "w0", "sum"),
        "matching_edge_rating": lambda s, d: multilevel.rated(supply_graph(s, d), supply_graph(s, d).select(F.col("src").alias("v")).distinct().withColumn("w0", (F.col("v") % 3 + 1).cast("double"))).groupBy("src").agg(F.round(F.max("rating"), 6).alias("best")),
        "nearest_partner": lambda s, d: multilevel.nearest_partner(_grid(s)[1], _grid(s)[0].withColumn("x", F.col("x") + (F.col("v") * 7 % 11) / 100.0).withColumn("y", F.col("y") + (F.col("v") * 5 % 13) / 100.0), ["x", "y"]),
        "centre_distances": lambda s, d: multilevel.centre_distances(part_points(s, d), _part_blocks(s, d), ["x", "y"]).select("v", F.round("dist", 6).alias("dist")),
        "radius_query": lambda s, d: spatial.within_radius(part_points(s, d), part_points(s, d).filter("v % 50 = 0").withColumnRenamed("v", "q"), ["x", "y"], 3.0).select("q", "v", F.round("dist", 6).alias("dist")),
        "drifted_weights": lambda s, d: diffusion.drifted_weights(part_points(s, d), ["x", "y"], [10.0, 920.0], 2.0).select("v", F.round("w0", 6).alias("w0")),
        "box_distances": lambda s, d: part_points(s, d).select("v", *[F.round(c, 6).alias(n) for c, n in zip(scalars.box_distances([F.col("x"), F.col("y")], [F.lit(10.0), F.lit(920.0)], [F.lit(20.0), F.lit(940.0)]), ("near", "far"), strict=True)]),
        "grid_positions": lambda s, d: s.range(240).select(F.col("id").alias("v"), *[c.alias(n) for c, n in zip(scalars.grid_position(F.col("id"), (4, 6, 10)), "ijk", strict=True)], scalars.cell_l1(F.col("id"), F.lit(17), 16).cast("long").alias("l1")),
        "random_points": lambda s, d: generate.random_points(s, 1000, 2, 5.0, 3).agg(F.count("*").alias("n"), F.max(F.greatest("x", "y") <= 5.0).alias("inside")),
        # No SQL for what follows: iterations and sequential kernels, whose invariants tests/ check.
        "kmeans_partition": _kmeans,
        "kmeans_embeddings": lambda s, d: _sizes(kmeans.kmeans_partition(embedding_points(s, d), ["x"], 5, settings=Settings(num_blocks=5, min_sampling_nodes=-1))[0]),
        "hierarchical_kmeans": lambda s, d: _sizes(kmeans.hierarchical(part_points(s, d), ["x", "y"], [2, 4], settings=Settings(min_sampling_nodes=-1))),
        "multisection": lambda s, d: _sizes(multisection.multisection(order_points(s, d), ["x", "y"], 16)[0]),
        "coordinate_bisection": lambda s, d: _sizes(multisection.coordinate_bisection(order_points(s, d), ["x", "y"], 7)),
        "pixel_partition": lambda s, d: _sizes(pixel.pixel_partition(order_points(s, d), ["x", "y"], 4)),
        "spectral_partition": lambda s, d: _sizes(pixel.spectral_partition(supply_points(s, d), supply_graph(s, d), ["x", "y"], 4, 8)),
        "quadtree": lambda s, d: spatial.tree_statistics(spatial.quadtree(order_points(s, d), ["x", "y"], 64)[1], 2),
        "kd_tree": lambda s, d: spatial.kd_tree(order_points(s, d), ["x", "y"], 4).groupBy("leaf").agg(F.count("*").alias("n")),
        "matching": lambda s, d: multilevel.matching(supply_graph(s, d), supply_points(s, d)),
        "refinement": _refined,
        "block_diameter": lambda s, d: graph.block_diameter(supply_graph(s, d), supply_blocks(s, d)),
        "pipeline_partition": lambda s, d: partition_graph(supply_points(s, d), supply_graph(s, d), Settings(num_blocks=4, dimensions=2, tool="geosfc", no_refinement=False, multilevel_rounds=1)).groupBy("blk").agg(F.count("*").alias("n")),
        # The whole tables, where the query of the plain name and its SQL have a grid.
        "bfs_levels_supply": lambda s, d: graph.bfs(supply_graph(s, d), supply_points(s, d).agg(F.min("v").alias("v"))),
        "shortest_paths_supply": lambda s, d: graph.shortest_paths(supply_graph(s, d), supply_points(s, d).agg(F.min("v")).first()[0]).select("v", "dist"),
        "pixel_graph_supply": lambda s, d: pixel.pixel_graph(supply_points(s, d), supply_graph(s, d), ["x", "y"], 4)[1],
        "coarsen_contract_supply": lambda s, d: multilevel.contract(supply_graph(s, d), supply_points(s, d).select("v", F.floor(F.col("v") / 4).cast("long").alias("c"))),
        "nearest_partner_supply": lambda s, d: multilevel.nearest_partner(supply_graph(s, d), supply_points(s, d), ["x", "y"]),
        # All ids divisible by 20, and all edges, where the query of the plain name and its SQL take some.
        "radius_query_20": lambda s, d: spatial.within_radius(part_points(s, d), part_points(s, d).filter("v % 20 = 0").withColumnRenamed("v", "q"), ["x", "y"], 3.0).select("q", "v", F.round("dist", 6).alias("dist")),
        "edge_symmetry_all": lambda s, d: graph.asymmetric(supply_graph(s, d)).groupBy((F.col("src") % 4).alias("m")).agg(F.count("*").alias("n")),
        **catalogue_more.queries(),
    }


_SUPPLY = """
sup AS (SELECT l_partkey * 2 AS p, l_suppkey * 2 + 1 AS s, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2),
e AS (SELECT p AS src, s AS dst, w FROM sup UNION ALL SELECT s, p, w FROM sup),
p AS (SELECT DISTINCT src AS v, CAST(src % 8 AS INTEGER) AS blk FROM e),
x AS (SELECT e.src, e.dst, e.w, a.blk AS bs, b.blk AS bd FROM e JOIN p a ON a.v = e.src JOIN p b ON b.v = e.dst)
"""
_S = f"WITH {_SUPPLY}"
_PART = "SELECT p_partkey AS v, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(p_size AS DOUBLE) AS w0 FROM part"
_P = f"WITH q AS ({_PART})"
_ORDERS = "SELECT o_orderkey AS v, o_totalprice AS x, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y, CAST(o_custkey % 101 AS DOUBLE) AS z FROM orders"
_GRID_V = "g AS (SELECT i AS v, i // 32 AS r, i % 32 AS c FROM range(1024) t(i))"
_GRID = f"{_GRID_V}, e AS (SELECT a.v AS src, b.v AS dst, CAST(1.0 AS DOUBLE) AS w FROM g a JOIN g b ON abs(a.r - b.r) + abs(a.c - b.c) = 1)"


def _moves_sql(dims: int, names: str) -> tuple[str, list[str]]:
    """CASE expressions of the curve's digit and new coordinates."""
    digit, axes = "CASE", ["CASE"] * dims
    for half, (d, moves) in hilbert.cells(dims).items():
        when = " AND ".join(f"{n} {'>=' if h else '<'} 0.5" for n, h in zip(names, half, strict=True))
        digit += f" WHEN {when} THEN {d}"
        for i, (a, f, o) in enumerate(moves):
            axes[i] += f" WHEN {when} THEN {names[a]} * {f}.0 + {float(o)}"
    return f"{digit} END", [f"{a} END" for a in axes]


def _hilbert_sql(dims: int, depth: int, then: str, low=None, high=None, points: str = _ORDERS, before: str = "") -> str:
    """SQL with the CTE hb(v, h); ``then`` follows. Doubles are written as casts, as plain literals are decimals."""
    names = "xyz"[:dims]
    digit, axes = _moves_sql(dims, names)
    if low is None:
        scale = ", ".join(f"(CAST({n} AS DOUBLE) - (SELECT min({n}) FROM q)) / ((SELECT max({n}) FROM q) - (SELECT min({n}) FROM q)) AS {n}" for n in names)
    else:
        scale = ", ".join(f"(CAST({n} AS DOUBLE) - {lo}::DOUBLE) / {float(hi - lo)}::DOUBLE AS {n}" for n, lo, hi in zip(names, low, high, strict=False))
    return f"""WITH RECURSIVE q AS ({points}), {before} r AS (
  SELECT v, {scale}, 0 AS lv, CAST(0 AS BIGINT) AS h FROM q
  UNION ALL
  SELECT v, {", ".join(f"CAST({a} AS DOUBLE) AS {n}" for a, n in zip(axes, names, strict=True))}, lv + 1, h * {1 << dims} + {digit} FROM r WHERE lv < {depth}
), hb AS (SELECT v, h FROM r WHERE lv = {depth}) {then}"""


def _centre_sql() -> str:
    rows = ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE, {f}::DOUBLE)" for i, ((x, y), f) in enumerate(zip(CENTRES, INFLUENCE, strict=True)))
    return f"c(c, cx, cy, f) AS (VALUES {rows}), t AS (SELECT v, c, ((x - cx) * (x - cx) + (y - cy) * (y - cy)) * f AS d FROM q, c), k AS (SELECT v, c, d, row_number() OVER (PARTITION BY v ORDER BY d, c) AS r FROM t)"


def oracle_sql() -> dict[str, str]:
    easy = """, b AS (SELECT blk, count(*) AS n FROM p GROUP BY 1),
cm AS (SELECT bs, src, count(DISTINCT bd) AS c FROM x WHERE bs <> bd GROUP BY 1, 2),
pb AS (SELECT b.blk, b.n, coalesce(sum(c), 0) AS vol, count(c) AS bor FROM b LEFT JOIN cm ON cm.bs = b.blk GROUP BY 1, 2),
bg AS (SELECT bs, count(DISTINCT bd) AS d FROM x WHERE bs <> bd GROUP BY 1)
SELECT 'finalCut' AS metric, round(CAST(sum(w) / 2 AS DOUBLE), 6) AS value FROM x WHERE bs <> bd
UNION ALL SELECT 'finalImbalance', round(CAST((max(n) - sum(n) / 8) / (sum(n) / 8) AS DOUBLE), 6) FROM b
UNION ALL SELECT 'maxCommVolume', CAST(max(vol) AS DOUBLE) FROM pb UNION ALL SELECT 'totalCommVolume', CAST(sum(vol) AS DOUBLE) FROM pb
UNION ALL SELECT 'maxBoundaryNodes', CAST(max(bor) AS DOUBLE) FROM pb UNION ALL SELECT 'totalBoundaryNodes', CAST(sum(bor) AS DOUBLE) FROM pb
UNION ALL SELECT 'maxBorderNodesPercent', round(max(bor / n), 6) FROM pb UNION ALL SELECT 'avgBorderNodesPercent', round(avg(bor / n), 6) FROM pb
UNION ALL SELECT 'maxBlockGraphDegree', CAST(max(d) AS DOUBLE) FROM bg UNION ALL SELECT 'totalBlockGraphEdges', CAST(sum(d) // 2 AS DOUBLE) FROM bg"""
    border = "SELECT p.v, p.blk, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.src = p.v AND x.bs <> x.bd) THEN 1 ELSE 0 END AS border FROM p"
    tree = "t(leaf_id, a, b, c, w0, w1) AS (SELECT CAST(i AS INTEGER), CAST(i // 6 AS INTEGER), CAST(i // 2 % 3 AS INTEGER), CAST(i % 2 AS INTEGER), CAST(i // 6 + i // 2 % 3 + i % 2 + 1 AS DOUBLE), CAST(2 * (i // 6) + i % 2 + 1 AS DOUBLE) FROM range(12) r(i))"
    fuzzy = f"{_P}, {_centre_sql()}"
    member = f"{fuzzy}, n AS (SELECT v, r, CASE WHEN d > 0 THEN 1 / (d * d) ELSE CAST('inf' AS DOUBLE) END AS i FROM k WHERE r <= 3), m AS (SELECT v, r, i, list_sum(list(i) OVER (PARTITION BY v ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS s FROM n), u AS (SELECT v, r, CASE WHEN s = CAST('inf' AS DOUBLE) THEN CASE WHEN i = s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE i / s END AS u FROM m)"
    grid3 = "g AS (SELECT i AS v, i // 20 AS a, i // 4 % 5 AS b, i % 4 AS c FROM range(140) t(i))"
    return {
        "flagship": f"{_S}{easy}",
        "easy_metrics": f"{_S}{easy}",
        "edge_cut": f"{_S} SELECT CAST(coalesce(sum(w), 0) / 2 AS DOUBLE) AS cut FROM x WHERE bs <> bd",
        "edge_cut_unweighted": f"{_S} SELECT CAST(count(*) / 2 AS DOUBLE) AS cut FROM x WHERE bs <> bd",
        "edge_cut_grid": f"WITH {_GRID} SELECT CAST(sum(w) / 2 AS DOUBLE) AS cut FROM e JOIN g a ON a.v = src JOIN g b ON b.v = dst WHERE (a.r // 16, a.c // 16) <> (b.r // 16, b.c // 16)",
        "imbalance_unweighted": "SELECT round(CAST((max(n) - sum(n) / 3) / (sum(n) / 3) AS DOUBLE), 9) AS imbalance FROM (SELECT count(*) AS n FROM part GROUP BY p_partkey % 3)",
        "imbalance_weighted": "WITH b AS (SELECT sum(p_size) AS w FROM part GROUP BY p_partkey % 4), o AS (SELECT (SELECT sum(w) FROM b) / 4 + (SELECT max(p_size) - min(p_size) FROM part) AS o) SELECT round(CAST(((SELECT max(w) FROM b) - o) / o AS DOUBLE), 9) AS imbalance FROM o",
        "imbalance_targets": "SELECT round(CAST(max((w - t) / t) AS DOUBLE), 9) AS imbalance FROM (SELECT sum(p_size) AS w, 1000.0 * (p_partkey % 4 + 1) AS t FROM part GROUP BY p_partkey % 4)",
        "block_weights": "SELECT CAST(b AS INTEGER) AS blk, CAST(coalesce(sum(p_size), 0) AS DOUBLE) AS weight FROM range(5) t(b) LEFT JOIN part ON p_partkey % 4 = b GROUP BY b",
        "border_nodes": f"{_S} SELECT v, border FROM ({border})",
        "border_vertices": f"{_S} SELECT DISTINCT src AS v FROM x WHERE bs <> bd",
        "border_counts": f"{_S} SELECT blk, CAST(sum(border) AS BIGINT) AS border, CAST(sum(1 - border) AS BIGINT) AS \"inner\" FROM ({border}) GROUP BY blk",
        "comm_volume": f"{_S} SELECT CAST(b AS INTEGER) AS blk, count(DISTINCT (src, bd)) AS volume FROM range(8) t(b) LEFT JOIN x ON bs = b AND bs <> bd GROUP BY b",
        "communication": f"{_S}, v AS (SELECT bs, count(DISTINCT (src, bd)) AS volume, count(DISTINCT src) AS border FROM x WHERE bs <> bd GROUP BY 1) SELECT p.blk, coalesce(max(volume), 0) AS volume, coalesce(max(border), 0) AS border, count(*) - coalesce(max(border), 0) AS \"inner\" FROM p LEFT JOIN v ON bs = blk GROUP BY 1",
        "foreign_neighbours": f"{_S} SELECT bs AS blk, count(*) AS n, CAST(sum(dst) AS BIGINT) AS ids FROM x WHERE bs <> bd GROUP BY 1",
        "block_graph": f"{_S} SELECT bs, bd, sum(w) AS w FROM x WHERE bs <> bd GROUP BY 1, 2",
        "owner_graph": f"{_S} SELECT bs, bd, CAST(count(*) AS DOUBLE) AS w FROM x WHERE bs <> bd GROUP BY 1, 2",
        "block_degree": f"{_S}, bg AS (SELECT bs, count(DISTINCT bd) AS d FROM x WHERE bs <> bd GROUP BY 1) SELECT max(d) AS max_degree, CAST(sum(d) // 2 AS BIGINT) AS edges FROM bg",
        "outgoing_weight": f"{_S} SELECT bs AS blk, sum(w) AS out FROM x WHERE bs <> bd GROUP BY 1",
        "degrees": f"{_S} SELECT src AS v, count(*) AS degree FROM e GROUP BY 1",
        "max_degree": f"{_S} SELECT max(n) AS max_degree FROM (SELECT count(*) AS n FROM e GROUP BY src)",
        "edge_symmetry": f"{_S}, f AS (SELECT * FROM e WHERE src % 5 <> 1) SELECT src % 4 AS m, count(*) AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.src = f.dst AND g.dst = f.src) GROUP BY 1",
        "symmetrised_edges": "WITH r AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT DISTINCT src, dst, CAST(1.0 AS DOUBLE) AS w FROM (SELECT a AS src, b AS dst FROM r UNION ALL SELECT b, a FROM r) WHERE src <> dst",
        "laplacian": f"{_S} SELECT src AS row, count(*) + 1 AS entries, CAST(0 AS DOUBLE) AS total, sum(w) AS diagonal FROM e GROUP BY 1",
        "laplacian_definite": f"{_S} SELECT src AS row, round(sum(w) * 1.1::DOUBLE, 6) AS value FROM e GROUP BY 1",
        "edge_imbalance": f"{_S} SELECT round(CAST(max(n) / (sum(n) / 8) - 1 AS DOUBLE), 9) AS \"edgeImbalance\" FROM (SELECT count(*) AS n FROM x GROUP BY bs)",
        "redistribution_volume": f"{_S}, m AS (SELECT blk AS a, v // 3 % 8 AS b FROM p WHERE blk <> v // 3 % 8) SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM m GROUP BY a UNION ALL SELECT count(*) FROM m GROUP BY b)) AS max, (SELECT count(*) FROM m) AS total",
        "spmv": f"{_S} SELECT src AS v, sum(w * (dst % 7)) + src % 7 AS y FROM e GROUP BY src",
        "bfs_levels": f"WITH RECURSIVE {_GRID}, f AS (SELECT * FROM e WHERE (src + dst) % 5 <> 0), r AS (SELECT CAST(0 AS BIGINT) AS v, 0 AS dist UNION SELECT f.dst, r.dist + 1 FROM r JOIN f ON f.src = r.v WHERE r.dist < 200) SELECT v, min(dist) AS dist FROM r GROUP BY v",
        "shortest_paths": "WITH RECURSIVE g AS (SELECT i AS v, i // 10 AS r, i % 10 AS c FROM range(100) t(i)), e AS (SELECT a.v AS src, b.v AS dst, CAST(a.v * b.v % 5 + 1 AS DOUBLE) AS w FROM g a JOIN g b ON abs(a.r - b.r) + abs(a.c - b.c) = 1), p AS (SELECT CAST(0 AS BIGINT) AS v, CAST(0 AS DOUBLE) AS dist UNION SELECT e.dst, p.dist + e.w FROM p JOIN e ON e.src = p.v WHERE p.dist + e.w <= 60) SELECT v, min(dist) AS dist FROM p GROUP BY v",
        "grid2d": f"WITH {_GRID_V} SELECT v, CAST(r AS DOUBLE) AS x, CAST(c AS DOUBLE) AS y, CAST(1.0 AS DOUBLE) AS w0 FROM g",
        "grid2d_edges": f"WITH {_GRID} SELECT * FROM e",
        "grid3d": f"WITH {grid3} SELECT v, CAST(a * 2.0 AS DOUBLE) AS x, CAST(b AS DOUBLE) AS y, CAST(c * 2.0 AS DOUBLE) AS z, CAST(1.0 AS DOUBLE) AS w0 FROM g",
        "grid3d_edges": f"WITH {grid3} SELECT p.v AS src, q.v AS dst, CAST(1.0 AS DOUBLE) AS w FROM g p JOIN g q ON abs(p.a - q.a) + abs(p.b - q.b) + abs(p.c - q.c) = 1",
        "hilbert2d": _hilbert_sql(2, 9, "SELECT v, h FROM hb", *[b[:2] for b in BOX]),
        "hilbert3d": _hilbert_sql(3, 7, "SELECT v, h FROM hb", *BOX),
        "sfc_partition": _hilbert_sql(2, 9, "SELECT v, CAST((row_number() OVER (ORDER BY h, v) - 1) * 8 // (SELECT count(*) FROM hb) AS INTEGER) AS blk FROM hb", *[b[:2] for b in BOX]),
        "sfc_centers": _hilbert_sql(2, 9, ", k AS (SELECT v, row_number() OVER (ORDER BY h, v) - 1 AS r, count(*) OVER () AS n FROM hb) SELECT CAST((r - n // 16 // 2) // (n // 16) AS INTEGER) AS i, v, q.x, q.y FROM k JOIN q USING (v) WHERE r >= n // 16 // 2 AND (r - n // 16 // 2) % (n // 16) = 0 AND (r - n // 16 // 2) // (n // 16) < 16"),
        "prefix_sum": f"{_P} SELECT v, sum(w0) OVER (ORDER BY v) AS prefix FROM q",
        "sampling_order": 'SELECT v, row_number() OVER (ORDER BY list_sum(list_transform(range(20), lambda i: ((v >> i) & 1) << (19 - i))), v) - 1 AS "order" FROM (SELECT p_partkey AS v FROM part)',
        "kmeans_step": f"{fuzzy} SELECT v, CAST(c AS INTEGER) AS blk FROM k WHERE r = 1",
        "block_centers": f"{_P} SELECT CAST(v % 4 AS INTEGER) AS blk, round(sum(w0 * x) / sum(w0), 6) AS x, round(sum(w0 * y) / sum(w0), 6) AS y FROM q GROUP BY 1",
        "fuzzy_topk": f"{fuzzy} SELECT v, string_agg(CAST(c AS VARCHAR), ',' ORDER BY r) AS centres FROM k WHERE r <= 3 GROUP BY v",
        "membership": f"{member} SELECT v, CAST(r - 1 AS INTEGER) AS pos, round(u, 6) AS u FROM u",
        "membership_value": f"{member} SELECT v, round(sum((u - 1.0 / 3) * (u - 1.0 / 3)), 6) AS value FROM u GROUP BY v",
        "histogram1d": f"{_P} SELECT x, sum(w0) AS w FROM q GROUP BY x",
        "bbox_weight": f"{_P} SELECT sum(w0) AS weight FROM q WHERE x BETWEEN 10 AND 30 AND y BETWEEN 920 AND 960",
        "pixel_density": f"WITH q AS ({_ORDERS}) SELECT CAST(least(floor(x / 500000::DOUBLE * 10), 9) * 10 + least(floor(y / 2500::DOUBLE * 10), 9) AS BIGINT) AS pixel, CAST(count(*) AS DOUBLE) AS weight FROM q GROUP BY 1",
        "pixel_graph": f"WITH {_GRID}, h AS (SELECT v, least(CAST(floor(r / 31::DOUBLE * 4) AS BIGINT), 3) AS i, least(CAST(floor(c / 31::DOUBLE * 4) AS BIGINT), 3) AS j FROM g), f AS (SELECT a.i * 4 + a.j AS ps, b.i * 4 + b.j AS pd, count(*) AS n FROM e JOIN h a ON a.v = src JOIN h b ON b.v = dst GROUP BY 1, 2), t AS (SELECT i, i // 4 AS r, i % 4 AS c FROM range(16) z(i)) SELECT a.i AS src, b.i AS dst, coalesce(CAST(n AS DOUBLE), 1e-10::DOUBLE) AS w FROM t a JOIN t b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 LEFT JOIN f ON ps = a.i AND pd = b.i",
        "heatmap": f"{_P}, b AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM q) SELECT CAST(least(floor((x - a) / (b.b - a) * 8), 7) AS INTEGER) AS row, CAST(least(floor((y - c) / (d - c) * 8), 7) AS INTEGER) AS col, sum(w0) AS weight FROM q, b GROUP BY 1, 2",
        "tree_levels": f"WITH {tree} SELECT 0 AS height, '' AS label, sum(w0) AS w0, sum(w1) AS w1, count(*) AS cores, count(DISTINCT a) AS children FROM t UNION ALL SELECT 1, CAST(a AS VARCHAR), sum(w0), sum(w1), count(*), count(DISTINCT b) FROM t GROUP BY a UNION ALL SELECT 2, a || '.' || b, sum(w0), sum(w1), count(*), count(DISTINCT c) FROM t GROUP BY a, b UNION ALL SELECT 3, a || '.' || b || '.' || c, w0, w1, 1, 0 FROM t",
        "tree_distance": f"WITH {tree} SELECT x.leaf_id AS src, y.leaf_id AS dst, CAST(CASE WHEN x.a <> y.a THEN 3 WHEN x.b <> y.b THEN 2 ELSE 1 END AS DOUBLE) AS w FROM t x, t y WHERE x.leaf_id <> y.leaf_id",
        "tree_adapted": f"WITH {tree} SELECT leaf_id, round(w0 * (1000.0::DOUBLE / (SELECT sum(w0) FROM t)), 6) AS w0, w1 FROM t",
        "coarsen_contract": f"WITH {_GRID} SELECT src // 4 AS src, dst // 4 AS dst, sum(w) AS w FROM e WHERE src // 4 <> dst // 4 GROUP BY 1, 2",
        "coarse_sums": f"{_P} SELECT v % 17 AS v, sum(w0) AS w0 FROM q GROUP BY 1",
        "matching_edge_rating": f"{_S} SELECT src, round(max(w * w / ((src % 3 + 1) * (dst % 3 + 1))), 6) AS best FROM e GROUP BY src",
        "nearest_partner": f"WITH {_GRID}, h AS (SELECT v, r + (v * 7 % 11) / 100.0::DOUBLE AS x, c + (v * 5 % 13) / 100.0::DOUBLE AS y FROM g), k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), dst) AS n FROM e JOIN h a ON a.v = src JOIN h b ON b.v = dst) SELECT src AS v, dst AS mate FROM k WHERE n = 1",
        "centre_distances": f"{_P}, c AS (SELECT v % 4 AS b, avg(x) AS cx, avg(y) AS cy FROM q GROUP BY 1) SELECT v, round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 6) AS dist FROM q JOIN c ON b = v % 4",
        "radius_query": f"{_P} SELECT a.v AS q, b.v AS v, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS dist FROM q a JOIN q b ON a.v % 50 = 0 AND abs(a.x - b.x) < 3 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 3.0",
        "radius_query_20": f"{_P} SELECT a.v AS q, b.v AS v, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS dist FROM q a JOIN q b ON a.v % 20 = 0 AND abs(a.x - b.x) < 3 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 3.0",
        "edge_symmetry_all": f"{_S} SELECT src % 4 AS m, count(*) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM e g WHERE g.src = e.dst AND g.dst = e.src) GROUP BY 1",
        "drifted_weights": f"{_P}, m AS (SELECT sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2)) AS m FROM q) SELECT v, round(power(2.0::DOUBLE / (1 + sqrt((x - 10) * (x - 10) + (y - 920) * (y - 920)) / m), 2), 6) AS w0 FROM q, m",
        "box_distances": f"{_P} SELECT v, round(sqrt(power(greatest(10 - x, 0, x - 20), 2) + power(greatest(920 - y, 0, y - 940), 2)), 6) AS near, round(sqrt(power(greatest(abs(x - 10), abs(x - 20)), 2) + power(greatest(abs(y - 920), abs(y - 940)), 2)), 6) AS far FROM q",
        "grid_positions": "SELECT v, v // 60 AS i, v // 10 % 6 AS j, v % 10 AS k, abs(v // 16 % 16 - 1) + abs(v % 16 - 1) AS l1 FROM range(240) t(v)",
        "random_points": "SELECT CAST(1000 AS BIGINT) AS n, true AS inside",
        **catalogue_more.oracle_sql(),
    }
