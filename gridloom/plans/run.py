"""A whole run: read, check, partition, refine, renumber, measure, write."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import hilbert
from gridloom.operators import graph, kmeans, metrics, multilevel, multisection, pixel, sfc, topology
from gridloom.session import settle
from gridloom.settings import Settings, Tool

Partitioner = Callable[["Problem"], DataFrame]
_registered: dict[str, Partitioner] = {}


@dataclass
class Problem:
    """What a partitioner gets: vertices(v, axes, weights), edges or None, options, targets [weight][block] or None, and a
    previous partition or None."""

    vertices: DataFrame
    edges: DataFrame | None
    settings: Settings
    axes: Sequence[str]
    weights: Sequence[str]
    targets: np.ndarray | None = None
    previous: DataFrame | None = None


def register_partitioner(name: str, fn: Partitioner) -> None:
    """Make fn the partitioner of that (lower-cased) name; fn(problem) returns (v, blk)."""
    _registered[name.lower()] = fn


def check_input(p: Problem) -> None:
    """Raise unless ids are unique, k <= n, edges are symmetric between known vertices, and options fit the input."""
    s = p.settings.check()
    n, distinct = p.vertices.agg(F.count("*"), F.countDistinct("v")).first()
    if n != distinct:
        raise ValueError("vertex ids must be unique")
    if s.num_blocks > n:
        raise ValueError("more blocks than vertices")
    if len(p.weights) > 1 and Tool.parse(s.tool) in (Tool.REPART.value, Tool.MULTISECTION.value):
        raise ValueError("this partitioner takes one node weight")
    if p.edges is not None:
        if not p.edges.join(p.vertices.select(F.col("v").alias("dst")), "dst", "left_anti").limit(1).isEmpty():
            raise ValueError("an edge has an unknown end")
        if not graph.asymmetric(p.edges).limit(1).isEmpty():
            raise ValueError("an edge lacks its reverse")


def _levels(s: Settings) -> list[int]:
    if not s.hier_levels:
        raise ValueError("hierarchical k-means needs hier_levels")
    return s.hier_levels


def _builtin(name: str) -> Partitioner:
    def kmeans_first(p: Problem) -> DataFrame:
        return kmeans.kmeans_partition(p.vertices, p.axes, p.settings.num_blocks, p.weights, p.targets, p.settings)[0]

    table: dict[str, Partitioner] = {
        Tool.SFC.value: lambda p: sfc.sfc_partition(p.vertices, p.axes, p.settings.num_blocks, p.settings.sfc_resolution),
        Tool.KMEANS.value: kmeans_first,
        Tool.HIER_KMEANS.value: lambda p: kmeans.hierarchical(p.vertices, p.axes, _levels(p.settings), p.weights, p.targets, p.settings),
        Tool.HIER_REPART.value: lambda p: kmeans.hierarchical_repartition(p.vertices, p.axes, _levels(p.settings), p.weights, p.targets, p.settings),
        Tool.KMEANS_BALANCE.value: lambda p: kmeans.balance(p.vertices, settle(kmeans_first(p)), p.axes, p.settings.num_blocks, p.weights, p.targets, p.settings),
        Tool.MULTISECTION.value: lambda p: multisection.multisection(p.vertices, p.axes, p.settings.num_blocks, p.weights[0] if p.weights else None, p.settings.bisect, p.settings.cuts_per_dim)[0],
        Tool.RCB.value: lambda p: multisection.coordinate_bisection(p.vertices, p.axes, p.settings.num_blocks, p.weights[0] if p.weights else None),
        Tool.PIXEL.value: lambda p: pixel.pixel_partition(p.vertices, p.axes, p.settings.num_blocks, p.settings.pixel_side),
        Tool.SPECTRAL.value: lambda p: pixel.spectral_partition(p.vertices, p.edges, p.axes, p.settings.num_blocks, p.settings.pixel_side),
        Tool.REPART.value: lambda p: kmeans.repartition(p.vertices, p.previous, p.axes, p.settings.num_blocks, p.weights, p.targets, p.settings)[0],
        Tool.NONE.value: lambda p: p.previous,
    }
    if name not in table:
        raise ValueError(f"unknown partitioner {name}")
    return table[name]


def initial_partition(p: Problem) -> DataFrame:
    name = str(getattr(p.settings.tool, "value", p.settings.tool)).lower()
    if name in _registered:
        return _registered[name](p)
    name = Tool.parse(name)
    if name in (Tool.REPART.value, Tool.NONE.value) and p.previous is None:
        raise ValueError("this tool needs a previous partition")
    return _builtin(name)(p)


def capacities(p: Problem) -> np.ndarray:
    """Most weight each block may take in refinement."""
    total = p.vertices.agg(F.sum(F.col(p.weights[0]).cast("double")) if p.weights else F.count("*").cast("double")).first()[0]
    t = np.asarray(p.targets)[0] if p.targets is not None else np.full(p.settings.num_blocks, total / p.settings.num_blocks)
    return np.maximum(t * (1 + p.settings.epsilon), np.ceil(t))


def refined(p: Problem, partition: DataFrame) -> DataFrame:
    """Local refinement; no_refinement = True leaves the partition as it is."""
    if p.settings.no_refinement or p.edges is None:
        return partition
    v = p.vertices.select("v", (F.col(p.weights[0]).cast("double") if p.weights else F.lit(1.0)).alias("w0"))
    return multilevel.multilevel(v, p.edges, partition, p.settings.num_blocks, capacities(p), p.settings, p.vertices, p.axes)


def partition_graph(vertices: DataFrame, edges: DataFrame | None, settings: Settings, axes: Sequence[str] | None = None, weights: Sequence[str] = (), targets=None, previous: DataFrame | None = None, check: bool = True) -> DataFrame:
    """(v, blk). axes default to the first ``dimensions`` of x, y, z that are there."""
    axes = list(axes or [a for a in ("x", "y", "z") if a in vertices.columns][: settings.dimensions])
    p = Problem(vertices, edges, settings, axes, list(weights), None if targets is None else np.atleast_2d(np.asarray(targets, dtype=float)), previous)
    if check:
        check_input(p)
    out = refined(p, settle(initial_partition(p).select("v", F.col("blk").cast("int").alias("blk"))))
    if previous is not None and settings.tool != "none":
        out = sfc.renumber(out, topology.heaviest_overlap(previous, out, settings.num_blocks))
    if settings.renumber:
        out = sfc.renumber(out, sfc.curve_renumbering(vertices, out, axes, settings.sfc_resolution))
    return out


def placed(vertices: DataFrame, partition: DataFrame, parts: int) -> DataFrame:
    """vertices with their block, one Spark partition for each few whole blocks: where later per-block work finds them."""
    return vertices.join(partition, "v").repartition(parts, "blk").sortWithinPartitions("blk", "v")


def partition_arrays(spark: SparkSession, starts, targets, coordinates, dims: int, settings: Settings, weights=(), edge_weights=()) -> list[int]:
    """Blocks of compressed-row arrays in memory, in vertex order."""
    from gridloom.sources.files import from_csr

    v, e = from_csr(spark, starts, targets, coordinates, dims, weights, edge_weights)
    part = partition_graph(v, e, settings, weights=["w0"] if len(weights) else ())
    return [r["blk"] for r in part.orderBy("v").collect()]


def run(vertices: DataFrame, edges: DataFrame | None, settings: Settings, **how) -> tuple[DataFrame, DataFrame]:
    """The partition of the last of settings.repeat runs, and the mean metrics."""
    runs = []
    for _ in range(max(1, settings.repeat)):
        part = settle(partition_graph(vertices, edges, settings, **how))
        if edges is not None:
            runs.append(metrics.metrics(edges, part, settings.num_blocks, settings.metrics_level))
    empty = vertices.sparkSession.createDataFrame([], "metric string, value double")
    return part, metrics.averaged(runs) if runs else empty


def heatmap(vertices: DataFrame, cells: int, weight: str = "w0") -> DataFrame:
    """(row, col, weight): vertex weight in each cell of a cells x cells grid over a 2-D mesh."""
    box = hilbert.bounds(vertices, ["x", "y"])
    d = pixel.density(vertices, ["x", "y"], cells, box, weight)
    return d.select(F.floor(F.col("pixel") / cells).cast("int").alias("row"), (F.col("pixel") % cells).cast("int").alias("col"), "weight")


def sweep(vertices: DataFrame, edges: DataFrame, settings: Settings, tools: Sequence[str], seconds: float = 600.0) -> DataFrame:
    """(tool, metric, value) of several partitioners, with their time; once one exceeds the limit the sweep ends."""
    import time

    out = None
    for tool in tools:
        began = time.perf_counter()
        part, m = run(vertices, edges, Settings(**{**settings.__dict__, "tool": tool}))
        took = time.perf_counter() - began
        one = m.unionByName(vertices.sparkSession.createDataFrame([("timeTotal", took)], "metric string, value double")).withColumn("tool", F.lit(tool))
        out = one if out is None else out.unionByName(one)
        if took > seconds:
            break
    return out
