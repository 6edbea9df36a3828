"""Processor trees as DataFrames, and the mapping of blocks to processors.

A tree is its leaves, leaves(leaf_id, label array<int>, weights array<double>): nodes above are label prefixes, so every
level is a group-by on a slice of the label. Trees have k leaves, one for each block."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_leaves(spark: SparkSession, rows: Sequence[tuple[Sequence[int], Sequence[float]]]) -> DataFrame:
    """leaves of (label, weights) rows, numbered in their order; labels must be of one length and distinct."""
    if len({len(label) for label, _ in rows}) > 1 or len({tuple(label) for label, _ in rows}) < len(rows):
        raise ValueError("labels must be distinct and of one length")
    return spark.createDataFrame([(i, list(map(int, label)), list(map(float, w))) for i, (label, w) in enumerate(rows)], "leaf_id int, label array<int>, weights array<double>")


def from_levels(spark: SparkSession, levels: Sequence[int], weights: int = 1) -> DataFrame:
    """A homogeneous tree: leaf i has the mixed-radix digits of i as its label and weight 1."""
    n = int(np.prod(levels))
    digits, step = [], n
    for m in levels:
        step //= m
        digits.append((F.floor(F.col("id") / F.lit(step)) % m).cast("int"))
    return spark.range(n).select(F.col("id").cast("int").alias("leaf_id"), F.array(*digits).alias("label"), F.array_repeat(F.lit(1.0), weights).alias("weights"))


def flat(spark: SparkSession, k: int, weights: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """A root with k leaves; weights are [weight][leaf], 1 by default."""
    w = np.ones((1, k)) if weights is None else np.asarray(weights, dtype=float)
    return from_leaves(spark, [((i,), w[:, i]) for i in range(k)])


def level(leaves: DataFrame, height: int) -> DataFrame:
    """(label, weights, cores, children) of the nodes with labels of that length; height 0 is the root."""
    at = F.slice("label", 1, height) if height else F.array().cast("array<int>")
    n = len(leaves.select("weights").first()[0])
    out = leaves.withColumn("node", at).withColumn("child", F.slice("label", 1, height + 1))
    return out.groupBy(F.col("node").alias("label")).agg(F.array(*[F.sum(F.col("weights")[i]) for i in range(n)]).alias("weights"), F.count("*").alias("cores"), F.countDistinct("child").alias("children"))


def tree_nodes(leaves: DataFrame) -> DataFrame:
    """(height, label, weights, cores, children) of all levels, root first."""
    depth = leaves.select(F.size("label")).first()[0]
    out = None
    for h in range(depth + 1):
        one = level(leaves, h).select(F.lit(h).alias("height"), "label", "weights", "cores", (F.col("children") if h < depth else F.lit(0)).cast("long").alias("children"))
        out = one if out is None else out.unionByName(one)
    return out


def grouping(leaves: DataFrame, height: int) -> list[int]:
    """How many nodes of the next level each node of this level has, in label order."""
    return [r[0] for r in level(leaves, height).orderBy("label").select("children").collect()]


def balance_vectors(leaves: DataFrame, height: int = -1) -> np.ndarray:
    """[weight][node] of a level in label order; -1: the leaves in their own order."""
    rows = leaves.orderBy("leaf_id").select("weights").collect() if height < 0 else level(leaves, height).orderBy("label").select("weights").collect()
    return np.array([r[0] for r in rows]).T


def adapt_weights(leaves: DataFrame, totals: Sequence[float], proportional: Sequence[bool]) -> DataFrame:
    """leaves whose proportional weights are scaled to sum to the totals; absolute ones stay. Adapting twice is the same."""
    sums = leaves.agg(*[F.sum(F.col("weights")[i]).alias(f"s{i}") for i in range(len(totals))])
    w = [F.col("weights")[i] * (F.lit(float(t)) / F.col(f"s{i}")) if p else F.col("weights")[i] for i, (t, p) in enumerate(zip(totals, proportional, strict=True))]
    return leaves.crossJoin(F.broadcast(sums)).select("leaf_id", "label", F.array(*w).alias("weights"))


def targets(leaves: DataFrame, weight: int = 0) -> DataFrame:
    """(blk, target) for imbalance()."""
    return leaves.select(F.col("leaf_id").alias("blk"), F.col("weights")[weight].alias("target"))


def label_distance(a: Column, b: Column, distances: Sequence[float]) -> Column:
    """distances[L - i - 1], i the first position where the labels differ; 0 for equal labels."""
    n = len(distances)
    out = F.lit(0.0)
    for i in reversed(range(n)):
        out = F.when(a[i] != b[i], F.lit(float(distances[n - i - 1]))).otherwise(out)
    return out


def tree_graph(leaves: DataFrame, distances: Sequence[float] | None = None) -> DataFrame:
    """(src, dst, w): the complete graph of the leaves weighted by distance (levels apart by default)."""
    depth = leaves.select(F.size("label")).first()[0]
    d = list(distances or range(1, depth + 1))
    a, b = leaves.select(F.col("leaf_id").alias("src"), F.col("label").alias("la")), leaves.select(F.col("leaf_id").alias("dst"), F.col("label").alias("lb"))
    return a.join(F.broadcast(b), F.col("src") != F.col("dst")).select("src", "dst", label_distance(F.col("la"), F.col("lb"), d).alias("w"))


def is_homogeneous(leaves: DataFrame) -> bool:
    return leaves.select("weights").distinct().count() == 1


def check_tree(leaves: DataFrame) -> None:
    """Raise if leaf ids aren't 0..k-1, labels repeat or differ in length, or weights differ in number."""
    r = leaves.agg(F.count("*"), F.min("leaf_id"), F.max("leaf_id"), F.countDistinct("label"), F.countDistinct(F.size("label")), F.countDistinct(F.size("weights")), F.countDistinct("leaf_id")).first()
    if not (r[1] == 0 and r[2] == r[0] - 1 == r[6] - 1 and r[3] == r[0] and r[4] == 1 and r[5] == 1):
        raise ValueError("not a valid tree")


def from_options(spark: SparkSession, k: int, levels: Sequence[int] = (), block_sizes=None, pe_rows=None) -> DataFrame:
    """The tree that a run's options ask for: processor rows, block sizes, levels, or k equal leaves."""
    if sum(bool(len(x)) if x is not None else False for x in (levels, block_sizes, pe_rows)) > 1:
        raise ValueError("give levels, block sizes or a processor tree, not several")
    if pe_rows:
        return from_leaves(spark, pe_rows)
    if block_sizes is not None:
        return flat(spark, k, block_sizes)
    return from_levels(spark, levels) if levels else flat(spark, k)


def sizes_for_memory(speed: Sequence[float], memory: Sequence[float], load: float) -> list[float]:
    """Block sizes of processors: in the order of speed per memory, each gets its share by speed of what is left, or its
    memory if that is less. Raises if the load doesn't fit."""
    if load > sum(memory) * (1 + 1e-12):
        raise ValueError("the load doesn't fit into the memory")
    order = sorted(range(len(speed)), key=lambda i: (-speed[i] / memory[i], i))
    out, left, fast = [0.0] * len(speed), float(load), float(sum(speed))
    for i in order:
        out[i] = min(left * speed[i] / fast, memory[i]) if fast > 0 else min(left, memory[i])
        left -= out[i]
        fast -= speed[i]
    return out


def _distances(n: int, edges) -> np.ndarray:
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for s, t, w in edges:
        d[s, t] = min(d[s, t], w)
    for m in range(n):
        np.minimum(d, d[:, m : m + 1] + d[m : m + 1, :], out=d)
    return d


def all_paths(n: int, edges) -> tuple[np.ndarray, np.ndarray]:
    """Distances and predecessors of all pairs of a graph of n processors, by Dijkstra from each."""
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for s, t, w in edges:
        near[s].append((t, w))
    dist, pred = np.full((n, n), np.inf), np.full((n, n), -1)
    for s in range(n):
        dist[s, s], pred[s, s] = 0, s
        queue, done = [(0.0, s)], set()
        while queue:
            d, x = heapq.heappop(queue)
            if x in done:
                continue
            done.add(x)
            for y, w in near[x]:
                if d + w < dist[s, y] - 1e-15:
                    dist[s, y], pred[s, y] = d + w, x
                    heapq.heappush(queue, (d + w, y))
    return dist, pred


def greedy_mapping(block_edges, pe_edges, k: int, start: int | None = None, seed: int = 0) -> list[int]:
    """Processor of each block: the block of most traffic starts on a processor; then always the unmapped block that
    talks most to mapped ones goes to the free processor nearest to the start. k nodes, on the driver."""
    w = np.zeros((k, k))
    for a, b, x in block_edges:
        w[a, b] += x
    d = _distances(k, pe_edges)
    first = int(np.random.default_rng(seed).integers(k)) if start is None else start
    out, free = [-1] * k, set(range(k))
    talk, anchor = w.sum(axis=1), first
    while free:
        todo = [b for b in range(k) if out[b] < 0]
        mapped = [b for b in range(k) if out[b] >= 0]
        pull = w[:, mapped].sum(axis=1) if mapped else talk
        b = max(todo, key=lambda x: (pull[x], talk[x], -x))
        if mapped and pull[b] > 0:
            cost = {p: sum(w[b, m] * d[p, out[m]] for m in mapped if w[b, m]) for p in free}
        else:
            cost = {p: d[anchor, p] for p in free}
        p = min(free, key=lambda x: (cost[x], x))
        out[b] = p
        free.discard(p)
    return out


def is_mapping(mapping: Sequence[int]) -> bool:
    return sorted(mapping) == list(range(len(mapping)))


def mapping_metrics(block_edges, pe_edges, mapping: Sequence[int], k: int) -> dict[str, float]:
    """Dilation, congestion and cost of a mapping: every block edge's weight flows along a shortest processor path;
    dilation is distance times weight, congestion the load of a link over its weight."""
    pe = list(pe_edges)
    dist, pred = all_paths(k, pe)
    width = {(a, b): w for a, b, w in pe}
    load: dict[tuple[int, int], float] = {}
    dilations, cost, edges = [], 0.0, 0
    for a, b, w in block_edges:
        if a == b or not w:
            continue
        s, t = mapping[a], mapping[b]
        dilations.append(dist[s, t] * w)
        cost += dist[s, t] * w
        edges += 1
        while t != s:
            p = int(pred[s, t])
            load[p, t] = load.get((p, t), 0.0) + w
            t = p
    busy = [x / width[link] for link, x in load.items()]
    links = len(pe) / 2
    found = {
        "maxDilation": max(dilations, default=0.0), "avgDilation": sum(dilations) / 2 / links if links else 0.0,
        "maxCongestion": max(busy, default=0.0), "qapCost": cost / 2, "blockEdges": edges / 2,
    }
    return {n: float(x) for n, x in found.items()}


def identity_mapping_metrics(block_edges, pe_edges, k: int) -> dict[str, float]:
    return mapping_metrics(block_edges, pe_edges, list(range(k)), k)


def qap_cost(block_edges: DataFrame, distances: DataFrame, mapping: DataFrame) -> DataFrame:
    """cost: half the sum of weight times distance of the mapped pair; mapping(blk, pe), distances(src, dst, w)."""
    m = F.broadcast(mapping)
    e = block_edges.select("bs", "bd", F.col("w").alias("x")).join(m.select(F.col("blk").alias("bs"), F.col("pe").alias("src")), "bs").join(m.select(F.col("blk").alias("bd"), F.col("pe").alias("dst")), "bd")
    return e.join(F.broadcast(distances), ["src", "dst"]).agg((F.coalesce(F.sum(F.col("x") * F.col("w")), F.lit(0.0)) / 2).alias("cost"))


def heaviest_overlap(old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """(blk, new_blk): names of new(v, blk)'s blocks that keep most vertices of old(v, blk) in place: overlaps in falling
    order claim names greedily; k^2 counts at most reach the driver."""
    both = new.select("v", "blk").join(old.select("v", F.col("blk").alias("had")), "v").groupBy("blk", "had").count().collect()
    name, taken = {}, set()
    for r in sorted(both, key=lambda r: (-r["count"], r["blk"], r["had"])):
        if r["blk"] not in name and r["had"] not in taken and r["had"] < k:
            name[r["blk"]] = r["had"]
            taken.add(r["had"])
    rest = iter(sorted(set(range(k)) - taken))
    for b in range(k):
        if b not in name:
            name[b] = next(rest)
    return new.sparkSession.createDataFrame(sorted(name.items()), "blk int, new_blk int")


def shares(rows: DataFrame, host: str = "host") -> DataFrame:
    """rows(host, cpu, memory, cores) with cpu as a share of the total."""
    return rows.withColumn("cpu", F.col("cpu") / F.sum("cpu").over(Window.partitionBy(F.lit(0))))
