"""MultiSection: a tree of boxes from optimal 1-D splits of weight histograms; recursive coordinate bisection.

The tree, at most k leaves, lives on the driver. The points are scanned once for each level; every batch is reduced to a
histogram along the side to cut, so what is collected is bounded by leaves times grid positions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import hilbert
from gridloom.functions.scalars import inside
from gridloom.session import settle


@dataclass
class Box:
    """A closed box; leaves of the tree are the blocks in order."""

    low: list[float]
    high: list[float]
    weight: float = 0.0
    children: list[Box] = field(default_factory=list)
    axis: int = -1
    cuts: list[float] = field(default_factory=list)

    def leaves(self) -> list[Box]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]

    def holds(self, point: Sequence[float]) -> bool:
        return all(lo <= x <= hi for lo, x, hi in zip(self.low, point, self.high, strict=True))

    def find(self, point: Sequence[float]) -> int:
        """Index of the leaf that holds a point; raises outside the box."""
        if not self.holds(point):
            raise ValueError("the point lies outside the box")
        base, node = 0, self
        while node.children:
            j = int(np.searchsorted(node.cuts, point[node.axis], side="right"))
            base += sum(len(c.leaves()) for c in node.children[:j])
            node = node.children[j]
        return base


def splits_greedy(weights: Sequence[float], k: int) -> list[int]:
    """Starts of k parts of a sequence, each closed when it reaches the average of what is left."""
    starts, left, at = [0], float(sum(weights)), 0
    for part in range(k - 1):
        goal, held = left / (k - part), 0.0
        while at < len(weights) - (k - part - 1) and (held == 0.0 or abs(held + weights[at] - goal) <= abs(held - goal)):
            held += weights[at]
            at += 1
        left -= held
        starts.append(at)
    return starts


def probe(prefix: np.ndarray, k: int, most: float) -> list[int] | None:
    """Starts of at most k parts of weight at most ``most``, or None; prefix has a leading 0."""
    starts, at, n = [0], 0, len(prefix) - 1
    for _ in range(k):
        at = int(np.searchsorted(prefix, prefix[at] + most, side="right")) - 1
        if at >= n:
            return starts
        starts.append(at)
    return None


def splits_optimal(weights: Sequence[float], k: int) -> tuple[list[int], float]:
    """Starts of k parts that minimise the greatest part weight, and that weight: for each part in turn the least
    feasible weight is found by bisection over the prefix sums, each end of which is a real part's weight."""
    w = np.asarray(weights, dtype=float)
    prefix = np.concatenate([[0.0], np.cumsum(w)])
    n, at, best = len(w), 0, float(prefix[-1])
    for part in range(k):
        if part == k - 1:
            best = min(best, float(prefix[-1] - prefix[at]))
            break
        lo, hi = at, n
        while lo < hi:
            mid = (lo + hi) // 2
            if probe(prefix, k, float(prefix[mid] - prefix[at])):
                hi = mid
            else:
                lo = mid + 1
        best = min(best, float(prefix[lo] - prefix[at]))
        at = max(at, lo - 1)
    starts = probe(prefix, k, best) or [0]
    while len(starts) < k:
        # Parts that aren't needed are empty ones at the end, unless there are positions to split off.
        wide = max(range(len(starts)), key=lambda i: ((starts + [n])[i + 1] - starts[i], -i))
        end = (starts + [n])[wide + 1]
        if end - starts[wide] < 2:
            starts.append(n)
        else:
            starts.insert(wide + 1, starts[wide] + (end - starts[wide]) // 2)
    return sorted(starts), best


def _leaf_of(x: np.ndarray, node: Box, base: int = 0) -> np.ndarray:
    if not node.children:
        return np.full(len(x), base, dtype=np.int64)
    part = np.searchsorted(np.asarray(node.cuts), x[:, node.axis], side="right")
    out = np.zeros(len(x), dtype=np.int64)
    for j, child in enumerate(node.children):
        rows = part == j
        if rows.any():
            out[rows] = _leaf_of(x[rows], child, base)
        base += len(child.leaves())
    return out


def _points(points: DataFrame, axes: Sequence[str], weight: str | None, key: str, side: int | None) -> DataFrame:
    low, high = hilbert.bounds(points, axes)
    cols = [F.col(a).cast("double") if side is None else F.floor(hilbert.scaled(F.col(a), lo, hi) * F.lit(float(side))).cast("double") for a, lo, hi in zip(axes, low, high, strict=True)]
    return settle(points.select(F.col(key).alias("v"), F.array(*cols).alias("x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")))


def histogram(data: DataFrame, tree: Box, axis: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each leaf the positions along its axis, ascending, and the weight at each."""

    def run(batches):
        sums: dict[tuple[int, float], float] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.asarray(batch.column(1).flatten()).reshape(n, -1)
            leaf = _leaf_of(x, tree)
            at = x[np.arange(n), np.asarray(axis)[leaf]]
            both, flat = np.unique(np.stack([leaf, at]), axis=1, return_inverse=True)
            for (i, c), s in zip(both.T, np.bincount(flat.ravel(), weights=np.asarray(batch.column(2))), strict=True):
                sums[int(i), float(c)] = sums.get((int(i), float(c)), 0.0) + float(s)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sums], pa.int32()), pa.array([c for _, c in sums]), pa.array(list(sums.values()))], names=["leaf", "c", "w"])

    rows = data.mapInArrow(run, "leaf int, c double, w double").groupBy("leaf", "c").agg(F.sum("w").alias("w")).orderBy("leaf", "c").toArrow()
    leaf, c, w = (np.asarray(rows.column(n)) for n in ("leaf", "c", "w"))
    return [(c[leaf == i], w[leaf == i]) for i in range(len(axis))]


def grow(data: DataFrame, cuts: Sequence[int], dims: int, box: tuple[list[float], list[float]], longest: bool = True) -> Box:
    """The tree: at each level every leaf is cut into cuts[level] parts across its longest side (or the level's axis)."""
    root = Box(*box)
    for level, m in enumerate(cuts):
        leaves = root.leaves()
        axis = [int(np.argmax([h - lo for lo, h in zip(b.low, b.high, strict=True)])) if longest else level % dims for b in leaves]
        for b, a, (c, w) in zip(leaves, axis, histogram(data, root, axis), strict=True):
            starts, _ = splits_optimal(w, m) if len(w) else ([0] * m, 0.0)
            edges = [b.low[a], *[float(c[s]) if s < len(c) else math.nextafter(b.high[a], math.inf) for s in starts[1:]]]
            b.axis, b.cuts = a, edges[1:]
            ends = [*starts[1:], len(w)]
            for j in range(m):
                low, high = list(b.low), list(b.high)
                low[a] = edges[j]
                high[a] = math.nextafter(edges[j + 1], -math.inf) if j + 1 < m else b.high[a]
                b.children.append(Box(low, high, float(w[starts[j] : ends[j]].sum()) if len(w) else 0.0))
    root.weight = sum(b.weight for b in root.leaves())
    return root


def cut_counts(k: int, dims: int, bisect: bool = False, per_dim: Sequence[int] = ()) -> list[int]:
    if per_dim:
        if math.prod(per_dim) != k:
            raise ValueError("the product of the cuts must be k")
        return list(per_dim)
    if bisect:
        if k & (k - 1):
            raise ValueError("bisection needs a power of two")
        return [2] * (k.bit_length() - 1)
    side = round(k ** (1 / dims))
    if side**dims == k:
        return [side] * dims
    out, left = [], k
    for d in range(dims, 0, -1):
        # The divisor nearest to the root of what is left keeps boxes as square as k allows.
        m = min((x for x in range(1, left + 1) if left % x == 0), key=lambda x: (abs(math.log(x) - math.log(left) / d), -x)) if d > 1 else left
        out.append(m)
        left //= m
    return out


def multisection(points: DataFrame, axes: Sequence[str], k: int, weight: str | None = None, bisect: bool = False, per_dim: Sequence[int] = (), scale: bool = True, side: int | None = None, key: str = "v") -> tuple[DataFrame, Box]:
    """(v, blk) and the tree. Coordinates are scaled to integers in [0, (n - 1)^(1 / d)] unless ``scale`` is off; a side
    gives a uniform grid of that many positions."""
    dims = len(axes)
    n = points.count()
    grid = (side - 1 if side else max(1, int(max(n - 1, 1) ** (1 / dims)))) if scale else None
    data = _points(points, axes, weight, key, grid)
    box = ([0.0] * dims, [float(grid)] * dims) if grid else hilbert.bounds(points, axes)
    tree = grow(data, cut_counts(k, dims, bisect, per_dim), dims, box)
    return located(data, tree), tree


def located(data: DataFrame, tree: Box) -> DataFrame:
    """(v, blk): the leaf of each point(v, x)."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = np.asarray(batch.column(1).flatten()).reshape(n, -1) if n else np.zeros((0, len(tree.low)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_leaf_of(x, tree).astype(np.int32))], names=["v", "blk"])

    return data.select("v", "x").mapInArrow(run, "v long, blk int")


def coordinate_bisection(points: DataFrame, axes: Sequence[str], k: int, weight: str | None = None, key: str = "v") -> DataFrame:
    """(v, blk) by recursive coordinate bisection: weighted halves across the longest side, on unscaled coordinates;
    a block for an odd number of parts gets its share of the weight."""
    data = _points(points, axes, weight, key, None)
    root = Box(*hilbert.bounds(points, axes))
    todo = {id(root): k}
    while any(m > 1 for m in todo.values()):
        leaves = root.leaves()
        axis = [int(np.argmax([h - lo for lo, h in zip(b.low, b.high, strict=True)])) for b in leaves]
        for b, a, (c, w) in zip(leaves, axis, histogram(data, root, axis), strict=True):
            m = todo.pop(id(b))
            if m == 1:
                todo[id(b)] = 1
                continue
            half = m // 2
            prefix = np.cumsum(w)
            goal = prefix[-1] * half / m if len(w) else 0.0
            s = int(np.searchsorted(prefix, goal)) + 1 if len(w) else 0
            if 1 < s and abs(prefix[s - 2] - goal) <= abs(prefix[min(s, len(w)) - 1] - goal):
                s -= 1
            cut = float(c[s]) if s < len(c) else math.nextafter(b.high[a], math.inf)
            b.axis, b.cuts = a, [cut]
            for lo, hi, n in ((b.low[a], math.nextafter(cut, -math.inf), half), (cut, b.high[a], m - half)):
                low, high = list(b.low), list(b.high)
                low[a], high[a] = lo, hi
                child = Box(low, high)
                b.children.append(child)
                todo[id(child)] = n
    return located(data, root)


def box_weight(points: DataFrame, axes: Sequence[str], low: Sequence[float], high: Sequence[float], weight: str | None = None) -> DataFrame:
    """weight inside a closed box; the range predicate reaches the scan."""
    w = F.sum(F.col(weight).cast("double")) if weight else F.count("*").cast("double")
    return points.filter(inside([F.col(a) for a in axes], [F.lit(x) for x in low], [F.lit(x) for x in high])).agg(F.coalesce(w, F.lit(0.0)).alias("weight"))


def leaf_table(spark, tree: Box) -> DataFrame:
    """(leaf, low, high, weight) of the tree's leaves."""
    return spark.createDataFrame([(i, b.low, b.high, b.weight) for i, b in enumerate(tree.leaves())], "leaf int, low array<double>, high array<double>, weight double")


def leaf_adjacency(leaves: DataFrame, gap: float = 1.0) -> DataFrame:
    """(bs, bd): leaves that touch: along one axis the gap is at most ``gap``, along the others the boxes overlap."""
    a, b = leaves.select(F.col("leaf").alias("bs"), F.col("low").alias("al"), F.col("high").alias("ah")), leaves.select(F.col("leaf").alias("bd"), F.col("low").alias("bl"), F.col("high").alias("bh"))
    apart = F.zip_with(F.zip_with("al", "bh", lambda x, y: x - y), F.zip_with("bl", "ah", lambda x, y: x - y), lambda p, q: F.greatest(p, q))
    met = F.aggregate(F.transform("apart", lambda x: F.when(x > gap, 100).when(x > 0, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return a.join(F.broadcast(b), F.col("bs") != F.col("bd")).withColumn("apart", apart).filter(met <= 1).select("bs", "bd")
