"""Balanced k-means on points(v, axes, weights), with block influences.

A point goes to the centre of least squared distance times influence. All state that grows with the points stays in
Spark: a step is one scan in which every batch is reduced to k rows of partial sums in numpy, and one small aggregate.
The driver holds centres, influences, block weights and at most LOCAL_ROWS points. ``parent`` restricts a point to the centres of its block of
the level above."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import hilbert
from gridloom.operators import sfc
from gridloom.session import forget, settle
from gridloom.settings import Settings

CELLS = 1 << 21
#: Points that the driver may hold, as all there are or as a sample: some tens of bytes each.
LOCAL_ROWS = 1 << 16


@dataclass
class Clusters:
    """Centres (k x d), influences (weights x k), the parent of each centre, and the last step's block weights."""

    centres: np.ndarray
    influence: np.ndarray
    parents: np.ndarray
    weights: np.ndarray | None = None
    imbalance: float = float("inf")
    rounds: int = 0


def nearest(x: np.ndarray, share: np.ndarray, father: np.ndarray | None, c: Clusters) -> np.ndarray:
    """The best centre of each point; a tie goes to the smaller id."""
    out = np.zeros(len(x), dtype=np.int32)
    step = max(1, CELLS // max(1, len(c.centres)))
    square = (c.centres**2).sum(axis=1)
    for lo in range(0, len(x), step):
        p = x[lo : lo + step]
        d = np.maximum((p**2).sum(axis=1)[:, None] - 2 * p @ c.centres.T + square[None, :], 0) if x.shape[1] > 8 else sum((p[:, j, None] - c.centres[None, :, j]) ** 2 for j in range(x.shape[1]))
        d = d * (share[lo : lo + step] @ c.influence)
        if father is not None:
            d = np.where(c.parents[None, :] == father[lo : lo + step, None], d, np.inf)
        out[lo : lo + step] = d.argmin(axis=1)
    return out


def prepared(points: DataFrame, axes: Sequence[str], weights: Sequence[str] = (), key: str = "v", parent: str | None = None) -> DataFrame:
    """(v, x array, w array, father): what the steps scan; settled once."""
    w = [F.col(c).cast("double") for c in weights] or [F.lit(1.0)]
    x = F.array(*[F.col(a).cast("double") for a in axes]) if len(axes) > 1 else F.col(axes[0]).cast("array<double>")
    return settle(points.select(F.col(key).alias("v"), x.alias("x"), F.array(*w).alias("w"), (F.col(parent).cast("int") if parent else F.lit(0)).alias("father")))


def _columns(batch: pa.RecordBatch):
    n = batch.num_rows
    x = np.asarray(batch.column(1).flatten()).reshape(n, -1)
    w = np.asarray(batch.column(2).flatten()).reshape(n, -1)
    share = w / np.where(w.sum(axis=1, keepdims=True) > 0, w.sum(axis=1, keepdims=True), 1) if w.shape[1] > 1 else np.ones((n, 1))
    return x, w, share, np.asarray(batch.column(3))


def _totals(x: np.ndarray, w: np.ndarray, share: np.ndarray, father: np.ndarray, c: Clusters) -> np.ndarray:
    """k rows: count, then for each weight its sum and its weighted coordinate sums."""
    k = len(c.centres)
    blk = nearest(x, share, father if len(np.unique(c.parents)) > 1 else None, c)
    parts = [np.bincount(blk, minlength=k)]
    for i in range(w.shape[1]):
        parts.append(np.bincount(blk, weights=w[:, i], minlength=k))
        parts += [np.bincount(blk, weights=w[:, i] * x[:, j], minlength=k) for j in range(x.shape[1])]
    return np.stack(parts, axis=1)


def _sums(c: Clusters):
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = _totals(*_columns(batch), c)
                total = part if total is None else total + part
        if total is not None:
            k, m = total.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), m)), pa.array(np.tile(np.arange(m, dtype=np.int32), k)), pa.array(total.ravel().astype(float))], names=["blk", "slot", "value"])

    return run


def _means(t: np.ndarray, c: Clusters) -> tuple[np.ndarray, np.ndarray]:
    """Block weights (weights x k), and centres as the mean over the weights of the weighted block means; an empty block
    keeps its centre."""
    k, d, n_w = len(c.centres), c.centres.shape[1], len(c.influence)
    t = t[:, 1:].reshape(k, n_w, 1 + d)
    some = t[:, :, :1] > 0
    means = np.where(some, t[:, :, 1:] / np.where(some, t[:, :, :1], 1), 0.0).sum(axis=1) / np.maximum(some.sum(axis=1), 1)
    return t[:, :, 0].T, np.where(some.any(axis=1), means, c.centres)


def step(data: DataFrame, c: Clusters) -> tuple[np.ndarray, np.ndarray]:
    """One scan of the points: block weights and new centres under the clusters."""
    rows = data.mapInArrow(_sums(c), "blk int, slot int, value double").groupBy("blk", "slot").agg(F.sum("value").alias("value")).toArrow()
    t = np.zeros((len(c.centres), 1 + len(c.influence) * (1 + c.centres.shape[1])))
    t[np.asarray(rows.column("blk")), np.asarray(rows.column("slot"))] = np.asarray(rows.column("value"))
    return _means(t, c)


def assign(data: DataFrame, c: Clusters) -> DataFrame:
    """(v, blk) under the clusters."""

    def run(batches):
        for batch in batches:
            x, _, share, father = _columns(batch)
            blk = nearest(x, share, father if len(np.unique(c.parents)) > 1 else None, c) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blk)], names=["v", "blk"])

    return data.mapInArrow(run, "v long, blk int")


def _settle(take, start: Clusters, targets: np.ndarray, settings: Settings, diagonal: float) -> Clusters:
    """Alternate balancing of influences and recentring until the centres rest and every weight is balanced; take(c) gives
    block weights and means."""
    eps = np.array(settings.epsilons or [settings.epsilon] * len(targets))
    exponent, cap = settings.exponent(start.centres.shape[1]), settings.influence_change_cap
    now, best = start, None
    for r in range(1, settings.max_kmeans_iterations + 1):
        high, low, grew = np.full(len(now.centres), 1 + cap), np.full(len(now.centres), 1 - cap), None
        for b in range(max(1, settings.balance_iterations)):
            got, means = take(now)
            ratio = got / targets
            now.weights, now.imbalance = got, float((ratio - 1).max())
            balanced = bool(((ratio - 1).max(axis=1) <= eps).all())
            if balanced or b == settings.balance_iterations - 1:
                break
            change = np.clip(ratio**exponent, low, high)
            if settings.freeze_balanced_influence:
                change = np.where(np.abs(ratio - 1) < settings.epsilon, 1.0, change)
            if settings.tighten_bounds and grew is not None:
                turned = ((ratio > 1) != grew).any(axis=0)
                high, low = np.where(turned, 0.1 + 0.9 * high, high), np.where(turned, 0.1 + 0.9 * low, low)
            grew = ratio > 1
            now = Clusters(now.centres, now.influence * change, now.parents, got, now.imbalance, r)
        now.rounds = r
        if best is None or now.imbalance < best.imbalance:
            best = now
        moved = float(np.sqrt(((means - now.centres) ** 2).sum(axis=1)).max())
        if (moved <= 0.002 * diagonal and balanced) or r == settings.max_kmeans_iterations:
            break
        influence = now.influence
        if settings.erode_influence:
            # Influences drift towards 1 by how far their centre moved, relative to a block's extent.
            extent = diagonal / max(1.0, len(now.centres) ** (1 / means.shape[1]))
            fade = 2 / (1 + np.exp(-np.sqrt(((means - now.centres) ** 2).sum(axis=1)) / max(extent, 1e-300))) - 1
            influence = np.exp((1 - fade) * np.log(influence))
        now = Clusters(means, influence, now.parents, None, float("inf"), r)
    return best if settings.keep_most_balanced else now


def fit(data: DataFrame, start: Clusters, targets: np.ndarray, settings: Settings, diagonal: float) -> Clusters:
    """Clusters of the points. Up to LOCAL_ROWS points settle on the driver. Beyond that, unless sampling is off, a sample
    of that bound settles first, so that few scans of all points remain."""
    n = data.count()
    if n > LOCAL_ROWS and settings.min_sampling_nodes < 0:
        return _settle(lambda c: step(data, c), start, targets, settings, diagonal)
    few = data if n <= LOCAL_ROWS else data.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * LOCAL_ROWS / n))
    t = few.orderBy("v").toArrow().combine_chunks()
    if t.num_rows:
        held = _columns(t.to_batches()[0])
        share = t.num_rows / n
        start = _settle(lambda c: _means(_totals(*held, c), c), start, targets * share, settings, diagonal)
    return start if n <= LOCAL_ROWS else _settle(lambda c: step(data, c), Clusters(start.centres, start.influence, start.parents), targets, settings, diagonal)


def _diagonal(points: DataFrame, axes: Sequence[str]) -> float:
    if len(axes) == 1:
        row = points.select(F.posexplode(F.col(axes[0]))).groupBy("pos").agg((F.max("col") - F.min("col")).cast("double").alias("e")).agg(F.sum(F.col("e") * F.col("e"))).first()
        return float(np.sqrt(row[0] or 0.0))
    low, high = hilbert.bounds(points, axes)
    return float(np.sqrt(sum((h - lo) ** 2 for lo, h in zip(low, high, strict=True))))


def _targets(points: DataFrame, weights: Sequence[str], k: int, targets, epsilon: float) -> np.ndarray:
    row = points.agg(*([F.sum(F.col(c).cast("double")) for c in weights] or [F.count("*").cast("double")])).first()
    totals = np.array([float(x or 0) for x in row])
    if targets is None:
        t = np.ceil(totals[:, None] / k) * np.ones((1, k)) if not weights else totals[:, None] / k * np.ones((1, k))
    else:
        t = np.atleast_2d(np.asarray(targets, dtype=float))
    if (totals > t.sum(axis=1) * (1 + epsilon) + 1e-9).any():
        raise ValueError("the blocks' target weights don't hold the total vertex weight")
    return t


def kmeans_partition(points: DataFrame, axes: Sequence[str], k: int, weights: Sequence[str] = (), targets=None, settings: Settings | None = None, centres: np.ndarray | None = None, key: str = "v", depth: int | None = None) -> tuple[DataFrame, Clusters]:
    """(v, blk) and the clusters. Centres default to points spread along the curve. One axis name of array type holds
    points of any dimension; its centres then default to points in the order of a hash of the key."""
    settings = settings or Settings(num_blocks=k)
    t = _targets(points, weights, k, targets, settings.epsilon)
    if centres is None and len(axes) == 1:
        rows = points.orderBy(F.xxhash64(key), key).select(axes[0]).limit(k).collect()
        centres = np.array([list(r[0]) for r in rows], dtype=float)
    elif centres is None:
        rows = sfc.curve_centres(points, axes, k, depth or settings.sfc_resolution, key).orderBy("i").collect()
        centres = np.array([[float(r[a]) for a in axes] for r in rows])
    if len(centres) < k:
        raise ValueError("fewer points than blocks")
    data = prepared(points, axes, weights, key)
    start = Clusters(np.asarray(centres, dtype=float), np.ones((len(t), k)), np.zeros(k, dtype=np.int32))
    c = fit(data, start, t, settings, _diagonal(points, axes))
    return assign(data, c), c


def block_centres(points: DataFrame, partition: DataFrame, axes: Sequence[str], weights: Sequence[str] = (), key: str = "v") -> DataFrame:
    """(blk, axes): for each weight the weighted mean of the block, then the mean over the weights."""
    w = list(weights) or ["__one"]
    p = points.withColumn("__one", F.lit(1.0)).join(partition.select(F.col("v").alias(key), "blk"), key)
    means = []
    for a in axes:
        total = None
        for c in w:
            m = F.sum(F.col(c).cast("double") * F.col(a).cast("double")) / F.sum(F.col(c).cast("double"))
            total = m if total is None else total + m
        means.append((total / len(w)).alias(a))
    return p.groupBy("blk").agg(*means)


def repartition(points: DataFrame, previous: DataFrame, axes: Sequence[str], k: int, weights: Sequence[str] = (), targets=None, settings: Settings | None = None, key: str = "v") -> tuple[DataFrame, Clusters]:
    """Balanced k-means seeded with the centres of a previous partition; an empty block takes the farthest corner's end."""
    found = {r["blk"]: [float(r[a]) for a in axes] for r in block_centres(points, previous, axes, weights, key).collect()}
    low, high = hilbert.bounds(points, axes)
    centres = np.array([found.get(b, high) for b in range(k)])
    return kmeans_partition(points, axes, k, weights, targets, settings, centres, key)


def hierarchical(points: DataFrame, axes: Sequence[str], levels: Sequence[int], weights: Sequence[str] = (), leaf_targets=None, settings: Settings | None = None, key: str = "v") -> DataFrame:
    """(v, blk): k-means level by level; each block splits into levels[i] blocks, with the sums of the leaves' targets."""
    settings = settings or Settings()
    k = int(np.prod(levels))
    leaf = _targets(points, weights, k, leaf_targets, settings.epsilon)
    now, blocks, part = points.withColumn("__p", F.lit(0)), 1, None
    for m in levels:
        rows = sfc.curve_centres(now, axes, 0, settings.sfc_resolution, key, "__p", dict.fromkeys(range(blocks), m)).orderBy("parent", "i").collect()
        centres = np.array([[float(r[a]) for a in axes] for r in rows])
        if len(centres) < blocks * m:
            raise ValueError("fewer points than blocks")
        parents = np.repeat(np.arange(blocks, dtype=np.int32), m)
        blocks *= m
        t = leaf.reshape(len(leaf), blocks, -1).sum(axis=2)
        data = prepared(now, axes, weights, key, "__p")
        c = fit(data, Clusters(centres, np.ones((len(t), blocks)), parents), t, settings, _diagonal(points, axes))
        part = settle(assign(data, c))
        now = points.join(part.select(F.col("v").alias(key), F.col("blk").alias("__p")), key)
    return part


def hierarchical_repartition(points, axes, levels, weights=(), leaf_targets=None, settings=None, key="v") -> DataFrame:
    """hierarchical(), then repartition() from its blocks."""
    first = hierarchical(points, axes, levels, weights, leaf_targets, settings, key)
    return repartition(points, first, axes, int(np.prod(levels)), weights, leaf_targets, settings, key)[0]


def _centre_structs(c: Clusters) -> Column:
    return F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in p]).alias("p"), F.array(*[F.lit(float(x)) for x in c.influence[:, i]]).alias("f"), F.lit(i).alias("c")) for i, p in enumerate(c.centres)])


def fuzzify(points: DataFrame, axes: Sequence[str], c: Clusters, most: int = 6, key: str = "v") -> DataFrame:
    """(v, near): the ``most`` centres of least effective distance, as (dist, c) in ascending order; built-in functions
    only. Effective distance is squared distance times the (first) influence."""
    x = F.array(*[F.col(a).cast("double") for a in axes])
    dist = F.transform(_centre_structs(c), lambda s: F.struct((F.aggregate(F.zip_with(x, s["p"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, y: t + y) * s["f"][0]).alias("dist"), s["c"].alias("c")))
    return points.select(F.col(key).alias("v"), F.slice(F.array_sort(dist), 1, most).alias("near"))


def membership(fuzzy: DataFrame) -> DataFrame:
    """(v, member): u = 1 / (d^2 * sum over the point's centres of 1 / d^2); a point on a centre belongs to it alone."""
    inv = F.transform("near", lambda s: F.when(s["dist"] > 0, 1 / (s["dist"] * s["dist"])).otherwise(F.lit(float("inf"))))
    total = F.aggregate(F.col("i"), F.lit(0.0), lambda t, x: t + x)
    u = F.transform("i", lambda x: F.when(F.col("s") == float("inf"), F.when(x == float("inf"), 1.0).otherwise(0.0)).otherwise(x / F.col("s")))
    return fuzzy.withColumn("i", inv).withColumn("s", total).select("v", "near", u.alias("member"))


def membership_value(members: DataFrame) -> DataFrame:
    """(v, value): sum over the c centres of (u - 1 / c)^2; high for a point that clearly belongs somewhere."""
    n = F.size("member")
    return members.select("v", "near", F.aggregate("member", F.lit(0.0), lambda t, u: t + (u - 1.0 / n) * (u - 1.0 / n)).alias("value"))


def membership_normalised(members: DataFrame, partition: DataFrame) -> DataFrame:
    """(v, value) divided by the greatest value in the point's block."""
    v = membership_value(members).join(partition, "v")
    top = v.groupBy("blk").agg(F.max("value").alias("top"))
    return v.join(F.broadcast(top), "blk").select("v", F.when(F.col("top") > 0, F.col("value") / F.col("top")).otherwise(F.lit(0.0)).alias("value"))


def rebalance(points: DataFrame, partition: DataFrame, fuzzy: DataFrame, k: int, weights: Sequence[str], targets: np.ndarray, settings: Settings, batch: int = 20_000, key: str = "v") -> DataFrame:
    """(v, blk) after greedy moves of points out of overloaded blocks to another of their near centres.

    A round brings the candidates, the least attached first, to the driver, at most ``batch`` at once and the next ones
    only if of those none moves. A point moves only if the overload falls: ``reb_lex`` compares the sorted relative
    overloads, ``reb_sqimba`` their sum of squares. No block leaves its epsilon by a move. Rounds end when no block is
    overloaded or no candidate at all can move; each lowers the overload, so they do end."""
    eps = np.array(settings.epsilons or [settings.epsilon] * len(targets))[:, None]
    w = list(weights) or ["__one"]
    rows = points.withColumn("__one", F.lit(1.0)).select(F.col(key).alias("v"), F.array(*[F.col(c).cast("double") for c in w]).alias("w"))
    now = settle(partition.select("v", "blk"))
    while True:
        sums = now.join(rows, "v").groupBy("blk").agg(*[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(w))]).collect()
        load = np.zeros((len(w), k))
        for r in sums:
            load[:, r["blk"]] = [r[f"s{i}"] for i in range(len(w))]
        over = [int(b) for b in np.flatnonzero((load / targets - 1 > eps).any(axis=0))]
        if not over:
            break
        tight = F.coalesce(F.try_divide(F.element_at("near", 1)["dist"], F.element_at("near", 2)["dist"]), F.lit(1.0))
        cand = settle(now.filter(F.col("blk").isin(over)).join(fuzzy, "v").filter(F.size("near") > 1).select("v", "blk", "near", tight.alias("tight")))
        score = (lambda x: tuple(np.sort(x.max(axis=0))[::-1])) if settings.balance_method != "reb_sqimba" else (lambda x: float((np.maximum(x, 0) ** 2).sum()))
        moves, last = [], None
        while not moves:
            left = cand if last is None else cand.filter((F.col("tight") < last["tight"]) | ((F.col("tight") == last["tight"]) & (F.col("v") > last["v"])))
            some = left.orderBy(F.desc("tight"), "v").limit(batch).join(rows, "v").orderBy(F.desc("tight"), "v").collect()
            for r in some:
                have, own = np.array(r["w"]), r["blk"]
                if (load[:, own] / targets[:, own] - 1 <= eps[:, 0]).all():
                    continue
                for s in r["near"]:
                    to = s["c"]
                    if to == own:
                        continue
                    trial = load.copy()
                    trial[:, own] -= have
                    trial[:, to] += have
                    if (trial[:, to] / targets[:, to] - 1 <= eps[:, 0]).all() and score(trial / targets - 1) < score(load / targets - 1):
                        load = trial
                        moves.append((r["v"], to))
                        break
            if len(some) < batch:
                break
            last = some[-1]
        forget(cand)
        if not moves:
            break
        m = points.sparkSession.createDataFrame(moves, "v long, to int")
        fresh = settle(now.join(F.broadcast(m), "v", "left").select("v", F.coalesce("to", "blk").alias("blk")))
        forget(now)
        now = fresh
    return now


def balance(points: DataFrame, partition: DataFrame, axes: Sequence[str], k: int, weights: Sequence[str] = (), targets=None, settings: Settings | None = None, tries: int = 5, key: str = "v") -> DataFrame:
    """The most balanced of some tries, each with epsilons lowered by a sixth of what is missing, by rebalance() or by
    repartition(), as settings.balance_method says."""
    settings = settings or Settings(num_blocks=k)
    t = _targets(points, weights, k, targets, settings.epsilon)
    goal = np.array(settings.epsilons or [settings.epsilon] * len(t))
    eps, now, best, best_off = goal.copy(), partition, partition, float("inf")
    for _ in range(tries):
        own = Settings(**{**settings.__dict__, "epsilons": [float(e) for e in eps]})
        if settings.balance_method == "repart":
            now, c = repartition(points, now, axes, k, weights, t, own, key)
            now = settle(now)
        else:
            found = {r["blk"]: [float(r[a]) for a in axes] for r in block_centres(points, now, axes, weights, key).collect()}
            c = Clusters(np.array([found.get(b, [0.0] * len(axes)) for b in range(k)]), np.ones((len(t), k)), np.zeros(k, np.int32))
            now = rebalance(points, now, fuzzify(points, axes, c, key=key), k, weights, t, own, key=key)
        w = list(weights) or ["__one"]
        rows = points.withColumn("__one", F.lit(1.0)).select(F.col(key).alias("v"), *w).join(now, "v").groupBy("blk").agg(*[F.sum(F.col(x).cast("double")).alias(f"s{i}") for i, x in enumerate(w)]).collect()
        load = np.zeros_like(t)
        for r in rows:
            load[:, r["blk"]] = [r[f"s{i}"] for i in range(len(w))]
        off = (load / t - 1).max(axis=1)
        if off.max() < best_off:
            best, best_off = now, float(off.max())
        if (off <= goal).all():
            break
        eps = np.maximum(eps - np.maximum(off - goal, 0) / 6, 1e-4)
    return best
