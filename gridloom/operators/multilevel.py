"""Multilevel refinement: coarsening by matching, and pairwise Fiduccia-Mattheyses moves between blocks.

Matching is a handshake: each vertex points at its best neighbour of its own block, mutual pairs merge. Contraction is
two joins and a grouped sum. Refinement goes through the colours of the block graph; in one colour every block meets at
most one other, and each pair's border region is one group that a Python kernel refines; a region beyond the bound of a
task is dealt into several groups, which take turns."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import graph
from gridloom.session import forget, settle
from gridloom.settings import Settings

#: Vertices of a region that one task refines at once.
REGION_MOST = 50_000


def rated(edges: DataFrame, vertices: DataFrame, partition: DataFrame | None = None) -> DataFrame:
    """(src, dst, rating = w^2 / (weight(src) * weight(dst))) of the edges that may be contracted."""
    w = vertices.select("v", F.col("w0").cast("double").alias("w0"))
    e = (edges if partition is None else graph.with_blocks(edges, partition).filter("bs = bd")).filter("src <> dst").select("src", "dst", F.col("w").cast("double").alias("w"))
    e = e.join(w.select(F.col("v").alias("src"), F.col("w0").alias("ws")), "src").join(w.select(F.col("v").alias("dst"), F.col("w0").alias("wd")), "dst")
    return e.select("src", "dst", (F.col("w") * F.col("w") / (F.col("ws") * F.col("wd"))).alias("rating"))


def best_partner(ratings: DataFrame) -> DataFrame:
    """(v, mate): the neighbour of best rating; a tie goes to a pair hash, so that chains of equal ratings still pair up."""
    tie = F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"))
    return ratings.groupBy(F.col("src").alias("v")).agg(F.max_by("dst", F.struct("rating", tie, "dst")).alias("mate"))


def nearest_partner(edges: DataFrame, points: DataFrame, axes) -> DataFrame:
    """(v, mate): the nearest neighbour by coordinates."""
    p = points.select("v", F.array(*[F.col(a).cast("double") for a in axes]).alias("x"))
    e = edges.filter("src <> dst").join(p.select(F.col("v").alias("src"), F.col("x").alias("a")), "src").join(p.select(F.col("v").alias("dst"), F.col("x").alias("b")), "dst")
    d = F.aggregate(F.zip_with("a", "b", lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda s, t: s + t)
    return e.groupBy(F.col("src").alias("v")).agg(F.min_by("dst", F.struct(d, "dst")).alias("mate"))


def matching(edges: DataFrame, vertices: DataFrame, partition: DataFrame | None = None, rounds: int = 4) -> DataFrame:
    """(a, b), a < b: disjoint pairs. Each round matches the mutual best pairs among what is still free."""
    ratings, pairs = settle(rated(edges, vertices, partition)), None
    for _ in range(rounds):
        best = best_partner(ratings)
        back = best.select(F.col("mate").alias("v"), F.col("v").alias("mate"))
        new = settle(best.join(back, ["v", "mate"]).filter("v < mate").select(F.col("v").alias("a"), F.col("mate").alias("b")))
        pairs = new if pairs is None else pairs.unionByName(new)
        if new.isEmpty():
            break
        used = new.select(F.explode(F.array("a", "b")).alias("u"))
        ratings = settle(ratings.join(used, ratings.src == used.u, "left_anti").join(used, ratings.dst == used.u, "left_anti"))
    return pairs


def contraction(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(v, c): coarse id of each vertex, the smaller id of its pair."""
    m = pairs.select(F.col("b").alias("v"), F.col("a").alias("c"))
    return vertices.select("v").join(m, "v", "left").select("v", F.coalesce("c", "v").alias("c"))


def contract(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between coarse vertices, parallel ones merged, inner ones gone."""
    e = edges.join(mapping.select(F.col("v").alias("src"), F.col("c").alias("cs")), "src").join(mapping.select(F.col("v").alias("dst"), F.col("c").alias("cd")), "dst")
    return e.filter("cs <> cd").groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum(F.col("w").cast("double")).alias("w"))


def to_coarse(values: DataFrame, mapping: DataFrame, column: str, how: str = "avg") -> DataFrame:
    """(v, column) of the coarse vertices: mean or sum of the fine values."""
    f = F.sum if how == "sum" else F.avg
    return values.join(mapping, "v").groupBy("c").agg(f(F.col(column).cast("double")).alias(column)).withColumnRenamed("c", "v")


def to_fine(coarse: DataFrame, mapping: DataFrame) -> DataFrame:
    """coarse(v, blk) handed to the fine vertices."""
    return mapping.join(coarse.withColumnRenamed("v", "c"), "c").drop("c")


def coarsen(vertices: DataFrame, edges: DataFrame, partition: DataFrame | None = None, rounds: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(coarse vertices with w0, coarse edges, mapping v -> c) after some rounds of matching and contraction."""
    v, e, p, total = vertices.select("v", "w0"), edges, partition, None
    for _ in range(rounds):
        m = settle(contraction(v, matching(e, v, p)))
        e = settle(contract(e, m))
        v = settle(to_coarse(v, m, "w0", "sum"))
        if p is not None:
            p = settle(p.join(m, "v").groupBy("c").agg(F.min("blk").alias("blk")).withColumnRenamed("c", "v"))
        total = m if total is None else settle(total.join(m.select(F.col("v").alias("c"), F.col("c").alias("cc")), "c").select("v", F.col("cc").alias("c")))
    return v, e, total


def interface(edges: DataFrame, partition: DataFrame, a: int, b: int, rounds: int = 1) -> DataFrame:
    """(v, hop): vertices of blocks a and b within some hops of the border between the two, 0 at the border."""
    both = graph.with_blocks(edges, partition).filter(F.col("bs").isin(a, b) & F.col("bd").isin(a, b))
    border = both.filter("bs <> bd").select(F.col("src").alias("v")).distinct()
    return graph.bfs(both.select("src", "dst", "w"), border, rounds).select("v", F.col("dist").alias("hop"))


def degree_sum(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return edges.join(vertices.select(F.col("v").alias("src")), "src", "left_semi").agg(F.count("*").alias("degrees"))


def centre_distances(points: DataFrame, partition: DataFrame, axes) -> DataFrame:
    """(v, dist): distance to the unweighted centroid of the own block."""
    p = points.join(partition, "v")
    c = p.groupBy("blk").agg(*[F.avg(F.col(a).cast("double")).alias(f"c_{a}") for a in axes])
    d = F.sqrt(sum(((F.col(a) - F.col(f"c_{a}")) * (F.col(a) - F.col(f"c_{a}")) for a in axes), F.lit(0.0)))
    return p.join(F.broadcast(c), "blk").select("v", d.alias("dist"))


def diffusion_load(near: list[list[tuple[int, float]]], side: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Load after some diffusion rounds from +1 on one side and -1 on the other: how deep a vertex lies in its side."""
    load = np.where(side == 0, 1.0, -1.0)
    alpha = 1.0 / (max((len(x) for x in near), default=0) + 1)
    for _ in range(rounds):
        load = load + alpha * np.array([sum(load[y] - load[x] for y, _ in row) for x, row in enumerate(near)])
    return load


def two_way_fm(near: list[list[tuple[int, float]]], outside: np.ndarray, side: np.ndarray, weight: np.ndarray, size: list[float], most: list[float], tie: np.ndarray, gain_first: bool = False, patience: int = 0) -> tuple[np.ndarray, float]:
    """Sides after one Fiduccia-Mattheyses pass over a region, and the gain in cut weight.

    near: neighbours inside the region; outside[x, s]: weight from x to fixed vertices of side s. Vertices move once, by
    gain and then tie; the fuller side gives unless gain_first; a move must not lift the other side over ``most``. The
    best prefix is kept; a prefix of equal cut but better balance wins."""
    side = side.copy()
    gain = np.array([sum(w if side[y] != side[x] else -w for y, w in row) for x, row in enumerate(near)]) + outside[np.arange(len(side)), 1 - side] - outside[np.arange(len(side)), side]
    queues: list[list] = [[], []]
    for x in range(len(side)):
        heapq.heappush(queues[side[x]], (-gain[x], tie[x], x))
    moved = np.zeros(len(side), dtype=bool)
    total, best, best_at, order = 0.0, 0.0, 0, []
    over = lambda: max(size[0] / most[0], size[1] / most[1]) if min(most) > 0 else 0.0
    best_over = over()

    def top(s: int):
        q = queues[s]
        while q and (moved[q[0][2]] or -q[0][0] != gain[q[0][2]] or side[q[0][2]] != s):
            heapq.heappop(q)
        return q[0] if q else None

    while True:
        ends = [top(0), top(1)]
        fits = [ends[s] is not None and size[1 - s] + weight[ends[s][2]] <= most[1 - s] for s in (0, 1)]
        if not any(fits):
            break
        if all(fits):
            fuller = 0 if size[0] / max(most[0], 1e-300) >= size[1] / max(most[1], 1e-300) else 1
            s = min((0, 1), key=lambda i: (ends[i][0], i)) if gain_first else fuller
        else:
            s = fits.index(True)
        _, _, x = heapq.heappop(queues[s])
        moved[x] = True
        total += gain[x]
        size[s] -= weight[x]
        size[1 - s] += weight[x]
        side[x] = 1 - s
        order.append(x)
        for y, w in near[x]:
            if not moved[y]:
                gain[y] += -2 * w if side[y] == side[x] else 2 * w
                heapq.heappush(queues[side[y]], (-gain[y], tie[y], y))
        now = over()
        if total > best + 1e-12 or (abs(total - best) <= 1e-12 and now < best_over - 1e-12):
            best, best_at, best_over = total, len(order), now
        elif patience and len(order) - best_at >= patience:
            break
    for x in order[best_at:]:
        side[x] = 1 - side[x]
    return side, best


def _refine_pair(settings: Settings):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["dst"].isna()]
        ids = np.sort(nodes["src"].to_numpy())
        at = {int(v): i for i, v in enumerate(ids)}
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        rows = nodes.set_index("src").loc[ids]
        side = (rows["bs"].to_numpy() == b).astype(int)
        weight, tie = rows["w"].to_numpy(), rows["tie"].to_numpy()
        near: list[list[tuple[int, float]]] = [[] for _ in ids]
        outside = np.zeros((len(ids), 2))
        for s, d, w, bd in pdf[pdf["dst"].notna()][["src", "dst", "w", "bd"]].itertuples(index=False):
            i, j = at[int(s)], at.get(int(d))
            if j is None:
                outside[i, int(bd == b)] += w
            elif i != j:
                near[i].append((j, w))
        size = [float(pdf["size_a"].iloc[0]), float(pdf["size_b"].iloc[0])]
        most = [float(pdf["most_a"].iloc[0]), float(pdf["most_b"].iloc[0])]
        if settings.use_diffusion_tie_break:
            load = diffusion_load(near, side)
            tie = np.where(side == 0, load, -load)
        new, gain = two_way_fm(near, outside, side, weight, size, most, tie, settings.gain_over_balance, settings.stop_after_no_gain)
        return pd.DataFrame({"v": ids, "blk": np.where(new == 1, b, a).astype("int32"), "gain": float(gain)})

    return run


def refine(vertices: DataFrame, edges: DataFrame, partition: DataFrame, k: int, most: np.ndarray, settings: Settings | None = None, points: DataFrame | None = None, axes=()) -> tuple[DataFrame, float]:
    """One round over all colours: (v, blk) and the total gain. vertices(v, w0); most[b] is block b's capacity. A pair's
    region is its border and some hops around it. A region of more than REGION_MOST vertices is dealt by hash into groups
    of fewer, so a task stays bounded; they are refined in turn, the others fixed where the turns before have put them."""
    settings = settings or Settings(num_blocks=k)
    spark = vertices.sparkSession
    w = vertices.select("v", F.col("w0").cast("double").alias("w0"))
    now, gained = settle(partition.select("v", F.col("blk").cast("int").alias("blk"))), 0.0
    colours: dict[int, list[tuple[int, int]]] = {}
    for c, a, b in graph.communication_pairs(edges, now):
        colours.setdefault(c, []).append((a, b))

    def sides(pairs: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
        """The blocks of a colour with their loads, and the edges inside their pairs, as of now."""
        load = {r["blk"]: r["weight"] for r in graph.block_weights(now, k, w).collect()}
        rows = [(x, a, b, load[a], load[b], float(most[a]), float(most[b])) for a, b in pairs for x in (a, b)]
        pair = F.broadcast(spark.createDataFrame(rows, "bs int, a int, b int, size_a double, size_b double, most_a double, most_b double"))
        return pair, settle(graph.with_blocks(edges, now).join(pair, "bs").filter("bd = a or bd = b"))

    for c in sorted(colours):
        pair, e = sides(colours[c])
        region = settle(e.filter("bs <> bd").select(F.col("src").alias("v"), "a").distinct().withColumn("hop", F.lit(0)))
        for hop in range(1, max(1, settings.min_border_nodes) + 1):
            ring = e.filter("bs = bd").join(region.select(F.col("v").alias("src")), "src", "left_semi").select(F.col("dst").alias("v"), "a").distinct().join(region.select("v"), "v", "left_anti")
            region = settle(region.unionByName(ring.withColumn("hop", F.lit(hop))))
        n = region.groupBy("a").agg(F.count("*").alias("n"))
        # Groups by hash are not all of one size, so they aim at nine tenths of the bound.
        groups = F.when(F.col("n") <= REGION_MOST, F.lit(1)).otherwise(F.ceil(F.col("n") * 10 / (REGION_MOST * 9)))
        region = settle(region.join(F.broadcast(n), "a").select("v", "a", F.pmod(F.xxhash64("v", F.lit(settings.seed)), groups).cast("int").alias("turn")))
        for turn in range(1 + (region.agg(F.max("turn")).first()[0] or 0)):
            if turn:
                forget(e)
                pair, e = sides(colours[c])
            group = region.filter(F.col("turn") == turn).select("v", "a")
            tie = F.xxhash64("v", F.lit(settings.seed)).cast("double")
            nodes = group.join(now, "v").join(w, "v")
            if settings.use_geometric_tie_break and points is not None:
                nodes = nodes.join(centre_distances(points, now, axes), "v")
                tie = -F.col("dist")
            nodes = nodes.join(pair.drop("a").withColumnRenamed("b", "pb"), nodes.blk == F.col("bs")).select(F.col("v").alias("src"), F.lit(None).cast("long").alias("dst"), F.col("w0").alias("w"), "bs", F.lit(None).cast("int").alias("bd"), "a", F.col("pb").alias("b"), "size_a", "size_b", "most_a", "most_b", tie.alias("tie"))
            inner = e.join(group.select(F.col("v").alias("src")), "src", "left_semi").select("src", "dst", F.col("w").cast("double").alias("w"), "bs", "bd", "a", "b", "size_a", "size_b", "most_a", "most_b", F.lit(0.0).alias("tie"))
            out = settle(nodes.unionByName(inner).groupBy("a").applyInPandas(_refine_pair(settings), "v long, blk int, gain double").join(group.select(F.col("v"), "a"), "v"))
            gained += sum(r[1] for r in out.groupBy("a").agg(F.max("gain")).collect())
            now = settle(now.join(out.select("v", F.col("blk").alias("to")), "v", "left").select("v", F.coalesce("to", "blk").alias("blk")))
    return now, gained


def multilevel(vertices: DataFrame, edges: DataFrame, partition: DataFrame, k: int, most: np.ndarray, settings: Settings | None = None, points: DataFrame | None = None, axes=(), rounds: int | None = None, most_passes: int = 10) -> DataFrame:
    """(v, blk): coarsen, refine the coarse graph first, hand its blocks down, refine again until a pass gains less than
    ``min_gain``."""
    settings = settings or Settings(num_blocks=k)
    rounds = settings.multilevel_rounds if rounds is None else rounds
    if rounds > 0:
        v, e, m = coarsen(vertices, edges, partition, settings.coarsening_steps)
        p = settle(partition.join(m, "v").groupBy("c").agg(F.min("blk").alias("blk")).withColumnRenamed("c", "v"))
        p = multilevel(v, e, p, k, most, settings, None, (), rounds - 1, most_passes)
        partition = settle(to_fine(p, m).select("v", "blk"))
    for _ in range(most_passes):
        partition, gain = refine(vertices, edges, partition, k, most, settings, points, axes)
        if gain < settings.min_gain:
            break
    return partition
