"""Graph operators on edges(src, dst, w), both directions stored, vertices(v, ...) and partition(v, blk)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ranks import dyadic_order, with_rank
from gridloom.session import forget, settle


def with_blocks(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """edges with bs and bd, the blocks of their ends: two equi-joins."""
    p = partition.select("v", "blk")
    return edges.join(p.select(F.col("v").alias("src"), F.col("blk").alias("bs")), "src").join(p.select(F.col("v").alias("dst"), F.col("blk").alias("bd")), "dst")


def cut_edges(edges: DataFrame, partition: DataFrame) -> DataFrame:
    return with_blocks(edges, partition).filter("bs <> bd")


def edge_cut(edges: DataFrame, partition: DataFrame, weighted: bool = True) -> DataFrame:
    """cut: half the weight (or number) of directed edges between blocks."""
    value = F.sum(F.col("w").cast("double")) if weighted else F.count("*").cast("double")
    return cut_edges(edges, partition).agg((F.coalesce(value, F.lit(0.0)) / 2).alias("cut"))


def block_weights(partition: DataFrame, k: int, weights: DataFrame | None = None, column: str = "w0") -> DataFrame:
    """(blk, weight) of all k blocks, zeros kept; an id outside 0..k-1 raises."""
    own = partition if weights is None else partition.join(weights.select("v", column), "v")
    value = F.count("*").cast("double") if weights is None else F.sum(F.col(column).cast("double"))
    blk = F.when(F.col("blk").between(0, k - 1), F.col("blk")).otherwise(F.raise_error(F.lit("block id out of range")).cast("int"))
    sums = own.select(blk.cast("int").alias("blk"), *([] if weights is None else [column])).groupBy("blk").agg(value.alias("weight"))
    all_blocks = partition.sparkSession.range(k).select(F.col("id").cast("int").alias("blk"))
    return all_blocks.join(sums, "blk", "left").select("blk", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def imbalance(partition: DataFrame, k: int, weights: DataFrame | None = None, column: str = "w0", targets: DataFrame | None = None) -> DataFrame:
    """imbalance: with targets(blk, target) the largest relative excess; with weights the excess over W/k + (largest -
    smallest weight); else that over n/k."""
    b = block_weights(partition, k, weights, column)
    if targets is not None:
        return b.join(F.broadcast(targets), "blk").agg(F.max((F.col("weight") - F.col("target")) / F.col("target")).alias("imbalance"))
    total = b.agg(F.max("weight").alias("most"), F.sum("weight").alias("sum"))
    if weights is None:
        return total.select(((F.col("most") - F.col("sum") / k) / (F.col("sum") / k)).alias("imbalance"))
    spread = weights.agg((F.max(F.col(column).cast("double")) - F.min(F.col(column).cast("double"))).alias("spread"))
    best = F.col("sum") / k + F.col("spread")
    return total.crossJoin(F.broadcast(spread)).select(((F.col("most") - best) / best).alias("imbalance"))


def border_nodes(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(v, border): 1 if a neighbour lies in another block."""
    on = cut_edges(edges, partition).select(F.col("src").alias("v")).distinct().withColumn("border", F.lit(1))
    return partition.select("v").join(on, "v", "left").select("v", F.coalesce("border", F.lit(0)).alias("border"))


def border_vertices(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """v of the vertices with a neighbour in another block."""
    return cut_edges(edges, partition).select(F.col("src").alias("v")).distinct()


def foreign_neighbours(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(blk, v): a row for each directed edge that leaves blk, with its far end (a multiset)."""
    return cut_edges(edges, partition).select(F.col("bs").alias("blk"), F.col("dst").alias("v"))


def border_counts(edges: DataFrame, partition: DataFrame, k: int) -> DataFrame:
    """(blk, border, inner)."""
    own = border_nodes(edges, partition).join(partition, "v").groupBy("blk").agg(F.sum("border").alias("border"), F.sum(1 - F.col("border")).alias("inner"))
    return _every(partition, k).join(own, "blk", "left").select("blk", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("border", "inner")])


def _every(partition: DataFrame, k: int) -> DataFrame:
    return partition.sparkSession.range(k).select(F.col("id").cast("int").alias("blk"))


def communication_volume(edges: DataFrame, partition: DataFrame, k: int) -> DataFrame:
    """(blk, volume): number of distinct (vertex, foreign block) pairs."""
    pairs = cut_edges(edges, partition).select("src", F.col("bs").alias("blk"), "bd").distinct()
    own = pairs.groupBy("blk").agg(F.count("*").alias("volume"))
    return _every(partition, k).join(own, "blk", "left").select("blk", F.coalesce("volume", F.lit(0)).cast("long").alias("volume"))


def communication(edges: DataFrame, partition: DataFrame, k: int) -> DataFrame:
    """(blk, volume, border, inner) from one pass over the cut."""
    per = cut_edges(edges, partition).select("src", F.col("bs").alias("blk"), "bd").distinct().groupBy("blk", "src").agg(F.count("*").alias("c"))
    own = per.groupBy("blk").agg(F.sum("c").alias("volume"), F.count("*").alias("border"))
    size = partition.groupBy("blk").agg(F.count("*").alias("size"))
    j = _every(partition, k).join(size, "blk", "left").join(own, "blk", "left")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return j.select("blk", z("volume").alias("volume"), z("border").alias("border"), (z("size") - z("border")).alias("inner"))


def block_graph(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(bs, bd, w): sum of cut weights between blocks, both directions."""
    return cut_edges(edges, partition).groupBy("bs", "bd").agg(F.sum(F.col("w").cast("double")).alias("w"))


def owner_graph(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(bs, bd, w): number of edges between owners(v, blk)."""
    return cut_edges(edges, owners).groupBy("bs", "bd").agg(F.count("*").cast("double").alias("w"))


def block_graph_degree(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(max_degree, edges) of the block graph; edges are undirected."""
    per = cut_edges(edges, partition).select("bs", "bd").distinct().groupBy("bs").agg(F.count("*").alias("d"))
    return per.agg(F.coalesce(F.max("d"), F.lit(0)).cast("long").alias("max_degree"), F.coalesce((F.sum("d") / 2).cast("long"), F.lit(0)).cast("long").alias("edges"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def max_degree(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg(F.max("degree").alias("max_degree"))


def has_self_loops(edges: DataFrame) -> bool:
    return not edges.filter("src = dst").limit(1).isEmpty()


def asymmetric(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is missing; empty for a valid graph."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return edges.join(back, ["src", "dst"], "left_anti")


def outgoing_weight(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(blk, out): weight of the edges that leave each block."""
    return cut_edges(edges, partition).groupBy(F.col("bs").alias("blk")).agg(F.sum(F.col("w").cast("double")).alias("out"))


def symmetrised(pairs: DataFrame, reverse: bool = True, drop_loops: bool = True) -> DataFrame:
    """edges(src, dst, w=1) of pairs(u, v): 1-based ids shift to 0, the other direction is added, copies and loops go."""
    low = pairs.agg(F.min(F.least("u", "v"))).first()[0]
    shift = 0 if low in (0, None) else 1
    e = pairs.select((F.col("u") - shift).alias("src"), (F.col("v") - shift).alias("dst"))
    if reverse:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if drop_loops:
        e = e.filter("src <> dst")
    return e.distinct().withColumn("w", F.lit(1.0))


def adjacency_edges(lists: DataFrame) -> DataFrame:
    """edges of rows (v, neighbours array)."""
    return lists.select(F.col("v").alias("src"), F.explode("neighbours").alias("dst")).distinct().withColumn("w", F.lit(1.0))


def laplacian(edges: DataFrame, factor: float = 1.0) -> DataFrame:
    """(row, col, value): -w off the diagonal, factor times the weighted degree on it; factor 1.1 makes it positive
    definite, as the solvers need."""
    off = edges.filter("src <> dst").select(F.col("src").alias("row"), F.col("dst").alias("col"), (-F.col("w").cast("double")).alias("value"))
    on = edges.filter("src <> dst").groupBy("src").agg((F.sum(F.col("w").cast("double")) * factor).alias("value")).select(F.col("src").alias("row"), F.col("src").alias("col"), "value")
    return off.unionByName(on)


def relabelled(vertices: DataFrame, edges: DataFrame, keys: Sequence[str] = ("v",)) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges with dense ids in the order of the keys; the old id stays as old_v."""
    ids = with_rank(vertices, list(keys)).withColumnRenamed("v", "old_v").withColumnRenamed("rank", "v")
    m = ids.select("old_v", "v")
    e = edges.join(m.select(F.col("old_v").alias("src"), F.col("v").alias("a")), "src").join(m.select(F.col("old_v").alias("dst"), F.col("v").alias("b")), "dst")
    return ids, e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")


def shuffled_prefix(vertices: DataFrame, n: int, seed: int) -> DataFrame:
    """n vertices in a random order that depends on the seed and the ids alone."""
    return vertices.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(n)


def sampling_order(vertices: DataFrame, bits: int) -> DataFrame:
    """vertices with the rank of the dyadic order of their dense ids v < 2**bits."""
    return with_rank(vertices.withColumn("__k", dyadic_order(F.col("v"), bits)), ["__k", "v"], out="order").drop("__k")


def block_ranges(partition: DataFrame) -> DataFrame:
    """(blk, first, stop): id ranges once vertices are renumbered block by block."""
    from pyspark.sql import Window

    size = partition.groupBy("blk").agg(F.count("*").alias("n"))
    upto = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)
    return size.withColumn("stop", F.sum("n").over(upto)).select("blk", (F.col("stop") - F.col("n")).alias("first"), "stop")


def bfs(edges: DataFrame, sources: DataFrame, rounds: int | None = None, within: DataFrame | None = None) -> DataFrame:
    """(v, dist): hops from the nearest source; unreachable vertices are left out. With a partition, only edges inside a
    block count. Every level is one join of the frontier, and one anti join with what was seen."""
    e = edges if within is None else with_blocks(edges, within).filter("bs = bd")
    e = settle(e.select("src", "dst").distinct())
    seen = settle(sources.select("v", F.lit(0).alias("dist")).distinct())
    level = 0
    while rounds is None or level < rounds:
        level += 1
        front = seen.filter(F.col("dist") == level - 1)
        new = front.join(e, front.v == e.src).select(F.col("dst").alias("v")).distinct().join(seen, "v", "left_anti").withColumn("dist", F.lit(level))
        grown = settle(seen.unionByName(new))
        forget(seen)
        seen = grown
        if seen.filter(F.col("dist") == level).isEmpty():
            break
    forget(e)
    return seen


def shortest_paths(edges: DataFrame, source: int, within: DataFrame | None = None, most_rounds: int = 10_000) -> DataFrame:
    """(v, dist, pred): least total weight from the source (weights must not be negative), by rounds of relaxation that
    only the improved vertices take part in; exact at the fixed point. The source's pred is itself."""
    e = edges if within is None else with_blocks(edges, within).filter("bs = bd")
    e = settle(e.select("src", "dst", F.col("w").cast("double").alias("w")))
    spark = edges.sparkSession
    best = settle(spark.createDataFrame([(source, 0.0, source, 0)], "v long, dist double, pred long, at int"))
    for r in range(1, most_rounds):
        front = best.filter(F.col("at") == r - 1)
        step = front.join(e, front.v == e.src).select(F.col("dst").alias("v"), (F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("pred"))
        step = step.groupBy("v").agg(F.min(F.struct("dist", "pred")).alias("s"))
        better = F.col("s").isNotNull() & (F.col("dist").isNull() | (F.col("s.dist") < F.col("dist")))
        pick = lambda n: F.when(better, F.col(f"s.{n}")).otherwise(F.col(n)).alias(n)  # noqa: B023, E731
        fresh = settle(best.join(step, "v", "full").select("v", pick("dist"), pick("pred"), F.when(better, F.lit(r)).otherwise(F.col("at")).alias("at")))
        forget(best)
        best = fresh
        if best.filter(F.col("at") == r).isEmpty():
            forget(e)
            return best.select("v", "dist", "pred")
    raise RuntimeError("shortest paths did not settle")


def _fringe(depth: int, at, depth_of, most_rounds: int) -> tuple[int, bool]:
    """(diameter, exact) from a search of some depth: at(level) gives vertices of a level, depth_of(x) the depth of a
    search from x. After most_rounds searches the diameter is a lower bound."""
    low, high, rounds, level = depth, 2 * depth, 0, depth
    while low < high and rounds < most_rounds:
        for x in at(level):
            low, rounds = max(low, depth_of(x)), rounds + 1
            if rounds >= most_rounds:
                break
        else:
            high = max(low, 2 * (level - 1))
            level -= 1
            continue
        break
    return low, low >= high


def _wide_diameter(inner: DataFrame, vertices: DataFrame, size: int, most_rounds: int) -> tuple[int | None, bool]:
    """(diameter, exact) of one block by bfs(), from its inner edges(src, dst) and vertices(v)."""
    first = degrees(inner).orderBy(F.desc("degree"), "v").first() or vertices.orderBy("v").first()
    search = lambda x: bfs(inner, inner.sparkSession.createDataFrame([(x,)], "v long"))

    def depth_of(x: int) -> int:
        d = search(x)
        out = d.agg(F.max("dist")).first()[0]
        forget(d)
        return out

    d = search(first["v"])
    depth, reached = d.agg(F.max("dist"), F.count("*")).first()
    if reached < size:
        forget(d)
        return None, True
    found = _fringe(depth, lambda level: [r["v"] for r in d.filter(F.col("dist") == level).select("v").orderBy("v").limit(most_rounds).collect()], depth_of, most_rounds)
    forget(d)
    return found


def block_diameter(edges: DataFrame, partition: DataFrame, most_rounds: int = 100, most_vertices: int = 200_000) -> DataFrame:
    """(blk, diameter, exact): iterated fringe bounds in each block; null if the block is disconnected. A block of at most
    most_vertices vertices is searched in one task, a larger one by bfs() over all tasks, for the same result."""
    inner = with_blocks(edges, partition).filter("bs = bd and src <> dst").select(F.col("bs").alias("blk"), "src", "dst")
    alone = partition.select("blk", F.col("v").alias("src"), F.lit(None).cast("long").alias("dst"))
    size = partition.groupBy("blk").agg(F.count("*").alias("size"))
    rows = inner.unionByName(alone).join(F.broadcast(size), "blk")
    small = rows.filter(F.col("size") <= most_vertices)

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        ids = np.unique(pdf["src"].to_numpy())
        e = pdf.dropna()
        a, b = np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"].astype("int64"))
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        first = np.searchsorted(a, np.arange(len(ids) + 1))

        def levels(s):
            d = np.full(len(ids), -1)
            d[s], front, level = 0, np.array([s]), 0
            while len(front):
                level += 1
                near = np.unique(np.concatenate([b[first[x] : first[x + 1]] for x in front])) if len(front) else front
                front = near[d[near] < 0].astype(int)
                d[front] = level
            return d

        start = int(np.argmax(np.diff(first)))
        d = levels(start)
        if (d < 0).any():
            return pd.DataFrame({"blk": [key[0]], "diameter": [None], "exact": [True]}, columns=["blk", "diameter", "exact"]).astype({"diameter": "Int64"})
        low, exact = _fringe(int(d.max()), lambda level: np.flatnonzero(d == level), lambda x: int(levels(x).max()), most_rounds)
        return pd.DataFrame({"blk": [key[0]], "diameter": pd.array([low], dtype="Int64"), "exact": [exact]})

    done = small.select("blk", "src", "dst").groupBy("blk").applyInPandas(run, "blk int, diameter long, exact boolean")
    large = size.filter(F.col("size") > most_vertices).orderBy("blk").collect()
    if not large:
        return done
    wide = settle(inner.join(F.broadcast(size.filter(F.col("size") > most_vertices)), "blk").select("blk", "src", "dst"))
    found = []
    for r in large:
        own = F.col("blk") == r["blk"]
        found.append((int(r["blk"]), *_wide_diameter(wide.filter(own).select("src", "dst"), partition.filter(own).select("v"), r["size"], most_rounds)))
    forget(wide)
    return done.unionByName(edges.sparkSession.createDataFrame(found, "blk int, diameter long, exact boolean"))


def edge_colouring(pairs: Sequence[tuple[int, int, float]]) -> list[tuple[int, int, int]]:
    """(colour, a, b) for undirected block pairs: heaviest first, smallest colour free at both ends."""
    used: dict[int, set[int]] = {}
    out = []
    for a, b, _ in sorted({(min(a, b), max(a, b), w) for a, b, w in pairs if a != b}, key=lambda e: (-e[2], e[0], e[1])):
        taken = used.setdefault(a, set()) | used.setdefault(b, set())
        colour = next(c for c in range(len(taken) + 1) if c not in taken)
        used[a].add(colour)
        used[b].add(colour)
        out.append((colour, a, b))
    return out


def communication_pairs(edges: DataFrame, partition: DataFrame) -> list[tuple[int, int, int]]:
    """Rounds in which blocks meet pairwise: an edge colouring of the block graph (k blocks, on the driver)."""
    return edge_colouring([(r.bs, r.bd, r.w) for r in block_graph(edges, partition).filter("bs < bd").collect()])


def hadamard(n: int):
    """Normalised sign matrix of size n (a power of two): the sign is the parity of the common bits of row and column."""
    import numpy as np

    i = np.arange(n)
    common = i[:, None] & i[None, :]
    parity = np.zeros_like(common)
    while common.any():
        parity ^= common & 1
        common = common >> 1
    return (1 - 2 * parity) / np.sqrt(n)


def johnson_lindenstrauss(epsilon: float, original: int, n: int, seed: int = 0, scale: float = 0.1):
    """Fast projection matrix P * H * D (experimental): target dimension scale * log(n) / epsilon**2, at least 1."""
    import math

    import numpy as np

    size = 1 << max(0, (original - 1).bit_length())
    target = max(1, math.ceil(scale * math.log(max(n, 2)) / epsilon**2))
    rng = np.random.default_rng(seed)
    q = min(1.0, math.log(max(n, 2)) ** 2 / size)
    keep = rng.random((target, size)) < q
    p = np.where(keep, rng.normal(0, 1 / math.sqrt(q), (target, size)), 0.0)
    signs = rng.choice([-1.0, 1.0], size)
    return (p @ hadamard(size) * signs)[:, :original]
