"""Partitioners, graph metrics, topology and files against known values and invariants."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import hilbert
from gridloom.operators import diffusion, graph, kmeans, metrics, multilevel, multisection, pixel, ranks, sfc, spatial, topology
from gridloom.plans import run as plan
from gridloom.settings import Settings, Tool
from gridloom.sources import files, generate, sinks
from gridloom.streaming import assign


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def value(df):
    return df.first()[0]


@pytest.fixture(scope="module")
def grid8(spark):
    v, e = generate.grid(spark, (8, 8))
    return v.cache(), e.cache()


@pytest.fixture(scope="module")
def quarters(spark, grid8):
    return grid8[0].select("v", (F.floor(F.col("x") / 4) * 2 + F.floor(F.col("y") / 4)).cast("int").alias("blk")).cache()


def test_grid_edges_count(spark):
    for a, b, c in ((3, 4, 5), (2, 2, 1), (7, 1, 3)):
        _, e = generate.grid(spark, (a, b, c))
        assert e.count() == 2 * (3 * a * b * c - a * b - a * c - b * c)
        assert graph.asymmetric(e).count() == 0


def test_quarters_of_a_grid(grid8, quarters):
    _, e = grid8
    assert value(graph.edge_cut(e, quarters)) == 16
    assert rows(graph.communication(e, quarters, 4)) == [(b, 8, 7, 9) for b in range(4)]
    assert rows(graph.communication_volume(e, quarters, 4)) == [(b, 8) for b in range(4)]
    assert rows(graph.border_counts(e, quarters, 4)) == [(b, 7, 9) for b in range(4)]
    assert rows(graph.block_graph(e, quarters)) == [(a, b, 4.0) for a in range(4) for b in range(4) if a != b and a + b != 3]
    assert tuple(graph.block_graph_degree(e, quarters).first()) == (2, 4)
    m = {r["metric"]: r["value"] for r in metrics.easy_metrics(e, quarters, 4).collect()}
    assert m["finalCut"] == 16 and m["finalImbalance"] == 0 and m["totalCommVolume"] == 32 and m["maxBorderNodesPercent"] == 7 / 16
    assert "finalCut: 16" in metrics.as_text(metrics.easy_metrics(e, quarters, 4))


def test_imbalance_values(spark, grid8):
    v, _ = grid8
    p = v.select("v", (F.col("v") % 4).cast("int").alias("blk"))
    assert value(graph.imbalance(p, 4)) == 0
    moved = p.withColumn("blk", F.when(F.col("v") % 8 == 0, 1).otherwise(F.col("blk")))
    assert value(graph.imbalance(moved, 4)) == 0.5
    w = v.select("v", (F.col("v") % 4 + 1).cast("double").alias("w0"))
    assert value(graph.imbalance(p, 4, w)) == pytest.approx(21 / 43)
    for t, want in (((16, 32, 48, 64), 0), ((16, 32, 40, 64), 0.2), ((10, 30, 40, 60), 0.6)):
        targets = spark.createDataFrame([(b, float(x)) for b, x in enumerate(t)], "blk int, target double")
        assert value(graph.imbalance(p, 4, w, targets=targets)) == pytest.approx(want)
    with pytest.raises(Exception, match="out of range"):
        graph.block_weights(p, 3).collect()


def test_complete_graph_cut(spark):
    n, k = 100, 10
    e = spark.range(n).select(F.col("id").alias("src")).crossJoin(spark.range(n).select(F.col("id").alias("dst"))).withColumn("w", F.lit(1.0))
    p = spark.range(n).select(F.col("id").alias("v"), F.floor(F.col("id") / 10).cast("int").alias("blk"))
    assert value(graph.edge_cut(e, p)) == k * 10 * (n - 10) / 2
    assert value(graph.imbalance(p.withColumn("blk", F.lit(0)), 20)) == 19
    assert graph.has_self_loops(e) and not graph.has_self_loops(e.filter("src <> dst"))


def test_shortest_paths_and_bfs(spark):
    _, e = generate.grid(spark, (4, 4))
    d = {r["v"]: r["dist"] for r in graph.shortest_paths(e, 0).collect()}
    assert d[15] == 6 and d[7] == 4
    assert {r["v"]: r["dist"] for r in graph.bfs(e, spark.createDataFrame([(0,)], "v long")).collect()} == d
    w = lambda e, a, b, x: e.withColumn("w", F.when(F.least("src", "dst").eqNullSafe(a) & F.greatest("src", "dst").eqNullSafe(b), x).otherwise(F.col("w")))
    e = w(e, 11, 15, 0.5)
    assert {r["v"]: r["dist"] for r in graph.shortest_paths(e, 0).collect()}[15] == 5.5
    d = {r["v"]: r["dist"] for r in graph.shortest_paths(w(e, 9, 10, 0.3), 0).collect()}
    assert d[15] == pytest.approx(4.8) and d[11] == pytest.approx(4.3)


def test_diameters(spark, grid8, quarters):
    _, e = grid8
    assert rows(graph.block_diameter(e, quarters)) == [(b, 6, True) for b in range(4)]
    m = {r["metric"]: r["value"] for r in metrics.diameter_metrics(e, quarters).collect()}
    assert m == {"maxBlockDiameter": 6.0, "harmMeanDiam": 6.0, "numDisconBlocks": 0.0}
    odd = quarters.select("v", (F.col("v") % 2).cast("int").alias("blk"))
    assert {r["metric"]: r["value"] for r in metrics.diameter_metrics(e, odd).collect()}["numDisconBlocks"] == 2


def test_diameters_of_large_blocks(spark):
    v, e = generate.grid(spark, (4, 4))
    # A path, a grid of eight vertices, a block in two parts, and one of a single vertex.
    last = F.when(F.col("x") == 1, 3).otherwise(2)
    p = v.select("v", F.when(F.col("y") == 0, 0).when(F.col("y") < 3, 1).otherwise(last).cast("int").alias("blk")).cache()
    want = [(0, 3, True), (1, 4, True), (2, None, True), (3, 0, True)]
    assert rows(graph.block_diameter(e, p)) == want
    assert rows(graph.block_diameter(e, p, most_vertices=0)) == want


def test_laplacian_rows_sum_to_zero(grid8):
    _, e = grid8
    assert all(abs(r["s"]) < 1e-12 for r in graph.laplacian(e).groupBy("row").agg(F.sum("value").alias("s")).collect())
    assert graph.laplacian(e).agg(F.sum(F.abs("value"))).first()[0] == 2 * e.count()


def test_colouring_rounds_cover_the_block_graph(grid8, quarters):
    pairs = graph.communication_pairs(grid8[1], quarters)
    assert sorted((a, b) for _, a, b in pairs) == [(0, 1), (0, 2), (1, 3), (2, 3)]
    for c in {c for c, _, _ in pairs}:
        ends = [x for cc, a, b in pairs if cc == c for x in (a, b)]
        assert len(ends) == len(set(ends))
    full = graph.edge_colouring([(a, b, 1.0) for a, b in itertools.combinations(range(6), 2)])
    assert len(full) == 15


@pytest.mark.parametrize(("dims", "depth"), [(2, 5), (3, 4)])
def test_hilbert_index_and_inverse(spark, dims, depth):
    p = generate.random_points(spark, 300, dims, 1.0, 5)
    axes = ["x", "y", "z"][:dims]
    got = hilbert.with_hilbert(p, axes, 12, ([0.0] * dims, [1.0] * dims)).collect()
    f = np.array([r["h"] / (1 << (dims * 12)) for r in got])
    assert ((f >= 0) & (f < 1)).all()
    back = hilbert.inverse(f, dims, 12)
    assert np.abs(back - np.array([[r[a] for a in axes] for r in got])).max() < 0.01
    side = 1 << depth
    cells = generate.grid(spark, (side,) * dims)[0]
    order = hilbert.with_hilbert(cells, axes, depth, ([-0.5] * dims, [side - 0.5] * dims)).orderBy("h").collect()
    assert [r["h"] for r in order] == list(range(side**dims))
    steps = np.abs(np.diff(np.array([[r[a] for a in axes] for r in order]), axis=0)).sum(axis=1)
    # The curve visits neighbours; its 3-D orientation has a few longer joints.
    assert (steps == 1).mean() > (0.999 if dims == 2 else 0.8)
    c = spark.createDataFrame([(float(x),) for x in f[:20]], "f double")
    cols = hilbert.inverse_column(F.col("f"), dims, 8)
    want = hilbert.inverse(f[:20], dims, 8)
    assert np.abs(np.array([list(r) for r in c.select(*cols).collect()]) - want).max() < 1e-9
    with pytest.raises(Exception, match="outside the box"):
        hilbert.with_hilbert(p, axes, 3, ([0.5] * dims, [1.0] * dims)).collect()
    with pytest.raises(ValueError, match="between"):
        hilbert.inverse(np.array([1.5]), dims, 3)
    assert hilbert.inverse(np.array([0.7]), dims, 0).tolist() == [[0.0] * dims]


def test_ranks_over_many_buckets(spark):
    p = spark.range(1000).select(F.col("id").alias("v"), (F.col("id") * 37 % 101).alias("h"), (F.col("id") % 5).cast("double").alias("w"))
    r = ranks.with_rank(p, ["h", "v"], rows=60).orderBy("h", "v").collect()
    assert [x["rank"] for x in r] == list(range(1000))
    s = ranks.with_prefix_sum(p, "w", ["h", "v"], rows=60).orderBy("h", "v").collect()
    assert np.allclose([x["prefix"] for x in s], np.cumsum([x["w"] for x in s]))


def test_ranks_in_buckets_along_the_curve(spark):
    p = spark.range(400).selectExpr("id AS v", "cast(id * 37 % 101 AS double) AS x", "cast(id * 53 % 97 AS double) AS y")
    h = hilbert.with_hilbert(p, ["x", "y"], 9)
    got = {r["v"]: r["rank"] for r in ranks.with_rank(h, ["h", "v"], rows=60).collect()}
    want = sorted((r["h"], r["v"]) for r in h.collect())
    assert got == {v: i for i, (_, v) in enumerate(want)}


def test_sfc_partition_is_even_and_renumbers(spark, grid8):
    v, e = grid8
    p = sfc.sfc_partition(v, ["x", "y"], 5, 6)
    sizes = [r[1] for r in p.groupBy("blk").count().collect()]
    assert sorted(sizes) == [12, 13, 13, 13, 13]
    m = sfc.curve_renumbering(v, p, ["x", "y"], 6)
    assert topology.is_mapping([r["new_blk"] for r in m.orderBy("blk").collect()])
    q = sfc.renumber(p, m)
    assert value(graph.edge_cut(e, q)) == value(graph.edge_cut(e, p)) and value(graph.imbalance(q, 5)) == value(graph.imbalance(p, 5))
    assert all(r["ordered"] for r in sfc.ranges(sfc.redistribute(v, ["x", "y"], 4)).collect())
    c = sfc.centres_from_curve(4, 2, 6, ([0.0, 0.0], [8.0, 8.0]))
    assert c.shape == (4, 2) and len({tuple(x) for x in c}) == 4


def test_kmeans_is_balanced(spark, grid8):
    v, _ = grid8
    s = Settings(num_blocks=4, min_sampling_nodes=-1, max_kmeans_iterations=20)
    p, c = kmeans.kmeans_partition(v, ["x", "y"], 4, settings=s)
    p = p.cache()
    assert c.imbalance <= 0.03 and len({tuple(x) for x in c.centres}) == 4
    assert [r["n"] for r in p.groupBy("blk").agg(F.count("*").alias("n")).collect()] == [16] * 4
    with pytest.raises(ValueError, match="target"):
        kmeans.kmeans_partition(v, ["x", "y"], 2, targets=[[10, 10]])
    w = v.withColumn("w1", (F.col("v") % 3 + 1).cast("double"))
    _, c2 = kmeans.kmeans_partition(w, ["x", "y"], 3, ["w0", "w1"], settings=Settings(epsilon=0.2, min_sampling_nodes=-1, max_kmeans_iterations=10))
    assert c2.imbalance <= 0.25
    again, c3 = kmeans.repartition(v, p, ["x", "y"], 4, settings=s)
    assert c3.imbalance <= 0.03 and value(metrics.redistribution_volume(p, again)) <= 16


def test_kmeans_scans_beyond_the_local_bound(spark, grid8, monkeypatch):
    v, _ = grid8
    s = Settings(num_blocks=3, min_sampling_nodes=-1, max_kmeans_iterations=3)
    here = rows(kmeans.kmeans_partition(v, ["x", "y"], 3, settings=s)[0])
    monkeypatch.setattr(kmeans, "LOCAL_ROWS", 30)
    assert rows(kmeans.kmeans_partition(v, ["x", "y"], 3, settings=s)[0]) == here
    p, c = kmeans.kmeans_partition(v, ["x", "y"], 4, settings=Settings(num_blocks=4, epsilon=0.1, max_kmeans_iterations=8))
    assert c.imbalance <= 0.1 and p.count() == 64


def test_kmeans_is_free_of_spark_partitioning(spark, grid8):
    v, _ = grid8
    s = Settings(num_blocks=3, min_sampling_nodes=-1, max_kmeans_iterations=3)
    a = rows(kmeans.kmeans_partition(v, ["x", "y"], 3, settings=s)[0])
    assert rows(kmeans.kmeans_partition(v.repartition(7), ["x", "y"], 3, settings=s)[0]) == a


def test_hierarchical_blocks_nest(spark, grid8):
    v, _ = grid8
    s = Settings(num_blocks=4, min_sampling_nodes=-1, max_kmeans_iterations=5)
    p = kmeans.hierarchical(v, ["x", "y"], [2, 2], settings=s)
    n = {r["blk"]: r["count"] for r in p.groupBy("blk").count().collect()}
    assert set(n) == {0, 1, 2, 3} and max(n.values()) <= 18


def test_fuzzy_membership(spark, grid8, quarters):
    v, _ = grid8
    c = kmeans.Clusters(np.array([[1.5, 1.5], [1.5, 5.5], [5.5, 1.5], [5.5, 5.5]]), np.ones((1, 4)), np.zeros(4, np.int32))
    f = kmeans.fuzzify(v, ["x", "y"], c, 3)
    assert all([x["dist"] for x in r["near"]] == sorted(x["dist"] for x in r["near"]) for r in f.collect())
    m = kmeans.membership(f)
    assert all(sum(r["member"]) == pytest.approx(1) for r in m.collect())
    n = [r["value"] for r in kmeans.membership_normalised(m, quarters).collect()]
    assert min(n) >= 0 and max(n) == 1
    bad = quarters.withColumn("blk", F.when((F.col("blk") == 1) & (F.col("v") % 8 < 6), 0).otherwise(F.col("blk")).cast("int"))
    before = value(graph.imbalance(bad, 4))
    for how in ("reb_lex", "reb_sqimba"):
        out = kmeans.rebalance(v, bad, f, 4, [], np.full((1, 4), 16.0), Settings(num_blocks=4, balance_method=how))
        assert value(graph.imbalance(out, 4)) < before


def test_splits():
    starts, most = multisection.splits_optimal([50] * 500, 5)
    assert most == 5000 and starts == [0, 100, 200, 300, 400]
    rnd = random.Random(0)
    for _ in range(200):
        w, k = [rnd.randint(0, 9) for _ in range(rnd.randint(1, 12))], rnd.randint(1, 5)
        s, most = multisection.splits_optimal(w, k)
        force = min((max(sum(w[a:b]) for a, b in itertools.pairwise([0, *cuts, len(w)])) for cuts in itertools.combinations_with_replacement(range(len(w) + 1), k - 1)), default=sum(w))
        assert most == force and len(s) == k and s == sorted(s)
        assert max(sum(w[a:b]) for a, b in itertools.pairwise([*s, len(w)])) == most
    greedy = multisection.splits_greedy([1] * 100, 4)
    assert greedy == [0, 25, 50, 75]


def test_multisection_and_bisection(spark, grid8):
    v, _ = grid8
    p, tree = multisection.multisection(v, ["x", "y"], 16, side=8)
    assert {r["count"] for r in p.groupBy("blk").count().collect()} == {4}
    assert len(tree.leaves()) == 16 and tree.weight == 64
    assert tree.find(tree.leaves()[5].low) == 5
    with pytest.raises(ValueError, match="outside"):
        tree.find([-1.0, 0.0])
    n = [r["count"] for r in multisection.coordinate_bisection(v, ["x", "y"], 5).groupBy("blk").count().collect()]
    assert len(n) == 5 and max(n) <= 16
    assert value(multisection.box_weight(v, ["x", "y"], [0, 0], [3, 3], "w0")) == 16
    assert multisection.cut_counts(12, 2) in ([3, 4], [4, 3]) and multisection.cut_counts(8, 3) == [2, 2, 2]
    leaves = spark.createDataFrame([(i, [float(4 * (i // 2)), float(4 * (i % 2))], [4.0 * (i // 2) + 3, 4.0 * (i % 2) + 3], 1.0) for i in range(4)], "leaf int, low array<double>, high array<double>, weight double")
    assert rows(multisection.leaf_adjacency(leaves)) == [(0, 1), (0, 2), (1, 0), (1, 3), (2, 0), (2, 3), (3, 1), (3, 2)]


def test_pixels_and_spectral(spark, grid8):
    v, e = grid8
    pv, pe = pixel.pixel_graph(v, e, ["x", "y"], 4)
    assert pv.agg(F.sum("w0")).first()[0] == 64 and pe.count() == 48
    assert pixel.neighbours(5, 4, 2) == [4, 6, 1, 9]
    for p in (pixel.pixel_partition(v, ["x", "y"], 4, 8), pixel.spectral_partition(v, e, ["x", "y"], 4, 4)):
        n = {r["blk"]: r["count"] for r in p.groupBy("blk").count().collect()}
        assert set(n) == {0, 1, 2, 3} and max(n.values()) <= 20


def test_trees(spark):
    d = [1, 2, 3, 4, 5]
    labels = [(0, 0, 0, 0, 0), (0, 0, 1, 0, 0), (1, 0, 0, 0, 0), (0, 0, 0, 0, 1)]
    t = topology.from_leaves(spark, [(x, [1.0]) for x in labels])
    w = {(r["src"], r["dst"]): r["w"] for r in topology.tree_graph(t, d).collect()}
    assert w[0, 1] == 3 and w[0, 2] == 5 and w[0, 3] == 1 and len(w) == 12
    h = topology.from_levels(spark, [3, 4])
    topology.check_tree(h)
    assert topology.is_homogeneous(h) and topology.grouping(h, 1) == [4, 4, 4] and topology.grouping(h, 0) == [3]
    assert topology.tree_nodes(topology.flat(spark, 7)).count() == 8
    a = topology.adapt_weights(topology.flat(spark, 4, [[1, 1, 2, 4], [5, 5, 5, 5]]), [80.0, 1.0], [True, False])
    assert rows(topology.targets(a)) == [(0, 10.0), (1, 10.0), (2, 20.0), (3, 40.0)]
    assert topology.balance_vectors(a)[1].tolist() == [5.0] * 4
    assert topology.balance_vectors(h, 1).tolist() == [[4.0, 4.0, 4.0]]
    with pytest.raises(ValueError, match="distinct"):
        topology.from_leaves(spark, [((0,), [1.0]), ((0,), [1.0])])
    assert topology.sizes_for_memory([4, 2, 1], [1, 100, 100], 10) == pytest.approx([1, 6, 3])
    with pytest.raises(ValueError, match="fit"):
        topology.sizes_for_memory([1], [1], 2)


def test_mapping(spark):
    line = [(i, i + 1, 1.0) for i in range(3)] + [(i + 1, i, 1.0) for i in range(3)]
    m = topology.mapping_metrics(line, line, [0, 1, 2, 3], 4)
    assert m["maxDilation"] == 1 and m["qapCost"] == 3 and m["maxCongestion"] == 1 and m["avgDilation"] == 1
    worse = topology.mapping_metrics(line, line, [0, 3, 1, 2], 4)
    assert worse["qapCost"] == 3 + 2 + 1
    got = topology.greedy_mapping(line, line, 4, start=0)
    assert topology.is_mapping(got) and topology.mapping_metrics(line, line, got, 4)["qapCost"] <= 5
    cost = topology.qap_cost(spark.createDataFrame(line, "bs int, bd int, w double"), spark.createDataFrame([(a, b, float(abs(a - b))) for a in range(4) for b in range(4)], "src int, dst int, w double"), spark.createDataFrame(list(enumerate([0, 3, 1, 2])), "blk int, pe int"))
    assert value(cost) == worse["qapCost"]
    old = spark.createDataFrame([(i, i // 4) for i in range(12)], "v long, blk int")
    new = spark.createDataFrame([(i, 2 - i // 4) for i in range(12)], "v long, blk int")
    assert rows(sfc.renumber(new, topology.heaviest_overlap(old, new, 3)), "v", "blk") == rows(old)


def test_matching_and_coarsening(spark, grid8, quarters):
    v, e = grid8
    pairs = multilevel.matching(e, v, quarters)
    used = [x for r in pairs.collect() for x in r]
    assert len(used) == len(set(used)) and len(used) > 32
    p = {r["v"]: r["blk"] for r in quarters.collect()}
    assert all(p[r["a"]] == p[r["b"]] for r in pairs.collect())
    cv, ce, m = multilevel.coarsen(v, e, quarters, 2)
    assert cv.agg(F.sum("w0")).first()[0] == 64 and cv.count() < 40 and graph.asymmetric(ce).count() == 0
    cp = multilevel.to_coarse(quarters, m, "blk").select("v", F.col("blk").cast("int").alias("blk"))
    assert value(graph.edge_cut(ce, cp)) == 16
    assert rows(multilevel.to_fine(cp, m), "v", "blk") == rows(quarters)


def test_two_way_fm_by_force():
    rnd = random.Random(3)
    for _ in range(60):
        n = rnd.randint(2, 8)
        w = {(a, b): rnd.choice([0, 0, 1, 2]) for a, b in itertools.combinations(range(n), 2)}
        near = [[(b if a == x else a, float(c)) for (a, b), c in w.items() if c and x in (a, b)] for x in range(n)]
        side = np.array([rnd.randint(0, 1) for _ in range(n)])
        cut = lambda s: sum(c for (a, b), c in w.items() if s[a] != s[b])
        size = [float((side == 0).sum()), float((side == 1).sum())]
        most = [max(size[0], n / 2) + 1, max(size[1], n / 2) + 1]
        new, gain = multilevel.two_way_fm(near, np.zeros((n, 2)), side, np.ones(n), list(size), most, np.zeros(n))
        assert cut(side) - cut(new) == pytest.approx(gain) and gain >= 0
        assert (new == 0).sum() <= most[0] and (new == 1).sum() <= most[1]


def test_refinement_lowers_the_cut(spark, grid8):
    v, e = grid8
    p = v.select("v", (F.col("v") % 2).cast("int").alias("blk")).cache()
    before = value(graph.edge_cut(e, p))
    out, gain = multilevel.refine(v, e, p, 2, np.full(2, 34.0), Settings(num_blocks=2, min_border_nodes=2))
    assert value(graph.edge_cut(e, out)) == before - gain and gain > 0
    assert max(r["count"] for r in out.groupBy("blk").count().collect()) <= 34


def test_refinement_gives_every_border_vertex_a_turn(spark, grid8, monkeypatch):
    v, e = grid8
    # Halves with one vertex of high id on the wrong side, far from the border between them.
    p = v.select("v", F.when(F.col("v") == 63, 0).otherwise(F.floor(F.col("v") / 32)).cast("int").alias("blk")).cache()
    assert value(graph.edge_cut(e, p)) == 10
    monkeypatch.setattr(multilevel, "REGION_MOST", 8)
    out, gain = multilevel.refine(v, e, p, 2, np.full(2, 34.0), Settings(num_blocks=2))
    assert gain == 2 and value(graph.edge_cut(e, out)) == 8
    assert {r["v"]: r["blk"] for r in out.collect()}[63] == 1 and max(r["count"] for r in out.groupBy("blk").count().collect()) <= 34


def test_flows(spark, grid8):
    v, e = grid8
    x = {r["v"]: r["x"] for r in diffusion.potentials(v, e, 0).collect()}
    assert x[0] == max(x.values()) and x[63] == min(x.values())
    near = {}
    for r in e.collect():
        near.setdefault(r["src"], []).append(r["dst"])
    assert all(sum(x[a] - x[b] for b in near[a]) == pytest.approx(63 if a == 0 else -1, abs=1e-3) for a in near)
    with pytest.raises(ValueError, match="sum to 0"):
        diffusion.flow(e, v.select("v", F.lit(1.0).alias("b")))
    sol, _ = metrics.conjugate_gradient(e, v.select("v", F.lit(1.0).alias("b")), most=200)
    y = {r["v"]: r["x"] for r in sol.collect()}
    assert all(1.1 * len(near[a]) * y[a] - sum(y[b] for b in near[a]) == pytest.approx(1, abs=1e-4) for a in near)


def test_spatial_trees(spark):
    p = generate.random_points(spark, 500, 2, 1.0, 9).cache()
    leaf, leaves = spatial.quadtree(p, ["x", "y"], 20, ([0.0, 0.0], [1.0, 1.0]))
    assert leaves.agg(F.max("n"), F.sum("n")).first()[:] == (leaves.agg(F.max("n")).first()[0], 500) and leaves.agg(F.max("n")).first()[0] <= 20
    assert leaves.agg(F.sum(F.pow(F.lit(0.25), F.col("level").cast("double")))).first()[0] == pytest.approx(1)
    at = {(r["level"], tuple(r["cell"])): (r["low"], r["high"]) for r in leaves.collect()}
    pts = {r["v"]: (r["x"], r["y"]) for r in p.collect()}
    assert all(all(lo <= x <= hi for lo, x, hi in zip(at[r["level"], tuple(r["cell"])][0], pts[r["v"]], at[r["level"], tuple(r["cell"])][1], strict=True)) for r in leaf.collect())
    v, e = spatial.leaf_graph(leaves, 2)
    assert graph.asymmetric(e).count() == 0 and v.count() == leaves.count()
    got = set(rows(e, "src", "dst"))
    box = {r["v"]: at[r["level"], tuple(r["cell"])] for r in v.collect()}
    touch = lambda a, b: sum(min(a[1][d], b[1][d]) - max(a[0][d], b[0][d]) > 1e-12 for d in range(2)) == 1 and all(min(a[1][d], b[1][d]) - max(a[0][d], b[0][d]) > -1e-12 for d in range(2))
    assert got == {(a, b) for a in box for b in box if a != b and touch(box[a], box[b])}
    n = [r["count"] for r in spatial.kd_tree(p, ["x", "y"], 3).groupBy("leaf").count().collect()]
    assert len(n) == 8 and max(n) <= 65
    q = p.filter("v < 10").withColumnRenamed("v", "q")
    found = set(rows(spatial.within_radius(p, q, ["x", "y"], 0.1), "q", "v"))
    assert found == {(a, b) for a in range(10) for b in pts if (pts[a][0] - pts[b][0]) ** 2 + (pts[a][1] - pts[b][1]) ** 2 < 0.01}
    near = spatial.sampled_by_distance(p, [0.5, 0.5], ["x", "y"], lambda d: F.when(d < 0.2, 1.0).otherwise(0.0))
    assert near.count() == sum((x - 0.5) ** 2 + (y - 0.5) ** 2 < 0.04 for x, y in pts.values())
    assert spatial.polar_split((0, 0), (2, 1))[1] == pytest.approx(0.5**0.5)


def test_files_round_trip(spark, grid8, tmp_path):
    v, e = grid8
    e = e.withColumn("w", (F.col("src") + F.col("dst")).cast("double"))
    for single in (True, False):
        path = f"{tmp_path}/g{single}.graph"
        sinks.write_metis(v, e, path, edge_weights=True, single=single)
        gv, ge = files.read_metis(spark, path)
        assert rows(ge, "src", "dst", "w") == rows(e, "src", "dst", "w") and gv.count() == 64
    sinks.write_metis(v, e, f"{tmp_path}/p.graph", single=True)
    sinks.write_coordinates(v, ["x", "y"], f"{tmp_path}/p.graph.xyz", single=True)
    iv, ie = files.read_input(spark, f"{tmp_path}/p.graph", n_weights=2)
    assert iv.columns == ["v", "w0", "x", "y", "w1"] and rows(iv, "v", "x", "y") == rows(v, "v", "x", "y") and ie.count() == 224
    sinks.write_graph_binary(v, e, f"{tmp_path}/g.bgf")
    assert rows(files.read_graph(spark, f"{tmp_path}/g.bgf")[1], "src", "dst") == rows(e, "src", "dst")
    sinks.write_edge_list_binary(v, e, f"{tmp_path}/g.el")
    assert rows(files.read_edge_list_binary(spark, f"{tmp_path}/g.el", header=3)[1], "src", "dst") == rows(e, "src", "dst")
    sinks.write_coordinates_binary(v, ["x", "y"], f"{tmp_path}/c.bin")
    assert rows(files.read_coordinates_binary(spark, f"{tmp_path}/c.bin", 2), "v", "x", "y") == rows(v, "v", "x", "y")
    p = v.select("v", (F.col("v") % 5).cast("int").alias("blk"))
    for single in (True, False):
        sinks.write_partition(p, f"{tmp_path}/part{single}", single=single)
        assert rows(files.read_partition(spark, f"{tmp_path}/part{single}", 64)) == rows(p)
    sinks.write_vtk(v, p, ["x", "y"], f"{tmp_path}/x.vtk")
    assert "SCALARS" in (tmp_path / "x.vtk").read_text()


def test_text_formats(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    with pytest.raises(ValueError, match="edges"):
        files.read_metis(spark, put("bad.graph", "% c\n3 5\n2\n1 3\n2\n"))
    with pytest.raises(ValueError, match="range"):
        files.read_metis(spark, put("bad2.graph", "2 1\n3\n1\n"))
    v, e = files.read_metis(spark, put("w.graph", "% c\n3 2 11 2\n1 2 2 5\n3 4 1 5 3 6\n5 6 2 6\n"))
    assert rows(v) == [(0, 1.0, 2.0), (1, 3.0, 4.0), (2, 5.0, 6.0)] and rows(e) == [(0, 1, 5.0), (1, 0, 5.0), (1, 2, 6.0), (2, 1, 6.0)]
    v, e = files.read_matrix_market(spark, put("m.mtx", "%%MatrixMarket matrix coordinate pattern symmetric\n% x\n3 3 2\n2 1\n3 2\n"))
    assert rows(e, "src", "dst") == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert rows(files.read_coordinates_matrix_market(spark, put("c.mtx", "%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n"))) == [(0, 1.0, 3.0), (1, 2.0, 4.0)]
    assert files.matrix_market_shape(spark, str(tmp_path / "c.mtx")) == (2, 2)
    for base in (0, 1):
        _, e = files.read_edge_list(spark, put(f"e{base}", f"3 2\n{base} {base + 1}\n{base + 1} {base + 2}\n"))
        assert rows(e, "src", "dst") == [(0, 1), (1, 0), (1, 2), (2, 1)]
    put("out0", "# c\n0 1\n1 1\n")
    put("out1", "1 2\n0 1\n")
    assert rows(files.read_edge_list_parts(spark, str(tmp_path / "out"))[1], "src", "dst") == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert rows(files.read_adcirc(spark, put("a", "2\n1 0.5 1.5\n2 2.5 3.5\n"), 2)) == [(0, 0.5, 1.5), (1, 2.5, 3.5)]
    assert rows(files.read_teec(spark, put("t", "0 1 7\n2 3 8\n"), 2)) == [(0, 0.0, 1.0, 7.0), (1, 2.0, 3.0, 8.0)]
    v, e = files.read_off(spark, put("o.off", "OFF\n4 2 0\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n3 0 1 2\n3 1 2 3\n"))
    assert v.count() == 4 and e.count() == 10
    v, e = files.read_alya(spark, put("al", "ELEMENTS\n1 1 2 3 4\nEND_ELEMENTS\nCOORDINATES\n1 0 0\n2 1 0\n3 1 1\n4 0 1\nEND_COORDINATES\n"), 2)
    assert rows(e, "src", "dst") == sorted([(0, 1), (1, 2), (2, 3), (0, 3), (1, 0), (2, 1), (3, 2), (3, 0)]) and v.count() == 4
    assert files.read_block_sizes(spark, put("b", "2 2\n1 2\n3 4\n")) == [[1.0, 3.0], [2.0, 4.0]]
    tree, prop = files.read_pe_tree(spark, put("pe", "# c\n2 2 0 1\n0 1 # 5 6\n1,0 # 7 8\n"))
    assert tree == [((0, 1), [5.0, 6.0]), ((1, 0), [7.0, 8.0])] and prop == [False, True]
    topo = put("cfg", "% c\nhost1 3 10 4\nhost2 1 20 8\n")
    assert files.read_flat_topology(spark, topo)["host2"] == (1.0, 20.0, 8.0)
    assert files.block_sizes_from_topology(spark, topo, ["host2", "host1"]) == [[0.25, 0.75], [20.0, 10.0]]
    cells = "1 1 1 1 2 2 2 3 1 1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1\n3 1 1 1 2 2 2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1 -1\n"
    v, e = files.read_quadtree(spark, put("q", cells + "timestep 1\n"))
    assert v.count() == 2 and rows(e, "src", "dst") == [(0, 1), (1, 0)]


def test_csr_and_pipeline(spark, grid8):
    v, e = grid8
    starts, targets, _ = files.to_csr(e, 64)
    xs = [c for r in v.orderBy("v").collect() for c in (r["x"], r["y"])]
    blk = plan.partition_arrays(spark, starts.tolist(), targets.tolist(), xs, 2, Settings(num_blocks=4, tool="geoSFC", dimensions=2))
    assert sorted(blk.count(b) for b in range(4)) == [16] * 4
    p, m = plan.run(v, e, Settings(num_blocks=4, tool="rcb", dimensions=2, renumber=True, repeat=2))
    got = {r["metric"]: r["value"] for r in m.collect()}
    assert got["finalCut"] == 16 and got["finalImbalance"] == 0
    plan.register_partitioner("stripes", lambda q: q.vertices.select("v", F.floor(F.col("x") / 2).cast("int").alias("blk")))
    assert value(graph.edge_cut(e, plan.partition_graph(v, e, Settings(num_blocks=4, tool="stripes", dimensions=2)))) == 24
    for bad, message in ((Settings(num_blocks=65), "more blocks"), (Settings(epsilon=-1), "epsilon"), (Settings(tool="parMetisGeom"), "external"), (Settings(tool="geoHierKM", num_blocks=4), "hier_levels")):
        with pytest.raises(ValueError, match=message):
            plan.partition_graph(v, e, bad)
    with pytest.raises(ValueError, match="reverse"):
        plan.partition_graph(v, e.filter("src < dst"), Settings())
    assert Tool.parse("geoHierKMeans") == Tool.parse("geohierkm") == "geohierkm"
    assert plan.heatmap(v, 4).agg(F.sum("weight")).first()[0] == 64


def test_random_meshes(spark):
    v, e = generate.random_grid(spark, (5, 5, 5), seed=3)
    assert graph.asymmetric(e).count() == 0 and not graph.has_self_loops(e)
    assert graph.degrees(e).agg(F.min("degree")).first()[0] >= 3
    v, e = generate.quad_mesh(spark, 3, 30, 2, capacity=8, seed=1)
    assert v.count() > 10 and graph.asymmetric(e).count() == 0
    w = generate.block_constraint_weights(v, v.select("v", (F.col("v") % 5).cast("int").alias("blk")), 3)
    assert all(1 <= r["w1"] <= 18 for r in w.collect())
    t = generate.random_tree_rows([2, 3])
    assert len(t) == 6


def test_streaming_assignment(spark, tmp_path):
    c = kmeans.Clusters(np.array([[0.0, 0.0], [10.0, 10.0]]), np.ones((1, 2)), np.zeros(2, np.int32))
    data = spark.createDataFrame([(i, float(i % 12), float(i % 12), f"2024-01-01 00:{i % 60:02d}:00") for i in range(60)], "v long, x double, y double, t string").withColumn("t", F.col("t").cast("timestamp"))
    data.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
    loads = assign.windowed_loads(assign.assign_stream(stream, ["x", "y"], c), "t", "10 minutes")
    q = loads.writeStream.format("memory").queryName("loads").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    want = rows(assign.windowed_loads(assign.assign_stream(data, ["x", "y"], c), "t", "10 minutes"))
    assert rows(spark.table("loads")) == want and sum(r[2] for r in want) == 60
    seen = []
    q = assign.watch(assign.assign_stream(stream, ["x", "y"], c).filter("blk = 0 or v < 20"), 2, 0.01, lambda n, x: seen.append(x), f"{tmp_path}/cp2")
    q.processAllAvailable()
    q.stop()
    assert seen and seen[0] > 0.01


def test_graph_queries_cover_their_tables(spark, tmp_path, monkeypatch):
    import datetime

    from gridloom.plans import catalogue

    rnd = random.Random(8)
    pairs = [(p, s) for p in range(24) for s in rnd.sample(range(8), 3)]
    items = [(p, s, float(p % 7), datetime.datetime(1995, 1, 1 + (p + s) % 28)) for p, s in pairs + pairs[::5]]
    spark.createDataFrame(items, "l_partkey long, l_suppkey long, l_quantity double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    w = {}
    for p, t, *_ in items:
        for a, b in ((2 * p, 2 * t + 1), (2 * t + 1, 2 * p)):
            w[a, b] = w.get((a, b), 0.0) + 1
    blk = {v: v // 2 % 4 for v, _ in w}
    run = lambda n: catalogue.queries()[n](spark, str(tmp_path))

    def paths(source, cost, inside=lambda a, b: True):
        best, todo = {source: 0}, [source]
        while todo:
            x = todo.pop(0)
            for (a, b), c in w.items():
                if a == x and inside(a, b) and best[x] + cost(c) < best.get(b, 1e9):
                    best[b] = best[x] + cost(c)
                    todo.append(b)
        return best

    assert dict(rows(run("bfs_levels_supply"), "v", "dist")) == paths(min(blk), lambda c: 1)
    assert dict(rows(run("shortest_paths_supply"))) == paths(min(blk), lambda c: c)
    coarse = {}
    for (a, b), c in w.items():
        if a // 4 != b // 4:
            coarse[a // 4, b // 4] = coarse.get((a // 4, b // 4), 0.0) + c
    assert {(a, b): c for a, b, c in rows(run("coarsen_contract_supply"))} == coarse
    mates = dict(rows(run("nearest_partner_supply")))
    assert set(mates) == set(blk) and all(x in w for x in mates.items())
    used = [x for r in run("matching").collect() for x in r]
    assert len(used) == len(set(used)) > 8 and all((a, b) in w for a, b in zip(used[::2], used[1::2], strict=True))
    want = []
    for b in range(4):
        own = [v for v in blk if blk[v] == b]
        d = [paths(v, lambda c: 1, lambda x, y: blk[x] == blk[y]) for v in own]
        want.append((b, max(max(x.values()) for x in d) if len(d[0]) == len(own) else None))
    assert sorted(tuple(r)[:2] for r in run("block_diameter").collect()) == want
    before = sum(c for (a, b), c in w.items() if blk[a] != blk[b]) / 2
    # Blocks of eight have no room for a ninth vertex, so the cut stays.
    assert value(run("refinement")) == before
    for n in ("spectral_partition", "pipeline_partition"):
        assert run(n).agg(F.sum("n")).first()[0] == len(blk)

    seen = []
    monkeypatch.setattr(catalogue.kmeans, "kmeans_partition", lambda *a, settings, **b: seen.append(settings) or (spark.range(1).withColumn("blk", F.lit(0)), None))
    monkeypatch.setattr(catalogue.kmeans, "hierarchical", lambda *a, settings, **b: seen.append(settings) or spark.range(1).withColumn("blk", F.lit(0)))
    for n in ("order_points", "part_points", "embedding_points"):
        monkeypatch.setattr(catalogue, n, lambda s, d: None)
    for n in ("kmeans_partition", "kmeans_embeddings", "hierarchical_kmeans"):
        run(n)
    assert [x.max_kmeans_iterations for x in seen] == [Settings().max_kmeans_iterations] * 3


def test_searches_take_every_twentieth_id_and_all_edges(spark, tmp_path):
    from gridloom.plans import catalogue

    spark.range(1, 201).selectExpr("id p_partkey", "int(id % 50) p_size", "900.0D + id % 7 p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    got = {r[:2] for r in rows(catalogue.queries()["radius_query_20"](spark, str(tmp_path)))}
    near = lambda a, b: (a % 50 - b % 50) ** 2 + (a % 7 - b % 7) ** 2 < 9
    assert got == {(q, v) for q in range(20, 201, 20) for v in range(1, 201) if near(q, v)}
    spark.createDataFrame([(p, p % 3) for p in range(9)], "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert catalogue.queries()["edge_symmetry_all"](spark, str(tmp_path)).count() == 0
    one_way = spark.createDataFrame([(0, 1), (1, 0), (6, 2), (2, 3)], "src long, dst long")
    assert rows(graph.asymmetric(one_way)) == [(2, 3), (6, 2)]


def test_flow_meets_every_demand(spark):
    v, e = generate.grid(spark, (4, 4))
    x = diffusion.potentials(v.withColumn("w0", F.lit(1.0)), e, 0)
    got = graph.laplacian(e).join(x.withColumnRenamed("v", "col"), "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("b")).collect()
    assert len(got) == 16
    assert max(abs(r["b"] - (15.0 if r["row"] == 0 else -1.0)) for r in got) < 2e-6
    with pytest.raises(ValueError, match="connected part"):
        diffusion.flow(spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "src long, dst long, w double"), spark.createDataFrame([(0, 3.0), (1, -1.0), (2, -1.0), (3, -1.0)], "v long, b double"), most=3)


def test_csr_rows_are_a_table(spark, grid8):
    _, e = grid8
    e = e.filter("src <> 9")
    starts, targets, weights = files.to_csr(e, 64)
    r = files.csr_rows(e, 64).orderBy("v").collect()
    assert [x["start"] for x in r] == starts[:-1].tolist()
    assert [t for x in r for t in x["targets"]] == targets.tolist() and [w for x in r for w in x["weights"]] == weights.tolist()
    assert sorted(map(tuple, files.csr_edges(files.csr_rows(e, 64)).collect())) == sorted(map(tuple, e.select("src", "dst", F.col("w").cast("double")).collect()))
