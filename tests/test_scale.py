"""Sizes at which tables no longer coalesce to a few partitions."""

import contextlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.functions import orders
from lumenfield.operators import extrema, graph, meanshift, resample, spectral


@contextlib.contextmanager
def setting(spark, **conf):
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


SETTINGS = [{"spark.sql.shuffle.partitions": n, "spark.sql.adaptive.enabled": a} for n in ("8", "200") for a in ("true", "false")]


@pytest.mark.parametrize("conf", [SETTINGS[0], SETTINGS[3]])
def test_edges_are_numbered_without_gap_or_repetition(spark, conf):
    n = 3_000_000
    with setting(spark, **conf):
        edges = spark.range(n).select(F.xxhash64("id").alias("i"), (F.col("id") * 7).alias("j"), F.lit(1.0).alias("length"))
        ids = graph.edge_list(edges)
        got = ids.agg(F.count("*"), F.count_distinct("edge_id"), F.min("edge_id"), F.max("edge_id")).first()
        assert tuple(got) == (n, n, 0, n - 1)
        low = ids.where("edge_id < 1000").orderBy("edge_id").select("i").toPandas()["i"].tolist()
        assert low == edges.orderBy("i").limit(1000).toPandas()["i"].tolist()


@pytest.mark.parametrize("conf", SETTINGS[::3])
def test_every_draw_is_a_whole_permutation(spark, conf):
    n, b = 10_000, 49
    with setting(spark, **conf):
        y = spark.range(n).select(F.col("id").alias("vertex"), F.col("id").cast("double").alias("y"))
        draws = resample.permuted(y, b, 3).groupBy("col").agg(F.count_distinct("vertex").alias("v"), F.count_distinct("y").alias("y"), F.count("*").alias("n")).collect()
        assert len(draws) == b and {(r.v, r.y, r.n) for r in draws} == {(n, n, n)}


@pytest.mark.parametrize("conf", SETTINGS[::3])
def test_adjusted_p_values_of_two_million_rows(spark, conf):
    n = 2_000_000
    with setting(spark, **conf):
        # a third of the rows share one value
        p = F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)))
        got = extrema.bh_adjust(spark.range(n).select("id", p.alias("p_value"))).toPandas()
    v = got["p_value"].to_numpy()
    order = np.argsort(v)
    rank = np.searchsorted(v[order], v[order], side="right")
    q = np.minimum.accumulate((v[order] * n / rank)[::-1])[::-1]
    want = np.empty(n)
    want[order] = np.minimum(q, 1)
    assert len(got) == n and np.abs(got["p_adjusted"].to_numpy() - want).max() < 1e-12


def test_null_p_values_stay_null(spark):
    got = {r.k: r.p_adjusted for r in extrema.bh_adjust(spark.createDataFrame([(1, 0.01), (2, None), (3, 0.5)], "k int, p_value double")).collect()}
    assert got[2] is None and abs(got[1] - 0.02) < 1e-15 and got[3] == 0.5


def clouds(spark, n, d=8, centres=40, seed=3):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, d)) * 30
    x = at[rng.integers(0, centres, n)] + rng.normal(size=(n, d))
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vertex long, x array<double>")


def test_pruned_neighbours_equal_brute_force_with_ties(spark):
    x, _ = clouds(spark, 1500)
    x[200:600] = x[200]  # equal points, more than a block holds
    x = np.round(x, 1)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vertex long, x array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(i, r): int(j) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:5])}
    got = graph.knn(points, 5, 100).collect()
    assert {(r.vertex, r.rank): r.nbr for r in got} == want


def test_partial_neighbours_of_clustered_points_grow_with_the_points(spark, monkeypatch):
    made = []
    ranked = graph._ranked
    monkeypatch.setattr(graph, "_ranked", lambda near, k: (made.append(near.count()), ranked(near, k))[1])
    for n in (4_000, 20_000):
        got = graph.knn(clouds(spark, n)[1], 6, 500)
        assert got.count() == 6 * n
    assert made[1] / made[0] < 5**1.4


def test_points_that_nothing_prunes_travel_as_often_whatever_their_number(spark):
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    made = []
    for n in (4_000, 20_000):
        x = np.random.default_rng(n).normal(size=(n, 32))
        points = spectral._checkpointed(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vertex long, x array<double>"))
        before = written()
        got = graph.knn(points, 3).collect()
        made.append(written() - before)
        some = [r for r in got if r.vertex % 997 == 0]
        for v in {r.vertex for r in some}:
            d = np.sqrt(((x - x[v]) ** 2).sum(1))
            assert [r.nbr for r in sorted(some, key=lambda r: r.rank) if r.vertex == v] == np.lexsort((np.arange(n), d))[:3].tolist()
    assert made[1] / made[0] < 5 * 1.3


def test_neighbours_at_extreme_scales(spark):
    rng = np.random.default_rng(3)
    for scale, shift in ((1e-25, 0.0), (1e25, 0.0), (1.0, 1e7)):
        x = rng.normal(size=(900, 5)) * scale + shift
        points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vertex long, x array<double>")
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        want = {(i, r): int(j) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:4])}
        assert {(r.vertex, r.rank): r.nbr for r in graph.knn(points, 4, 100).collect()} == want


def test_edges_with_a_short_way_of_two_need_no_frontier(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(600, 16))
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vertex long, x array<double>")
    edges = spectral._checkpointed(graph.iknn(graph.knn(points, 7)))
    rows, plain = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: (rows.append(df.count() if "way" in df.columns else 0), plain(df))[1])
    left = graph.prune_long_ways(edges, 0.1).count()
    assert 0 < left < edges.count() / 2
    assert 0 < sum(rows) < edges.count()


def test_edges_without_length_stay(spark):
    edges = spark.createDataFrame([(1, 2, 0.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 0.5), (1, 4, 1.5)], "i long, j long, length double")
    assert sorted((r.i, r.j) for r in graph.prune_long_ways(edges, 0.1).collect()) == [(1, 2), (3, 4)]


def test_mean_shift_searches_once_for_each_place_of_the_points(spark, monkeypatch):
    calls, plain = [], graph.knn
    monkeypatch.setattr(graph, "knn", lambda *a: (calls.append(a[1]), plain(*a))[1])
    points = spark.createDataFrame([(k, [float(k % 5), float(k // 5) + k % 3 / 7]) for k in range(20)], "vertex long, x array<double>")
    meanshift.smooth(points, k=3, steps=1, method="knn_adaptive_grad")
    assert calls == [4, 4]


def test_a_vertex_near_all_others_is_dealt_to_blocks(spark):
    n = 600
    near = spark.createDataFrame([(k, 0, 1.0 + k) for k in range(n)] + [(k, k, 0.0) for k in range(1, n)], "vertex long, nbr long, dist double")
    plain, dealt = (sorted(map(tuple, graph.iknn(near, size).collect())) for size in (10_000, 50))
    assert plain == dealt and len(plain) == n * (n - 1) // 2


def test_triangles_of_a_star_make_no_wedges(spark):
    n = 100_000
    edges = spark.range(1, n).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j")).unionByName(spark.createDataFrame([(1, 2), (3, 4)], "i long, j long"))
    sets = spark.createDataFrame([(k, m) for k in range(5) for m in (0, k)], "vertex long, member long").distinct()
    found = graph.triangles(edges, sets)
    assert sorted((r.v0, r.v1, r.v2) for r in found.collect()) == [(0, 1, 2), (0, 3, 4)]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 200_000])
def test_order_statistics_by_radix_selection(spark, n):
    x = F.when(F.col("id") % 3 == 0, 7.25).otherwise(F.pow(F.lit(10.0), F.pmod(F.xxhash64("id"), F.lit(600)) / 10.0 - 30) * F.when(F.col("id") % 2 == 0, 1).otherwise(-1))
    df = spark.range(n).select(F.when(F.col("id") % 11 == 10, None).otherwise(x).alias("x")).unionByName(spark.createDataFrame([(float("nan"),)], "x double"))
    v = np.sort([r.x for r in df.where("x is not null and not isnan(x)").collect()])
    ranks = [0, 1, len(v) // 4, len(v) // 2, len(v) - 1, len(v) + 5]
    got = orders.at_ranks(df, "x", ranks)
    assert got == ([None] * 6 if not len(v) else [v[min(max(r, 0), len(v) - 1)] for r in ranks])
    if len(v):
        assert np.allclose(orders.quantiles(df, "x", [0, 0.1, 0.5, 0.977, 1]), np.quantile(v, [0, 0.1, 0.5, 0.977, 1]), rtol=1e-12)


def test_extreme_values_and_groups(spark):
    odd = [float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]
    df = spark.createDataFrame([(v,) for v in odd], "x double")
    assert orders.at_ranks(df, "x", list(range(8))) == sorted(odd)
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 9, 4000) ** 2, rng.normal(size=4000) ** 5)] + [(100, 2.0), (101, None), (None, 1.0)]
    got = {r.g: r.q for r in orders.by_group(spark.createDataFrame(rows, "g int, x double"), "g", "x", 0.3, "q").collect()}
    want = {g: np.quantile([v for h, v in rows if h == g], 0.3) for g in {r[0] for r in rows} - {None, 101}}
    assert got == pytest.approx(want, rel=1e-12)
