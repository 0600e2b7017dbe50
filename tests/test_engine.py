"""The smoothing engine: hand-computed numbers, invariants, and registered queries against DuckDB."""

import math
import random
import warnings

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield import catalog
from lumenfield.functions import columns as fx
from lumenfield.functions import orders
from lumenfield.operators import draws as arrays, extrema, graph, logit, meanshift, measures, members, metrics, resample, spectral, splines, walks
from lumenfield.plans import fit as plans
from lumenfield.plans import pipelines
from lumenfield.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(catalog.ORACLES[name]).fetchdf()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours) == len(theirs) > 0
    ours, theirs = (d[columns].sort_values(columns).reset_index(drop=True) for d in (ours, theirs))
    for c in columns:
        if ours[c].dtype == object or theirs[c].dtype == object:
            assert ours[c].astype(str).tolist() == theirs[c].astype(str).tolist(), c
        else:
            assert np.array_equal(ours[c].astype(float), theirs[c].astype(float), equal_nan=True), c


def test_every_query_without_sql_is_listed_in_another_test():
    tested = {"pca_fit", "coherence_fit", "refit_labeled", "refit_posterior", "lcor_posterior", "coboundary_full", "cross_validate", "fit_report", "tikhonov_solve", "heat_apply", "rho_basins", "pca_variance", "pca_scores", "density_diffusion", "smoothed_density", "spectrum", "spectral_gap", "gcv_curve", "spectral_smooth", "semi_smooth", "distance_measure_fit", "gamma_select", "refit_columns", "gcv_spline", "hop_extremp_radius", "pextrema", "hop_extremality", "k_diagnostics", "perm_test", "perm_audit", "cluster_pvalue", "bayes_bootstrap", "posterior", "lslope_test", "lslope_wilcoxon", "lslope_weighted", "bayes_bootstrap_global", "mean_shift_denoised", "fit_with_posterior", "mean_shift", "ulogit", "eigen_ulogit", "componentwise_fit", "data_smoother", "lp_graphs", "iknn_response_pipeline"}
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == tested


def small_graph(spark):
    edges = spark.createDataFrame([(1, 2, 2.0, 1.0), (1, 3, 4.0, 1.0), (2, 3, 1.0, 1.0), (3, 4, 0.5, 1.0)], "i long, j long, rho double, length double")
    rho = spark.createDataFrame([(1, 1.0), (2, 4.0), (3, 1.0), (4, 2.0)], "vertex long, rho double")
    subjects = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "C")], "vertex long, subject string")
    return edges, rho, subjects


def test_subject_concentration_by_hand(spark):
    edges, rho, subjects = small_graph(spark)
    got = {r.vertex: r for r in extrema.subject_stats(subjects, edges, measures.neighbour_weights(rho, edges)).collect()}
    close = lambda c, want: [getattr(got[v], c) for v in (1, 2, 3, 4)] == pytest.approx(want, rel=1e-6)
    assert close("R", [1.5, 1.5, 4 / 3, 1])
    assert close("p_max_conductance", [2 / 3, 2 / 3, 0.6153846154, 1])
    assert close("s_eff_conductance", [1.8, 1.8, 1.8988764045, 1])
    assert close("p_max_operator", [0.5, 2 / 3, 0.6534537935, 1])
    assert close("s_eff_operator", [2, 1.8, 1.8278312164, 1])
    alone = {r.vertex: r.R for r in extrema.subject_stats(subjects, edges, measures.neighbour_weights(rho, edges), include_self=False).collect()}
    assert [alone[v] for v in (1, 2, 3, 4)] == pytest.approx([1, 1, 1.5, 1])


def cliques(spark):
    pairs = [(a, b, 1 + (b - a) / 100) for lo in (1, 7) for a in range(lo, lo + 6) for b in range(a + 1, lo + 6)] + [(6, 7, 100.0)]
    return spark.createDataFrame(pairs, "i long, j long, length double"), spark.createDataFrame([(v, math.sin(v)) for v in range(1, 13)], "vertex long, y double")


def test_bridge_without_overlap_keeps_a_positive_density(spark):
    edges, y = cliques(spark)
    model = plans.fit(None, y, 2, 5, edges=edges)
    rho = {(r.i, r.j): r.rho for r in model.edge_rho.collect()}
    assert 0 < rho[6, 7] < 1e-6 and all(math.isfinite(v) and v > 0 for v in rho.values())
    assert sum(rho.values()) == pytest.approx(len(rho))
    with pytest.raises(ValueError):
        plans.fit(None, y, 2, edges=edges, measure="distance")
    with pytest.raises(ValueError):
        plans.fit(None, y, 2, edges=edges.where("length < 50"))


def test_malformed_graphs_are_named(spark):
    good = [(1, 2, 1.0), (2, 1, 1.0)]
    for bad, name in (([(1, 1, 1.0)], "self_loop"), ([(2, 3, 1.0)], "not_reciprocal"), ([(1, 2, 1.0)], "duplicate"), ([(2, 3, -1.0), (3, 2, -1.0)], "bad_weight"), ([(2, 3, 1.0), (3, 2, 1.1)], "unequal_weights"), ([(2, 3, None), (3, 2, None)], "bad_weight")):
        with pytest.raises(ValueError, match=name):
            tables.validated_graph(spark.createDataFrame(good + bad, "vertex long, nbr long, length double"))
    assert tables.validated_graph(spark.createDataFrame(good, "vertex long, nbr long, length double")).count() == 1


def test_points_that_are_not_finite(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, float("nan")]), (3, [None, 1.0])], "k long, v array<double>")
    assert tables.points(df, "k", "v", strict=False).count() == 1
    with pytest.raises(Exception, match="finite"):
        tables.points(df, "k", "v").collect()
    sparse = spark.createDataFrame([(1, 0, 2.0), (1, 2, 3.0)], "k long, f int, v double")
    assert tables.points_from_long(sparse, "k", "f", "v", 3).first().x == [2.0, 0.0, 3.0]


def test_edge_mass_has_no_limit_but_by_policy(spark):
    # 200 001 edges, three of which make a triangle
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "i long, j long").unionByName(spark.range(200_000 - 2).select((2 * F.col("id") + 10).alias("i"), (2 * F.col("id") + 11).alias("j")))
    rho1 = edges.withColumn("rho", F.lit(1.0))
    rho0 = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 5.0)], "vertex long, rho double")
    sets = spark.createDataFrame([(v, m) for v in (1, 2, 3) for m in (1, 2)], "vertex long, member long")
    tri = graph.triangles(edges, sets)
    off = measures.edge_mass(edges, tri, rho1, rho0, sets).where("i != i2 or j != j2").collect()
    assert {(r.i, r.j, r.i2, r.j2): r.val for r in off} == {(a, b, c, d): 5.0 for a, b in ((1, 2), (1, 3), (2, 3)) for c, d in ((1, 2), (1, 3), (2, 3)) if (a, b) != (c, d)}
    for policy in ("auto", "never"):
        assert measures.edge_mass(edges, tri, rho1, rho0, sets, policy=policy).count() == 200_001
    small = edges.where("i < 4")
    assert measures.edge_mass(small, tri, rho1.where("i < 4"), rho0, sets, policy="auto").count() == 9
    with pytest.raises(ValueError):
        measures.edge_mass(edges, tri, rho1, rho0, sets, policy="some")


def cloud(spark, n=90, d=4, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vertex long, x array<double>")


def test_neighbours_in_blocks_equal_brute_force(spark):
    x, points = cloud(spark)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(i, r): int(j) for i in range(90) for r, j in enumerate(np.lexsort((np.arange(90), d[i]))[:6])}
    for block in (2048, 20):
        got = graph.knn(points, 6, block).collect()
        assert {(r.vertex, r.rank): r.nbr for r in got} == want
        assert max(abs(r.dist - d[r.vertex, r.nbr]) for r in got) < 1e-12


def test_neighbours_among_many_equal_points(spark):
    # copies of one vector, and a shell of points at equal distance from it
    x = np.vstack([np.tile([0.1, 0.7, -0.3], (50, 1)), np.tile([[0.1, 0.7, 0.7], [0.1, 0.7, -1.3]], (20, 1)), np.random.default_rng(1).normal(size=(30, 3))])
    x = x[np.random.default_rng(2).permutation(len(x))]
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vertex long, x array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for k in (6, 60):
        want = {(i, r): int(j) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:k])}
        for block in (2048, 60):
            assert {(r.vertex, r.rank): r.nbr for r in graph.knn(points, k, block).collect()} == want


def test_pruning(spark):
    _, points = cloud(spark)
    edges = spectral._checkpointed(graph.iknn(graph.knn(points, 7)))
    assert graph.prune_long_ways(edges, 0.0).count() == edges.count() > graph.prune_long_ways(edges, 0.1).count() >= graph.prune_long_ways(edges, 0.3).count()
    kept = graph.prune_longest(points.select("vertex"), edges, 0.4)
    assert kept.count() < edges.count()
    parts = lambda e: graph.components(points.select("vertex"), e).select("component").distinct().count()
    assert parts(kept) == parts(edges)


def test_spectrum_and_lanczos(spark):
    _, points = cloud(spark)
    y = points.select("vertex", F.sin(F.col("x")[0]).alias("y"))
    model = plans.fit(points, y, 5, 8, check_connected=False)
    ids, a = spectral.dense(model.laplacian)
    values = np.linalg.eigvalsh(a)
    assert np.allclose(a, a.T) and abs(values[0]) < 1e-9 * max(1, values[-1])
    assert np.allclose(model.spectrum.values, values[:8], atol=1e-8 * values[-1])
    v = np.array([r.v for r in model.spectrum.vectors.orderBy("vertex").collect()])
    assert np.allclose(v.T @ v, np.eye(8), atol=1e-10)
    rho = np.array([r.rho for r in model.vertex_rho.orderBy("vertex").collect()])
    first = np.sqrt(rho) / np.linalg.norm(np.sqrt(rho))
    if values[1] > 1e-6:
        assert abs(abs(v[:, 0] @ first) - 1) < 1e-8
    assert rho.sum() == pytest.approx(90)


@pytest.mark.parametrize("edges, m", [([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)], 4), ([(3 * c + a, 3 * c + b) for c in range(8) for a, b in ((0, 1), (1, 2), (0, 2))], 11), ([(i, (i + k) % 40) for i in range(40) for k in (1, 2, 7)], 6)])
def test_spectrum_without_a_dense_matrix(spark, edges, m):
    """Two triangles, eight of them (zero is repeated more often than a block is wide), and a connected ring: joins alone give the same."""
    n = 1 + max(map(max, edges))
    a = np.zeros((n, n))
    for i, j in edges:
        a[[i, j], [j, i]] -= 1
        a[[i, j], [i, j]] += 1
    lap = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, val double")
    low = spectral.spectrum(lap, m, dense_limit=0)
    assert np.allclose(low.values, np.linalg.eigvalsh(a)[:m], atol=1e-8)
    v = np.array([r.v for r in low.vectors.orderBy("vertex").collect()])
    assert np.allclose(v.T @ v, np.eye(m), atol=1e-8) and spectral.residuals(lap, low.vectors, low.values).max() < 1e-6


def test_solvers_that_do_not_converge_say_so(spark):
    a, lap, _ = path_laplacian(spark, 40)
    with pytest.raises(RuntimeError, match="residuals"):
        spectral.lanczos(lap, 3, block=2, limit=8)
    b = spark.createDataFrame([(i, float(i % 3)) for i in range(40)], "vertex long, x double")
    spectral.DENSE, before = 2, spectral.DENSE
    try:
        with pytest.raises(RuntimeError, match="residual"):
            spectral.solve(lap, b, 1e-3, 1.0, rounds=3)
    finally:
        spectral.DENSE = before


def shortest(edges, i, j):
    """Length of the shortest way that does not use the edge itself."""
    best, todo = {i: 0.0}, [i]
    while todo:
        v = todo.pop(0)
        for (a, b), length in edges.items():
            for x, y in ((a, b), (b, a)):
                if x == v and (a, b) != (i, j) and best[v] + length < best.get(y, math.inf):
                    best[y] = best[v] + length
                    todo.append(y)
    return best.get(j, math.inf)


def test_pruning_by_ways_of_any_number_of_edges(spark):
    rng = random.Random(2)
    ring = {(0, 4): 3.9, **{(k, k + 1): 1.0 for k in range(4)}}  # four edges around, 1.026 times as long
    points = [(rng.random(), rng.random()) for _ in range(25)]
    near = {(i, j): math.dist(points[i], points[j]) for i in range(25) for j in range(i + 1, 25) if math.dist(points[i], points[j]) < 0.45}
    for edges, delta in ((ring, 0.1), (ring, 0.01), (near, 0.2), (near, 0.05)):
        table = spark.createDataFrame([(i, j, length) for (i, j), length in edges.items()], "i long, j long, length double")
        kept = {(r.i, r.j) for r in graph.prune_long_ways(table, delta).collect()}
        assert kept == {e for e, length in edges.items() if not shortest(edges, *e) / length - 1 < delta}


def test_longest_edges_that_stay_are_those_of_the_smallest_forest(spark):
    rng = random.Random(3)
    edges = {(i, j): float(rng.randint(1, 30)) for i in range(30) for j in range(i + 1, 30) if rng.random() < 0.12}
    parent = list(range(31))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    forest = set()
    for (i, j), _ in sorted(edges.items(), key=lambda e: (e[1], e[0])):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            forest.add((i, j))
    cut = np.quantile(list(edges.values()), 0.6)
    table = spark.createDataFrame([(i, j, length) for (i, j), length in edges.items()], "i long, j long, length double")
    kept = {(r.i, r.j) for r in graph.prune_longest(spark.range(31).withColumnRenamed("id", "vertex"), table, 0.4).collect()}
    assert kept == {e for e, length in edges.items() if length <= cut or e in forest}


def test_path_and_planted_edges(spark):
    v = spark.createDataFrame([(5,), (2,), (9,)], "vertex long")
    p = graph.path(v)
    assert sorted(map(tuple, p.collect())) == [(2, 5, 1.0), (5, 9, 1.0)]
    more = spark.createDataFrame([(9, 2, 3.0), (5, 2, 0.5), (4, 4, 1.0)], "i long, j long, length double")
    assert sorted(map(tuple, graph.planted(p, more).collect())) == [(2, 5, 0.5), (2, 9, 3.0), (5, 9, 1.0)]


def test_fit_refit_and_semi(spark):
    x, points = cloud(spark)
    y = points.select("vertex", F.sin(F.col("x")[0]).alias("y"))
    model = plans.fit(points, y, 5, 20, check_connected=False)
    assert len(model.gcv) == 40 and model.fitted.count() == 90
    v = np.array([r.v for r in model.spectrum.vectors.orderBy("vertex").collect()])
    yy = np.sin(x[:, 0])
    want = v @ (model.weights * (v.T @ yy))
    assert np.allclose([r.y_hat for r in model.fitted.orderBy("vertex").collect()], want)
    etas = [e for e, _ in model.gcv]
    f = spectral.filter_matrix("heat_kernel", model.spectrum.values, etas)
    direct = [((yy - v @ (w * (v.T @ yy))) ** 2).sum() / (90 - w.sum()) ** 2 for w in f]
    assert np.allclose([g for _, g in model.gcv], direct) and model.eta == etas[int(np.argmin(direct))]
    two = y.withColumn("col", F.lit("a")).unionByName(y.select("vertex", (2 * F.col("y")).alias("y")).withColumn("col", F.lit("b")))
    for per_column in (True, False):
        fitted, info = plans.refit(model, two, per_column)
        a, b = ([r.y_hat for r in fitted.where(F.col("col") == c).orderBy("vertex").collect()] for c in "ab")
        assert np.allclose(2 * np.array(a), b) and info.count() == 2
        if not per_column:
            assert np.allclose(a, want)
    semi = plans.fit(points, y, 5, 10, labeled=points.where("vertex % 2 = 0").select("vertex"), check_connected=False).fitted
    assert semi.where("residual is null").count() == 45 and semi.where("y_hat is null").count() == 0
    full = plans._semi(model.spectrum, y, y.select("vertex"), [0.1])[2].orderBy("vertex").collect()
    lam = np.maximum(model.spectrum.values, 0)
    assert np.allclose([r.y_hat for r in full], v @ ((v.T @ yy) / (1 + 0.1 * lam)))


def test_diffusion_and_distance_fit(spark):
    _, points = cloud(spark, 60)
    y = points.select("vertex", F.col("x")[0].alias("y"))
    model = plans.fit(points, y, 5, 6, measure="distance", max_iterations=2, check_connected=False)
    assert len(model.history) >= 2
    out = spectral.diffuse(model.laplacian, model.vertex_rho, 0.5, 0.1).collect()
    assert sum(r.rho for r in out) == pytest.approx(60) and min(r.rho for r in out) > 0
    import lumenfield.operators.spectral as s

    keep, s.DENSE = s.DENSE, 1
    try:
        again = {r.vertex: r.rho for r in spectral.diffuse(model.laplacian, model.vertex_rho, 0.5, 0.1).collect()}
    finally:
        s.DENSE = keep
    assert all(again[r.vertex] == pytest.approx(r.rho, rel=1e-5) for r in out)


def test_weight_compression(spark):
    df = spark.createDataFrame([(k, 10.0 ** (k / 10)) for k in range(200)], "vertex long, w double")
    for top in (1000.0, 10.0):
        lo, hi = measures.compress(df, "w", top).agg(F.min("w"), F.max("w")).first()
        assert hi / lo == pytest.approx(top)


def test_resampling(spark):
    _, points = cloud(spark, 60)
    y = points.select("vertex", (F.col("x")[0] > 0).cast("double").alias("y"))
    model = plans.fit(points, y, 5, 8, check_connected=False)
    draws = resample.permuted(y, 4, 7).toPandas()
    assert all(sorted(g.y) == sorted(y.toPandas().y) for _, g in draws.groupby("col")) and draws.groupby("col").vertex.nunique().eq(60).all()
    overall, per = resample.permutation_test(model, y, 19)
    r = overall.first()
    assert all(1 / 20 <= r[s] <= 1 for s in resample.STATISTICS)
    p = per.toPandas().sort_values("p_value")
    assert (p.p_adjusted >= p.p_value - 1e-12).all() and p.p_adjusted.is_monotonic_increasing
    subjects = y.select("vertex", F.concat(F.col("vertex") % 6, F.lit("s")).alias("subject"))
    with pytest.raises(ValueError):
        resample.permuted(y, 2, 1, subjects)
    b = arrays.bootstrap(model, y, 19).toPandas()
    assert (b.lower <= b.upper).all() and b.pseudo_p.between(0, 1).all()
    post = resample.posterior(model, y, 50).join(model.fitted, "vertex").toPandas()
    assert (post.lower <= post.upper).all() and ((post.lower <= post.y_hat) & (post.y_hat <= post.upper)).mean() > 0.8
    c = pipelines.cluster_pvalues(model, y, 5).first()
    assert 1 / 6 <= c.p_size <= 1 and c.threshold > 0
    t = arrays.slope_test(model, y, points.select("vertex", F.col("x")[1].alias("y")), 19).where("p_value is not null").toPandas()
    assert len(t) and t.p_value.between(0, 1).all() and (t.p_adjusted >= t.p_value - 1e-12).all()


def test_hops(spark):
    n = 15
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(n - 1)], "i long, j long, length double")
    heights = [0, 1, 0, 2, 9, 2, 1, 3, 1, 0, -5, 0, 1, 0.5, 1]
    y = spark.createDataFrame([(k, float(v)) for k, v in enumerate(heights)], "vertex long, y double")
    rho = spark.createDataFrame([(k, 1.0) for k in range(n)], "vertex long, rho double")
    got = {r.vertex: r.radius for r in extrema.hop_radius(y, edges, rho, 0.95).collect()}

    def brute(v):
        if heights[v] == max(heights):
            return -1
        near = [u for u in (v - 1, v + 1) if 0 <= u < n]
        if any(heights[u] >= heights[v] for u in near):
            return 0
        last = 0
        for hop in range(1, 31):
            seen = [u for u in range(n) if 0 < abs(u - v) <= hop]
            if sum(heights[u] < heights[v] for u in seen) / len(seen) < 0.95 or not any(abs(u - v) == hop - 1 for u in range(n)):
                return last
            last = hop
        return last

    for v in range(n):
        assert got[v] == brute(v), v
    scores = extrema.extremality(y, rho, edges.withColumn("rho", F.lit(1.0))).collect()
    assert {r.vertex: r.score for r in scores}[4] == pytest.approx(1) and {r.vertex: r.score for r in scores}[10] == pytest.approx(-1)


def test_ties_pca_spline(spark):
    df = spark.createDataFrame([(k, float(k // 3)) for k in range(30)], "vertex long, y double")
    out = pipelines.break_ties(df).toPandas()
    assert out.y.nunique() == 30 and (out.sort_values("vertex").y - [k // 3 for k in range(30)]).abs().max() < 1e-7
    x, points = cloud(spark, 50, 5)
    scores, share = metrics.pca(points, 0.8)
    c = x - x.mean(0)
    s = np.linalg.svd(c, compute_uv=False) ** 2
    assert np.allclose(share, np.cumsum(s) / s.sum())
    got = np.array([r.x for r in scores.orderBy("vertex").collect()])
    assert np.allclose((got**2).sum(0), s[: got.shape[1]]) and np.cumsum(s)[got.shape[1] - 1] / s.sum() >= 0.8
    line = spark.createDataFrame([(float(k), 2.0 * k + 1) for k in range(10)], "x double, y double")
    assert all(v == pytest.approx(2 * g + 1, abs=1e-6) for g, v, _, _ in splines.spline(line).collect())
    with pytest.raises(ValueError):
        splines.spline(line.limit(3))


@pytest.mark.parametrize("method", sorted(meanshift.METHODS))
def test_mean_shift(spark, method):
    rng = np.random.default_rng(1)
    angle = rng.uniform(0, 2 * math.pi, 40)
    x = np.stack([np.cos(angle), np.sin(angle)], 1) * rng.normal(1, 0.15, (40, 1))
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vertex long, x array<double>")
    path, medians = meanshift.smooth(points, 8, steps=2, size=0.5, method=method)
    last = np.array([r.x for r in path.where("step = 2").orderBy("vertex").collect()])
    assert last.shape == x.shape and np.isfinite(last).all() and len(medians) == 3
    assert path.where("step = 0").count() == path.where("step = 1").count() == 40 and medians[-1] < medians[0]
    if method == "basic":  # a step of fixed neighbours by hand
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        near = np.argsort(d, axis=1, kind="stable")[:, 1:9]
        dist = np.take_along_axis(d, near, 1)
        t = dist / (dist.max(1, keepdims=True) * 1.01)
        w = np.where(t >= 1, 0, 1 - t * t)
        g = (w[:, :, None] * x[near]).sum(1) / w.sum(1)[:, None] - x
        g /= np.linalg.norm(g, axis=1, keepdims=True)
        size = (w * np.abs(((x[near] - x[:, None]) * g[:, None]).sum(2))).sum(1) / w.sum(1)
        one = np.array([r.x for r in path.where("step = 1").orderBy("vertex").collect()])
        assert np.allclose(one, x + 0.5 * size[:, None] * g)


def test_logistic(spark):
    rng = random.Random(3)
    rows = [(0, x, float(rng.random() < 1 / (1 + math.exp(-2 * x))), 1.0) for x in (rng.uniform(-2, 2) for _ in range(80))] + [(1, float(k), 1.0, 1.0) for k in range(5)]
    df = spark.createDataFrame(rows, "g int, x double, y double, w double")
    out = logit.ulogit(df, "g").toPandas()
    b0, b1, m = logit.fit_distributed(df.where("g = 0"))
    one = out[out.g == 0]
    assert np.allclose(one.prediction, 1 / (1 + np.exp(-(b0 + b1 * (one.x - m)))), atol=1e-5) and one.loo_error.between(0, 1).all()
    assert (out[out.g == 1].prediction == 1).all()
    wls = logit.iwls(df.where("g = 0"), "g").toPandas()
    assert np.allclose(sorted(wls.prediction), sorted(one.prediction), atol=0.01) and (wls.loo_deviance > 0).all()


def test_left_out_errors_of_many_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 6000
    chars = rng.lognormal(5, 0.7, n).astype(int) + 1
    good = (rng.random(n) < 1 / (1 + np.exp(-(chars - 200) / 100))).astype(int)
    spark.createDataFrame([(k, int(c)) for k, c in enumerate(chars)], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(g)) for k, g in enumerate(good)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = catalog.ulogit(spark, str(tmp_path)).toPandas()
    assert len(out) == n and out.loo_error.notna().all()
    one = out[out.g == 0].reset_index(drop=True)
    x, y = one.x.to_numpy(), one.y.to_numpy()
    for i in [int(np.argmin(x)), int(np.argmax(x)), int(np.argmax(one.loo_error)), *range(0, len(x), 200)]:
        w = np.ones(len(x))
        w[i] = 0
        m = (w * x).sum() / w.sum()
        b = logit._newton(x, y, w, m, logit.RIDGE)
        assert one.loo_error[i] == pytest.approx((y[i] - 1 / (1 + math.exp(-(b[0] + b[1] * (x[i] - m))))) ** 2, abs=1e-9)


def test_plans_over_k_and_p(spark):
    _, points = cloud(spark, 60)
    y = points.select("vertex", F.col("x")[0].alias("y"))
    d = pipelines.k_diagnostics(points, y, [5, 6]).toPandas()
    assert d.is_optimal.sum() >= 1 and d.gcv.gt(0).all()
    fitted, k = pipelines.data_smoother(points, 5, 6, 10)
    assert k in (5, 6) and fitted.count() % 4 == 0
    assert pipelines.componentwise_fit(points, y, 2).count() == 60
    assert pipelines.iknn_response(points, y, [5, 7]).count() == 60
    positive = points.select("vertex", F.transform("x", lambda v: v * v).alias("x"))
    lp = pipelines.lp_graphs(positive, y, [0.5, 1.0], [7])
    assert lp.count() == 2 and pipelines.optimal_p(lp, 0.6).count() <= 1
    with pytest.raises(ValueError):
        pipelines.lp_graphs(points, y, [0.5], [5])
    got = pipelines.lp_round_trip(positive, [0.5, 1.0], [0.5])
    assert {r.p for r in got.collect()} == {0.5} and got.count() == 60
    model = plans.fit(points, y, 6, 8, check_connected=False)
    assert pipelines.pextrema(model).where("share < 0").count() == 0
    assert pipelines.hop_extremality(model).where("radius < -1").count() == 0
    assert pipelines.gamma_select(model, [0.5, 1.0]).count() == 2
    dens = plans.smoothed_density(model).agg(F.min("density"), F.max("density")).first()
    assert dens[0] == pytest.approx(0) and dens[1] == pytest.approx(1)


def test_box_cox_and_orders(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(v),) for v in np.exp(rng.normal(size=400))], "value double")
    assert abs(pipelines.box_cox_mle(df, "value")) < 0.2
    assert orders.right_winsorize(df, "value", 0, "w").where("w != value").count() == 0
    with pytest.raises(ValueError):
        orders.winsorize(df, "value", 0.3, "w")
    with pytest.raises(ValueError):
        fx.power(F.col("value"), 2)


def test_cache_modes(spark, tmp_path):
    path, made = str(tmp_path / "c"), []

    def make():
        made.append(1)
        return spark.range(3)

    with pytest.raises(Exception):
        tables.cached(spark, path, "read", make)
    assert tables.cached(spark, path, "none", make).count() == 3 and tables.cached(spark, path, "readwrite", make).count() == 3
    assert tables.cached(spark, path, "readwrite", make).count() == tables.cached(spark, path, "read", make).count() == 3 and len(made) == 2
    with pytest.raises(ValueError):
        tables.cached(spark, path, "odd", make)
    tables.csv_append(spark.range(2), str(tmp_path / "csv"))
    tables.csv_append(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4


def test_registration(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def path_laplacian(spark, n):
    edges = [(i, i + 1) for i in range(n - 1)]
    a = np.zeros((n, n))
    for i, j in edges:
        a[[i, j], [i, j]] += 1
        a[i, j] = a[j, i] = -1
    rows = [(i, j, float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]]
    return a, spark.createDataFrame(rows, "i long, j long, val double"), spark.createDataFrame([(i, j, 1.0) for i, j in edges], "i long, j long, length double")


@pytest.mark.parametrize("limit", [5000, 2])
def test_implicit_steps_equal_dense_algebra(spark, monkeypatch, limit):
    a, lap, _ = path_laplacian(spark, 6)
    b = np.array([3.0, 0, 1, -2, 5, 0.5, 7.0])  # the last vertex is in no row of the operator
    a = np.pad(a, (0, 1))
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "vertex long, x double")
    monkeypatch.setattr(spectral, "DENSE", limit)
    got = {r.vertex: r.x for r in walks.tikhonov(lap, table, 0.7).collect()}
    want = np.linalg.solve(np.eye(7) + 0.7 * a, b)
    assert np.allclose([got[i] for i in range(7)], want, atol=1e-6)
    got = {r.vertex: r.x for r in walks.heat(lap, table, 0.4, 2).collect()}
    want = np.linalg.solve(np.eye(7) + 0.2 * a, np.linalg.solve(np.eye(7) + 0.2 * a, b))
    assert np.allclose([got[i] for i in range(7)], want, atol=1e-6)
    assert sorted(map(tuple, walks.heat(lap, table, 0.0).collect())) == sorted(map(tuple, table.collect()))


@pytest.mark.parametrize("spread", [0.0, 8.0])
def test_lowest_pairs_of_tame_and_badly_scaled_operators(spark, spread):
    rng = np.random.default_rng(3)
    n, m = 240, 6
    c = np.zeros((n, n))
    at = rng.normal(size=(n, 3))
    at[200:] += 50  # a component of its own: zero is there twice
    for i in range(n):
        for j in np.argsort(((at - at[i]) ** 2).sum(1))[1:7]:
            c[i, j] = c[j, i] = rng.uniform(0.5, 2)
    mass = 10 ** rng.uniform(-spread, 0, n)
    a = (np.diag(c.sum(1)) - c) / np.sqrt(np.outer(mass, mass))
    lap = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, val double")
    low = spectral.lowest(lap, m)
    assert np.allclose(low.values, np.linalg.eigvalsh(a)[:m], atol=1e-6)
    v = np.array([r.v for r in low.vectors.orderBy("vertex").collect()])
    assert v.shape == (n, m) and np.allclose(v.T @ v, np.eye(m), atol=1e-6)
    with pytest.raises(RuntimeError, match="residuals"):
        spectral.lowest(lap, m, rounds=3)


def test_factors_of_the_preconditioner_leave_a_chebyshev_residual():
    middle, half = spectral._span(1.7)
    t = np.linspace(0, 1.7, 50)
    left = 1 - t * np.polynomial.polynomial.polyval(t, spectral._factors(1.7))
    cheb = np.polynomial.chebyshev.Chebyshev.basis(spectral.PRODUCTS)
    assert np.allclose(left, cheb((middle - t) / half) / cheb(middle / half), atol=1e-12)


@pytest.mark.parametrize("spread", [0.0, 8.0])
def test_solves_by_products_equal_dense_algebra(spark, monkeypatch, spread):
    rng = np.random.default_rng(5)
    n = 400
    c = np.zeros((n, n))
    for i, j in [(i, i + 1) for i in range(n - 1)] + [tuple(sorted(p)) for p in rng.integers(0, n, (300, 2)) if p[0] != p[1]]:
        c[i, j] = c[j, i] = rng.uniform(0.5, 2)
    mass = 10 ** rng.uniform(-spread, 0, n)  # as of densities at their floor
    a = (np.diag(c.sum(1)) - c) / np.sqrt(np.outer(mass, mass))
    b = rng.normal(size=n)
    lap = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, val double")
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "vertex long, x double")
    monkeypatch.setattr(spectral, "DENSE", 0)
    got = np.array([r.x for r in spectral.solve(lap, table, 1.0, 3.0, rounds=60).orderBy("vertex").collect()])
    full = np.eye(n) + 3 * a
    assert np.linalg.norm(full @ got - b) <= 2e-8 * np.linalg.norm(b)
    assert np.allclose(got, np.linalg.solve(full, b), atol=1e-6)
    with pytest.raises(RuntimeError, match="residual"):
        spectral.solve(lap, table, 1.0, 3.0, rounds=1)


def test_lazy_walk_by_hand(spark):
    _, _, edges = path_laplacian(spark, 3)
    rho = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 0.0), (9, 1.0)], "vertex long, rho double")
    walk = lambda **o: {r.vertex: r.rho for r in walks.lazy_walk(rho, edges, 1, 0.5, by_length=False, **o).collect()}
    pushed, averaged = walk(), walk(forward=False)
    raw = np.array([0.5 + 0.5 * 1, 1 + 0.5 * 1, 0.5 * 1, 0.5])
    assert np.allclose([pushed[i] for i in (0, 1, 2, 9)], raw * 4 / raw.sum())
    raw = np.array([0.5 + 0.5 * 2, 1 + 0.5 * 0.5, 0.5 * 2, 1.0])
    assert np.allclose([averaged[i] for i in (0, 1, 2, 9)], raw * 4 / raw.sum())


def test_basins_by_hand(spark):
    _, _, edges = path_laplacian(spark, 7)
    y = spark.createDataFrame([(i, float(v)) for i, v in enumerate([2, 5, 3, 1, 4, 6, 6])], "vertex long, y double")
    rho = y.select("vertex", F.lit(1.0).alias("rho"))
    sources = spark.createDataFrame([(1,), (5,)], "source long")
    got = sorted(map(tuple, walks.basins(y, edges, rho, sources).collect()))
    assert got == [
        (1, 0, 1, 1, 3.0, True), (1, 1, 0, None, 0.0, False), (1, 2, 1, 1, 2.0, False), (1, 3, 2, 2, 4.0, True),
        (5, 3, 2, 4, 5.0, True), (5, 4, 1, 5, 2.0, False), (5, 5, 0, None, 0.0, True),
    ]
    low = sorted(map(tuple, walks.basins(y, edges, rho, spark.createDataFrame([(3,)], "source long"), maxima=False).collect()))
    assert [(r[1], r[2], r[4]) for r in low] == [(1, 2, 4.0), (2, 1, 2.0), (3, 0, 0.0), (4, 1, 3.0), (5, 2, 5.0)]
    assert walks.basins(y, edges, rho, sources.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    x, points = cloud(spark)
    y = points.select("vertex", F.sin(F.col("x")[0]).alias("y"))
    fit = plans.fit(points, y, 5, 8, check_connected=False)
    order = [r.vertex for r in fit.spectrum.vectors.orderBy("vertex").collect()]
    v = np.array([r.v for r in fit.spectrum.vectors.orderBy("vertex").collect()])
    responses = points.select("vertex", F.posexplode(F.slice("x", 1, 2)).alias("col", "y"))
    table = np.array([r.x[:2] for r in points.orderBy("vertex").collect()])
    return fit, points, y, responses, order, v, table


def test_pca_gate(spark, model):
    _, points, y, *_ = model
    wide = points.withColumn("x", F.concat("x", F.transform("x", lambda v: v * 0.01)))
    n = wide.first().x
    few = metrics.pca(wide, 0.8, 2)[0]
    edges = lambda f: {(r.i, r.j) for r in f.edges.collect()}
    gated = plans.fit(wide, y, 5, 6, check_connected=False, pca_dim=2, variance_explained=0.8)
    assert edges(gated) == edges(plans.fit(few, y, 5, 6, check_connected=False))
    assert edges(plans.fit(wide, y, 5, 6, check_connected=False, pca_dim=len(n))) == edges(plans.fit(wide, y, 5, 6, check_connected=False))


def test_masked_refit_equals_dense_algebra(spark, model):
    fit, points, _, responses, order, v, table = model
    known = points.where("vertex % 3 != 0").select("vertex")
    fitted, columns = plans.refit(fit, responses, labeled=known)
    mask = np.array([i % 3 != 0 for i in order])
    system = v[mask].T @ v[mask] + fit.eta * np.diag(np.maximum(fit.spectrum.values, 0))
    want = v @ np.linalg.solve(system, v[mask].T @ table[mask])
    got = {(r.vertex, r.col): r for r in fitted.collect()}
    for k, i in enumerate(order):
        for c in (0, 1):
            assert got[i, c].y_hat == pytest.approx(want[k, c], abs=1e-7)
            assert (got[i, c].residual is None) == (not mask[k])
    assert {r.col for r in columns.collect()} == {0, 1}
    folds = {r.fold: r for r in pipelines.cross_validate(fit, responses, 3).collect()}
    dealt = {r.vertex: r.fold for r in pipelines.dealt_folds(fit.vertices, 3).collect()}
    for fold, row in folds.items():
        out = np.array([dealt[i] == fold for i in order])
        system = v[~out].T @ v[~out] + fit.eta * np.diag(np.maximum(fit.spectrum.values, 0))
        r = (table - v @ np.linalg.solve(system, v[~out].T @ table[~out]))[out]
        assert row.n_test == out.sum() and row.raw_mse == pytest.approx((r**2).mean())
    assert sum(r.n_test for r in folds.values()) == len(order)


def test_posterior_of_refits(spark, model):
    fit, _, _, responses, order, v, table = model
    rows = {(r.vertex, r.col): r for r in plans.refit_samples(fit, responses, 400, per_column=False).collect()}
    f, lam = fit.weights, np.maximum(fit.spectrum.values, 0)
    a = v.T @ table
    for c in (0, 1):
        rss = (table[:, c] ** 2).sum() - ((2 * f - f**2) * a[:, c] ** 2).sum()
        sd = np.sqrt((v**2) @ (rss / (len(order) - f.sum()) / (1 + fit.eta * lam)))
        draws = np.array([rows[i, c].s for i in order])
        assert np.allclose([rows[i, c].y_hat for i in order], v @ (f * a[:, c]), atol=1e-9)
        assert np.allclose(draws.mean(1), v @ (f * a[:, c]), atol=5 * sd.max() / 20) and np.allclose(draws.std(1, ddof=1), sd, rtol=0.25)
    table_of = spark.createDataFrame([(1, 0, [3.0, 1.0, 2.0, 5.0, 4.0])], "vertex long, col int, s array<double>")
    r = plans.credible(table_of, 0.5).first()
    assert (r.lower, r.upper, r.sd) == (2.0, 4.0, pytest.approx(np.std([1, 2, 3, 4, 5], ddof=1)))


def test_local_correlation_with_its_posterior(spark, model):
    fit, _, _, responses, *_ = model
    one = responses.where("col = 1")
    got = {r.vertex: r for r in resample.lcor_posterior(fit, one, 30, per_column=False).collect()}
    z = plans.refit(fit, one, per_column=False)[0].select("vertex", F.col("y_hat").alias("y"))
    base = fit.fitted.select("vertex", F.col("y_hat").alias("y"))
    want = {r.vertex: r.lcor for r in resample.local_correlation(base, z, fit.edges, "derivative").collect()}
    assert {i: r.lcor for i, r in got.items()} == pytest.approx(want, abs=1e-9)
    assert all(-1 - 1e-9 <= r.lower <= r.upper <= 1 + 1e-9 for r in got.values())


def test_full_coboundary_solves_its_equation(spark, model):
    fit, _, y, *_ = model
    mass = measures.edge_mass(fit.edges, graph.triangles(fit.edges, fit.sets), fit.edge_rho, fit.vertex_rho, fit.sets)
    rows = mass.collect()
    edges = sorted({(r.i, r.j) for r in rows})
    at = {e: k for k, e in enumerate(edges)}
    m1 = np.zeros((len(edges), len(edges)))
    for r in rows:
        m1[at[r.i, r.j], at[r.i2, r.j2]] += r.val
    rho, f = ({r.vertex: r[1] for r in t.select("vertex", c).collect()} for t, c in ((fit.vertex_rho, "rho"), (y, "y")))
    right = np.array([rho[j] * f[j] - rho[i] * f[i] for i, j in edges])
    got = {(r.i, r.j): r.delta for r in extrema.coboundary_full(y, fit.vertex_rho, mass).collect()}
    delta = np.array([got[e] for e in edges])
    assert np.allclose((m1 + 1e-10 * np.eye(len(edges))) @ delta, right, atol=1e-6 * max(1, np.abs(right).max()))


def test_full_coboundary_by_members_is_exact_beyond_dense_sizes(spark, model, monkeypatch):
    fit, _, y, *_ = model
    common = members.edge_members(fit.edge_rho, fit.vertex_rho, fit.sets)
    mass = measures.edge_mass(fit.edges, graph.triangles(fit.edges, fit.sets), fit.edge_rho, fit.vertex_rho, fit.sets)
    x = fit.edges.select("i", "j", (F.col("i") * 7 % 11 - F.col("j") % 5 / 3.0).alias("x"))
    rows = mass.join(x.select(F.col("i").alias("i2"), F.col("j").alias("j2"), "x"), ["i2", "j2"]).groupBy("i", "j").agg(F.sum(F.col("val") * F.col("x")).alias("x"))
    want = {(r.i, r.j): r.x for r in rows.collect()}
    diagonal = fit.edge_rho.select("i", "j", F.greatest("rho", F.lit(1e-15)).alias("d"))
    assert {(r.i, r.j): r.x for r in members.times(diagonal, common, x).collect()} == pytest.approx(want, abs=1e-9)
    assert members.edge_members(fit.edge_rho.limit(9), fit.vertex_rho, fit.sets) is None
    full = {(r.i, r.j): (r.right, r.delta) for r in extrema.coboundary_full(y, fit.vertex_rho, mass).collect()}
    for limit in (spectral.ELIMINATED, 90):
        monkeypatch.setattr(spectral, "ELIMINATED", limit)
        got = {(r.i, r.j): (r.right, r.delta) for r in extrema.coboundary_by_members(y, fit.vertex_rho, fit.edge_rho, common).collect()}
        assert got.keys() == full.keys()
        assert all(got[e] == pytest.approx(full[e], rel=1e-6, abs=1e-6) for e in full)
    monkeypatch.setattr(spectral, "ENTRIES", 0)
    with pytest.warns(UserWarning, match="residual"):
        rough = extrema.coboundary_by_members(y, fit.vertex_rho, fit.edge_rho, common, rounds=2)
    assert {(r.i, r.j): r.right for r in rough.collect()} == pytest.approx({e: r for e, (r, _) in full.items()}, abs=1e-9)


def test_gamma_is_chosen_from_the_whole_grid(spark, model, monkeypatch):
    monkeypatch.setattr(plans, "gamma_scores", lambda fit, grid: [(g, 1.0) for g in grid])
    assert [r.gamma for r in pipelines.gamma_select(model[0]).orderBy("gamma").collect()] == list(plans.GAMMAS) and len(plans.GAMMAS) == 26


def test_masses_are_solved_exactly_whatever_is_left_of_them(monkeypatch):
    rng = np.random.default_rng(8)
    sets = {m: np.unique(np.r_[m, rng.integers(0, 60, rng.integers(3, 9))]) for m in range(60)}
    pairs = sorted({(a, b, m) for m, s in sets.items() for a in s for b in s if a < b})
    edges = sorted({p[:2] for p in pairs})
    at = {e: k for k, e in enumerate(edges)}
    i, j, m = np.array(pairs).T
    edge = np.array([at[p[:2]] for p in pairs])
    d = 0.8 * np.bincount(edge)
    right = rng.integers(-9, 10, len(edges)).astype(float)
    full = np.diag(d).astype(float)
    for s in sets.values():
        own = [e for e in edges if e[0] in s and e[1] in s]
        for a in own:
            for b in own:
                full[at[a], at[b]] += a != b and len({*a, *b}) == 3
    kernel = members.Members.of(d, edge, i, j, m, np.ones(len(pairs)))
    want = np.linalg.solve(full, right)
    # a rest in memory, a rest on disk by panels, steps without a rest
    for held, front, rest in ((spectral.ELIMINATED, 1024, 1 << 15), (20, 20, 1 << 15), (20, 20, 5)):
        monkeypatch.setattr(spectral, "ELIMINATED", held)
        for name, value in (("FRONT", front), ("REST", rest), ("PANEL", 16)):
            monkeypatch.setattr(members, name, value)
        x, residual = kernel.solve(right)
        assert residual < 1e-8 and np.allclose(x, want, rtol=1e-4, atol=1e-4)
    monkeypatch.setattr(members.Members, "least", lambda self, right, tolerance: 0 * right)
    with pytest.raises(RuntimeError, match="residual"):
        kernel.solve(right)


def test_full_coboundary_query_solves_beyond_dense_sizes(spark, duck, monkeypatch):
    monkeypatch.setattr(spectral, "ELIMINATED", 700)
    with warnings.catch_warnings():
        warnings.filterwarnings("error", message="the coboundary")
        test_query_equals_its_sql(spark, duck, "coboundary_product")


def test_coherence_path_and_report(spark, model, monkeypatch):
    fit, points, y, *_ = model
    plain = plans.report(fit).first()
    assert (plain.n_iterations, plain.optimal_iteration, plain.gcv_gain_percent, plain.gamma) == (1, 1, 0.0, 0.0)
    assert plain.n_edges == fit.edges.count() and plain.adj_r_squared < plain.r_squared
    moved = plans.fit(points, y, 5, 8, check_connected=False, gamma=1.0, max_iterations=2, tolerance=0.0, patience=9, t=0.1, pull=0.01)
    assert len(moved.history) == 3 and moved.params["t"] == 0.1 and moved.history[0]["gcv"] == pytest.approx(min(s for _, s in fit.gcv))
    monkeypatch.setattr(plans, "GAMMAS", (0.2, 2.0))
    monkeypatch.setattr(plans.gamma_scores, "__defaults__", ((0.2, 2.0),))
    chosen = plans.fit(points, y, 5, 8, check_connected=False, gamma=-1.0, max_iterations=1)
    assert chosen.params["gamma"] in (0.2, 2.0)
    with pytest.raises(ValueError):
        plans.fit(points, y, 5, 8, check_connected=False, gamma=0.5, labeled=points.select("vertex"))


def test_one_logistic_fit_over_a_table_equals_the_grouped_one(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.3 + x - 0.4 * x * x)))).astype(float)
    rows = spark.createDataFrame([(int(k), float(a), float(b), 1.0 + k % 2, 1) for k, (a, b) in enumerate(zip(x, y))], "id long, x double, y double, w double, g int")
    for quadratic in (False, True):
        one = logit.iwls_table(rows, quadratic)[0].orderBy("x").toPandas()
        group = logit.iwls(rows, "g", quadratic).orderBy("x").toPandas()
        for c in ("prediction", "loo_brier", "loo_deviance"):
            assert np.allclose(one[c], group[c], atol=1e-5), c


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_operators_between_dense_and_joined_sizes_are_solved_in_one_kernel(spark, monkeypatch, spread):
    rng = np.random.default_rng(11)
    n, m = 360, 6
    c = np.zeros((n, n))
    part = np.zeros((n // 3, n // 3))
    for i, j in [(i, i + 1) for i in range(n // 3 - 1)] + [tuple(sorted(p)) for p in rng.integers(0, n // 3, (200, 2)) if p[0] != p[1]]:
        part[i, j] = part[j, i] = rng.uniform(0.5, 2)
    for k in range(3):  # three equal components: every eigenvalue is there three times
        c[k * n // 3 : (k + 1) * n // 3, k * n // 3 : (k + 1) * n // 3] = part
    mass = np.tile(10 ** rng.uniform(-spread, 0, n // 3), 3)
    a = (np.diag(c.sum(1)) - c) / np.sqrt(np.outer(mass, mass))
    lap = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, val double")

    def joins(*args, **kwargs):
        raise AssertionError("products by joins")

    for name in ("lowest", "lanczos", "scaled"):
        monkeypatch.setattr(spectral, name, joins)
    low = spectral.spectrum(lap, m, dense_limit=n - 100)
    assert np.allclose(low.values, np.linalg.eigvalsh(a)[:m], atol=1e-6)
    v = np.array([r.v for r in low.vectors.orderBy("vertex").collect()])
    assert np.allclose(v.T @ v, np.eye(m), atol=1e-6) and np.abs(a @ v - v * low.values).max() <= 1e-5
    monkeypatch.setattr(spectral, "DENSE", n - 100)
    b = rng.normal(size=n + 1)  # the last vertex is in no row of the operator
    table = spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "vertex long, x double")
    got = np.array([r.x for r in spectral.solve(lap, table, 1.0, 3.0).orderBy("vertex").collect()])
    assert np.allclose(got, np.append(np.linalg.solve(np.eye(n) + 3 * a, b[:n]), b[n]), atol=1e-8)


def test_kernels_of_a_value_of_zero(spark, tmp_path):
    rows = [(1, 7, 0.0), (2, 7, 20.0), (3, 8, 80.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r for r in catalog.kernel_eval(spark, str(tmp_path)).collect()}
    assert [got[e].hyperbolic for e in (1, 2, 3)] == [math.inf, 2.0, 0.5]
    assert got[1].epanechnikov == got[1].cosine == 1.0 and got[3].epanechnikov == 0.0


def test_kernels_of_negative_and_tiny_values_equal_their_sql(spark, tmp_path):
    values = [-100.0, -40.0, -30.0, -0.5, 4.0724657047685666e-11, 6.383139324603916e-12, 1e-300, 5e-324, 40.96, 204.8, math.nan, None]
    spark.createDataFrame(list(enumerate([7] * len(values))), "event_id long, user_id long").join(spark.createDataFrame(list(enumerate(values)), "event_id long, value double"), "event_id").write.parquet(f"{tmp_path}/events.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {r[0]: r for r in own.execute(catalog.ORACLES["kernel_eval"]).fetchall()}
    for r in catalog.kernel_eval(spark, str(tmp_path)).collect():
        assert repr(tuple(r)) == repr(want[r.event_id])


def test_triangles_carry_the_mass_of_their_members(spark):
    rng = np.random.default_rng(4)
    pairs = sorted({tuple(sorted(map(int, p))) for p in rng.integers(0, 14, (60, 2)) if p[0] != p[1]})
    held = {v: {v, *map(int, rng.integers(0, 14, 4))} for v in range(14)}
    w = {v: 0.5 + v for v in range(14)}
    edges = spark.createDataFrame(pairs, "i long, j long")
    sets = spark.createDataFrame([(v, m) for v in held for m in held[v]], "vertex long, member long")
    found = graph.triangles(edges, sets, spark.createDataFrame(list(w.items()), "vertex long, w double"))
    want = {}
    for a, b, c in [(a, b, c) for a, b in pairs for c in range(b + 1, 14) if (a, c) in pairs and (b, c) in pairs]:
        common = held[a] & held[b] & held[c]
        if common:
            want[a, b, c] = (len(common), sum(w[m] for m in common))
    got = {(r.v0, r.v1, r.v2): (r.isize, r.mass) for r in found.collect()}
    assert got == want and len(got) > 3
    assert {tuple(r) for r in graph.triangles(edges, sets).collect()} == {(*k, n) for k, (n, _) in want.items()}
