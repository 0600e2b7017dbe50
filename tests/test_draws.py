"""Tails against published values, draws as arrays against dense algebra, and searches in words of bits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.functions import tails
from lumenfield.operators import bits, draws, extrema, graph, meanshift, measures, spectral
from lumenfield.plans import fit as plans
from lumenfield.plans import pipelines


def test_tails_by_published_values():
    weights = np.array([[148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]])
    w, p = tails.shapiro_wilk(weights)
    assert w[0] == pytest.approx(0.78881469) and p[0] == pytest.approx(0.00670381, rel=1e-4)
    assert tails.student_two_sided(np.array([2.228139, 2.085963]), 10)[0] == pytest.approx(0.05, abs=1e-6)
    assert tails.student_two_sided(np.array([12.7062]), 1)[0] == pytest.approx(0.05, abs=1e-6)
    before, after = np.array([1.83, 0.50, 1.62, 2.48, 1.68, 1.88, 1.55, 3.06, 1.30]), np.array([0.878, 0.647, 0.598, 2.05, 1.06, 1.29, 1.06, 3.14, 1.29])
    v, p = tails.wilcoxon((before - after)[None])
    assert (v[0], p[0]) == (40, pytest.approx(0.0390625))


def test_signed_ranks_by_enumeration():
    rng = np.random.default_rng(0)
    for n in (4, 9):
        x = rng.normal(0.4, 1, n)
        order = np.argsort(np.argsort(np.abs(x))) + 1
        v = order[x > 0].sum()
        all_v = np.array([sum(order[k] for k in range(n) if m >> k & 1) for m in range(1 << n)])
        one = (all_v >= v).mean() if v > n * (n + 1) / 4 else (all_v <= v).mean()
        assert tails.wilcoxon(x[None])[1][0] == pytest.approx(min(1, 2 * one))
    tied = np.array([[1.0, -1.0, 2.0, 2.0, 0.0, 3.0], [0.0] * 6])
    stat, p = tails.wilcoxon(tied)
    # ranks 1.5 1.5 3.5 3.5 5: V = 13.5, mean 7.5, variance 5 * 6 * 11 / 24 - 2 * 6 / 48
    assert stat[0] == 13.5 and p[0] == pytest.approx(2 * float(tails.normal_upper(np.array((13.5 - 7.5 - 0.5) / np.sqrt(13.5)))))
    assert np.isnan(p[1])


def test_box_cox_powers_of_rows():
    rng = np.random.default_rng(3)
    z = rng.normal(size=(3, 400))
    rows = np.stack([np.exp(z[0] / 2), (z[1] / 8 + 2) ** 2, z[2] - 5])
    moved, lam, shift = tails.box_cox_rows(rows)
    assert list(shift[:2]) == [0, 0] and shift[2] > 5 and np.isfinite(moved).all()
    grid = np.linspace(-2, 2, 4001) + 1e-9
    for x, best in zip(rows + shift[:, None], lam):
        likelihood = [-len(x) / 2 * np.log((((x**g) - 1) / g).var()) + (g - 1) * np.log(x).sum() for g in grid]
        assert abs(grid[int(np.argmax(likelihood))] - best) < 2e-3


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 3))
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vertex long, x array<double>").repartition(5)
    y = points.select("vertex", F.sin(F.col("x")[0]).alias("y"))
    z = points.select("vertex", (F.col("x")[0] + F.col("x")[1]).alias("y"))
    return plans.fit(points, y, 5, 8, check_connected=False), spectral._checkpointed(y), spectral._checkpointed(z)


def dense(model, y, b, seed):
    fit = model
    rows = sorted(y.join(fit.spectrum.vectors, "vertex").collect(), key=lambda r: r.vertex)
    v, ys, ids = np.array([r.v for r in rows]), np.array([r.y for r in rows]), np.array([r.vertex for r in rows])
    w = draws.exponentials(ids, b, seed)
    w = w / w.sum(0) * len(ids)
    return v, ys, ids, v @ (fit.weights[:, None] * (v.T @ (w * ys[:, None])))


def test_bootstrap_equals_dense_algebra(spark, model):
    fit, y, _ = model
    _, ys, ids, s = dense(fit, y, 29, 4)
    got = draws.bootstrap(fit, y, 29, 4, 0.9).orderBy("vertex").toPandas()
    own = np.array([r.y_hat for r in fit.fitted.orderBy("vertex").collect()])
    assert np.allclose(got[["lower", "median", "upper"]].T, np.quantile(s, [0.05, 0.5, 0.95], axis=1)) and np.allclose(got["sd"], s.std(1, ddof=1))
    far, seen = np.abs(s - ys.mean()), np.abs(own - ys.mean())[:, None]
    assert np.allclose(got["pseudo_p"], np.minimum(1, 2 * np.minimum((far >= seen).mean(1), (far <= seen).mean(1)))) and np.allclose(got["p_above"], (s > ys.mean()).mean(1))
    top = {r.stat: r for r in draws.bootstrap_global(fit, y, 29, 4, 0.9).collect()}
    edge = max(1e-6, 0.5 / len(ids))
    scales = {"l2": lambda p: p, "log": lambda p: np.log(np.clip(p, edge, 1 - edge)), "logit": lambda p: np.log(np.clip(p, edge, 1 - edge) / (1 - np.clip(p, edge, 1 - edge)))}
    for name, f in scales.items():
        d, o = ((f(s) - f(ys.mean())) ** 2).sum(0), ((f(own) - f(ys.mean())) ** 2).sum()
        r = top[name]
        assert (r.observed, r.mean, r.lower, r.upper, r.prob_ge) == pytest.approx((o, d.mean(), *np.quantile(d, [0.05, 0.95]), (d >= o).mean()))
    assert draws.bootstrap(fit, y, 9, 1, per_column=True).count() == len(ids)


@pytest.mark.parametrize("test, box_cox, slope, ascending", [("paired.t", "auto", "normalized", True), ("wilcoxon", "never", "slope", True), ("weighted.pvalue", "always", "sign", False)])
def test_paired_slopes_equal_plain_loops(spark, model, monkeypatch, test, box_cox, slope, ascending):
    fit, y, z = model
    b = 19
    monkeypatch.setattr(draws, "HELD", 500)
    got = {r.vertex: r for r in draws.slope_test(fit, y, z, b, 2, test, box_cox, slope=slope, ascending=ascending).collect()}
    v, ys, ids, signal = dense(fit, y, b, 2)
    from lumenfield.operators.resample import permuted

    other = {r.vertex: r.y for r in permuted(y, 1, 3).collect()}
    w = draws.exponentials(ids, b, 2)
    w = w / w.sum(0) * len(ids)
    null = v @ (fit.weights[:, None] * (v.T @ (w * np.array([other[i] for i in ids])[:, None])))
    zs = {r.vertex: r.y for r in z.collect()}
    z_hat = v @ (fit.weights * (v.T @ np.array([zs[i] for i in ids])))
    point = v @ (fit.weights * (v.T @ ys))
    at = {int(i): k for k, i in enumerate(ids)}
    near = {k: [] for k in at.values()}
    for r in fit.edges.collect():
        near[at[r.i]].append(at[r.j])
        near[at[r.j]].append(at[r.i])
    sign = 1 if ascending else -1

    def slopes(f):
        out = np.zeros(len(f))
        for k in range(len(f)):
            best = max(near[k], key=lambda j: (sign * (f[j] - f[k]), -j), default=None)
            if best is not None and sign * (f[best] - f[k]) > 0:
                dz = z_hat[best] - z_hat[k]
                value = dz / (f[best] - f[k])
                out[k] = {"slope": value, "sign": np.sign(dz), "normalized": np.tanh(value)}[slope]
        return out

    one, two = (np.array([slopes(s[:, k]) for k in range(b)]).T for s in (signal, null))
    want = draws.tested(one, two, test, box_cox, 0.05)
    for i, k in at.items():
        r = got[i]
        assert (r.lslope, r.signal_mean, r.null_sd, r.diff_sd) == pytest.approx((slopes(point)[k], one[k].mean(), two[k].std(ddof=1), (one - two)[k].std(ddof=1)), abs=1e-8)
        for c in ("p_value", "shapiro_p", "boxcox_lambda"):
            assert (r[c] is None) == bool(np.isnan(want[c][k])) and (r[c] is None or r[c] == pytest.approx(want[c][k], abs=1e-6)), c
        assert r.p_value is None or r.p_adjusted >= r.p_value - 1e-12
    assert sum(r.p_value is not None for r in got.values()) > 40
    with pytest.raises(ValueError):
        draws.slope_test(fit, y, z, b, test="sign")


def test_words_of_bits_hold_more_than_64_sources(spark, model):
    n = 200
    ring = spark.range(n).select(F.col("id").alias("i"), ((F.col("id") + 1) % n).alias("j"))
    ring = ring.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    source = bits.placed(spark.range(150).select(F.col("id").alias("source")))
    state = bits.spread(bits.started(source), graph.directed(ring))
    got = {(r.word * 64 + r.bit): (r.n, r.s) for r in bits.sums(state, {"n": F.lit(1.0), "s": F.col("vertex").cast("double")}).collect()}
    assert got == {k: (2.0, float((k - 1) % n + (k + 1) % n)) for k in range(150)}
    assert bits.masks(source.where("source in (0, 63, 64)")).orderBy("word").collect() == [(0, 1 | -(1 << 63)), (1, 1)]


def test_hop_extremality_equals_plain_sets(spark, model):
    fit, *_ = model
    got = {r.vertex: r for r in pipelines.hop_extremality(fit, 0.6, 4).collect()}
    y = {r.vertex: r.y_hat for r in fit.fitted.collect()}
    rho = {r.vertex: r.rho for r in fit.vertex_rho.collect()}
    near = {k: set() for k in y}
    for r in fit.edges.collect():
        near[r.i].add(r.j)
        near[r.j].add(r.i)
    m = {k: rho[k] * y[k] for k in y}
    seen = 0
    for k, r in got.items():
        if r.score is None or abs(r.score) < 0.6 or y[k] in (min(y.values()), max(y.values())):
            continue
        inside, radius, size = {k}, 0, 1
        for hop in range(1, 5):
            out = [(v, u) for v in inside for u in near[v] if u not in inside]
            s, a = sum(m[v] - m[u] for v, u in out), sum(abs(m[v] - m[u]) for v, u in out)
            if not a > 1e-15 or abs(s / a) < 0.6 or np.sign(s) != np.sign(r.score):
                break
            inside |= {u for _, u in out}
            radius, size = hop, len(inside)
        assert (r.radius, r.size) == (radius, size), k
        seen += radius > 0
    assert seen


def test_indefinite_systems_keep_the_least_residual(spark, monkeypatch):
    rng = np.random.default_rng(2)
    a = np.diag(rng.choice([-2.0, 1.0, 3.0], 30))
    a[3, 4] = a[4, 3] = 0.5
    lap = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, val double")
    b = rng.normal(size=30)
    right = spark.createDataFrame([(k, float(v)) for k, v in enumerate(b)], "vertex long, x double")
    want = np.linalg.solve(a + 0.1 * np.eye(30), b)
    for limit in (100, 2):
        monkeypatch.setattr(spectral, "ELIMINATED", limit)
        x, residual = spectral.least_residual(lap, right, 0.1)
        assert residual < 1e-7 and np.allclose([r.x for r in x.orderBy("vertex").collect()], want, atol=1e-6)
    _, rough = spectral.least_residual(lap, right, 0.1, rounds=1)
    assert 0.1 < rough < 1


def test_strong_edges_leave_low_eigenpairs_to_the_sparse_kernel(spark, monkeypatch):
    rng, n, m = np.random.default_rng(3), 400, 6
    a = np.zeros((n, n))
    for i in range(n):
        for j in rng.choice(n, 4, replace=False):
            if i != j:
                c = 10.0 ** rng.uniform(0, 6) if rng.random() < 0.3 else 1.0
                a[i, j] -= c
                a[j, i] -= c
    a -= np.diag(a.sum(1))
    lap = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, val double")
    monkeypatch.setattr(spectral, "lowest", None)  # the joins are not needed
    low = spectral.spectrum(lap, m, dense_limit=300)
    v = np.array([r.v for r in low.vectors.orderBy("vertex").collect()])
    assert np.allclose(low.values, np.linalg.eigvalsh(a)[:m], atol=1e-5)
    assert np.allclose(v.T @ v, np.eye(m), atol=1e-8) and np.linalg.norm(a @ v - v * low.values, axis=0).max() < 1e-5


def test_zero_modes_are_counted_by_components(spark):
    edges = [(0, 1), (1, 2), (3, 4)]
    a = np.zeros((5, 5))
    for i, j in edges:
        a[[i, j], [j, i]] -= 1
        a[[i, j], [i, j]] += 1
    a[4, 4] += 0.1  # the second component takes its root elsewhere
    rho = np.array([1.0, 4, 2, 1, 1])
    a /= np.sqrt(np.outer(rho, rho))
    lap = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, val double")
    root = spark.createDataFrame([(k, float(v)) for k, v in enumerate(np.sqrt(rho))], "vertex long, x double")
    assert spectral.zero_modes(lap, root) == 1 == int((np.abs(np.linalg.eigvalsh(a)) < 1e-10).sum())


def test_chosen_step_and_modulated_triangles(spark, model):
    assert [meanshift.chosen_step(m) for m in ([1.0], [1.0, 5.0, 2.0, 2.0], [0.0, 3.0])] == [0, 2, 1]
    fit, y, _ = model
    tri = spectral._checkpointed(graph.triangles(fit.edges, fit.sets))
    mass = spectral._checkpointed(measures.edge_mass(fit.edges, tri, fit.edge_rho, fit.vertex_rho, fit.sets))
    total = lambda m: m.agg(F.sum("val")).first()[0]
    moved = measures.triangle_modulation(mass, tri, y, 1.0)
    assert total(moved) == pytest.approx(total(mass)) and moved.count() == mass.count()
    flat = measures.triangle_modulation(mass, tri, y.withColumn("y", F.lit(1.0)), 1.0).join(mass.withColumnRenamed("val", "old"), ["i", "j", "i2", "j2"])
    assert flat.where("abs(val - old) > 1e-9").isEmpty()


def test_fits_of_many_components_equal_single_fits(spark, monkeypatch):
    rng = np.random.default_rng(11)
    sizes = [12, 15, 3, 30, 1, 11, 40]
    rows, truth, n = [], {}, 0
    for c, size in enumerate(sizes):
        for v in rng.normal(size=(size, 2)):
            rows.append((n, [float(100 * c + v[0]), float(v[1])], float(np.sin(v[0]) + c)))
            n += 1
    df = spectral._checkpointed(spark.createDataFrame(rows, "vertex long, x array<double>, y double").repartition(3))
    points, y = df.select("vertex", "x"), df.select("vertex", "y")
    _, edges = plans.neighbourhood(points, 4)
    labels = {r.vertex: r.component for r in graph.components(points.select("vertex"), edges).collect()}
    for c in set(labels.values()):
        own = [v for v, l in labels.items() if l == c]
        mine = y.where(F.col("vertex").isin(own))
        if len(own) < 10:
            mean = mine.agg(F.avg("y")).first()[0]
            truth |= {v: mean for v in own}
        else:
            fit = plans.fit(None, mine, 4, edges=edges.where(F.col("i").isin(own)), check_connected=False)
            truth |= {r.vertex: r.y_hat for r in fit.fitted.collect()}
    for limit in (2048, 35):
        monkeypatch.setattr(pipelines, "DENSE_COMPONENT", limit)
        got = {r.vertex: r for r in pipelines.componentwise_fit(points, y, 4).collect()}
        assert len(got) == n and all(got[v].component == labels[v] for v in got)
        assert {v: got[v].y_hat for v in got} == pytest.approx(truth, abs=1e-8)


def test_fits_carry_intervals_and_extremality(spark, model):
    from lumenfield.operators import resample

    fit, y, _ = model
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.random.default_rng(7).normal(size=(80, 3)))], "vertex long, x array<double>")
    got = plans.fit(points, y, 5, 8, check_connected=False, with_posterior=40, seed=3, compute_extremality=True, extremality_share=0.6, max_hop=2)
    assert np.allclose(got.posterior.orderBy("vertex").toPandas(), resample.posterior(fit, y, 40, 3).orderBy("vertex").toPandas())
    assert np.allclose(got.extremality.orderBy("vertex").toPandas(), pipelines.hop_extremality(fit, 0.6, 2).orderBy("vertex").toPandas(), equal_nan=True)
    assert fit.posterior is None and fit.extremality is None


def test_caches_of_other_tables_and_missing_results_are_told(spark, tmp_path):
    from lumenfield.sources import tables

    a, b = spark.range(5), spark.range(1, 6)
    assert tables.fingerprint(a) == tables.fingerprint(a.repartition(3)) != tables.fingerprint(b)
    path = str(tmp_path / "kept")
    make = lambda df: lambda: df.select((F.col("id") * 2).alias("x"))
    assert tables.cached(spark, path, "readwrite", make(a), a).agg(F.sum("x")).first()[0] == 20
    with pytest.raises(ValueError, match="another table"):
        tables.cached(spark, path, "read", make(b), b)
    assert tables.cached(spark, path, "readwrite", make(b), b).agg(F.sum("x")).first()[0] == 30
    assert tables.cached(spark, path, "read", make(b), b).count() == 5
    tables.lp_save(spark.createDataFrame([(1, 0.5)], "v int, p double"), str(tmp_path / "lp"))
    with pytest.warns(UserWarning, match="0.75"):
        assert tables.lp_load(spark, str(tmp_path / "lp"), [0.5, 0.75]).count() == 1


def test_slopes_and_errors_near_the_ends(spark, model):
    from lumenfield.operators import metrics, resample

    edges = spark.createDataFrame([(0, 1, 2.0), (1, 2, 1.0), (3, 4, 1.0)], "i long, j long, length double")
    y = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 6.0), (3, 1.0), (4, 1.0), (5, 0.0)], "vertex long, y double")
    z = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 9.0), (3, 1.0), (4, 5.0), (5, 0.0)], "vertex long, y double")
    at = lambda *a: [r.slope for r in resample.local_slope(y, z, edges, *a).orderBy("vertex").collect()]
    assert at() == [-0.5, 3.0, 0, 0, 0, 0] and at("sign") == [-1, 1, 0, 0, 0, 0] and at("normalized")[1] == pytest.approx(np.tanh(3))
    assert at("neighborhood") == pytest.approx([-0.5, 25 / 13, 3.0, 0, 0, 0])
    assert at("neighborhood", True)[1] == pytest.approx(((-2) * 1 / 4 + 27) / (4 / 4 + 9))
    line = spark.createDataFrame([(float(k), 0.0, float(k)) for k in range(11)], "c double, y_true double, y_hat double")
    assert metrics.boundary_rmse(line, "line", "c").first()[0] == pytest.approx(np.sqrt((0 + 1 + 81 + 100) / 4))
    assert metrics.boundary_rmse(line.where("c = 1"), "line", "c").first()[0] is None
    assert metrics.boundary_rmse(line, "circle", "c", 0.5).first()[0] == pytest.approx(np.sqrt((0 + 36) / 2))
