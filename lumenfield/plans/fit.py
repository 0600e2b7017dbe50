"""Conditional expectation over a neighbourhood graph: fit once, refit many responses."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lumenfield.functions.columns import eta_grid_fit, eta_grid_refit, uniform
from lumenfield.operators import graph, measures, metrics, spectral


@dataclass
class Fit:
    vertices: DataFrame
    edges: DataFrame  # i, j, isize, length
    sets: DataFrame
    vertex_rho: DataFrame
    edge_rho: DataFrame
    laplacian: DataFrame
    spectrum: spectral.Spectrum
    filter: str
    eta: float
    gcv: list[tuple[float, float]]
    fitted: DataFrame  # vertex, y, y_hat, residual
    params: dict = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)
    posterior: DataFrame | None = None  # vertex, lower, upper, sd
    extremality: DataFrame | None = None  # vertex, score, radius, size

    @property
    def weights(self) -> np.ndarray:
        return spectral.filter_matrix(self.filter, self.spectrum.values, [self.eta])[0]


def neighbourhood(points: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(knn, edges) of the shared-neighbour graph; a vertex counts among its k + 1 neighbours."""
    near = spectral._checkpointed(graph.knn(points, k + 1))
    return near, spectral._checkpointed(graph.iknn(near))


def geometry(vertices: DataFrame, edges: DataFrame, k: int, measure: DataFrame | None = None):
    """(sets, vertex_rho, edge_rho) by the counting measure or a given one."""
    sets = spectral._checkpointed(graph.neighbour_sets(vertices, edges, k + 1))
    mu = measure if measure is not None else measures.counting_measure(vertices)
    return sets, spectral._checkpointed(measures.vertex_density(sets, mu)), spectral._checkpointed(measures.edge_density(edges, sets, mu))


def fit(
    points: DataFrame | None, y: DataFrame, k: int = 5, n_eigenpairs: int = 10, filter: str = "heat_kernel", labeled: DataFrame | None = None, edges: DataFrame | None = None, measure: str = "counting",
    alpha: float = 1.5, max_iterations: int = 10, tolerance: float = 1e-4, patience: int = 4, check_connected: bool = True, pca_dim: int | None = None, variance_explained: float = 0.95,
    gamma: float = 0.0, t: float | None = None, pull: float | None = None, t_scale: float = 0.5, beta_scale: float = 0.1, update_t: bool = False,
    with_posterior: int = 0, credible_level: float = 0.95, seed: int = 1, compute_extremality: bool = False, extremality_share: float = 0.9, max_hop: int = 30,
) -> Fit:
    """Graph, densities, operator, low spectrum, and the filter whose GCV is least.

    points: (vertex, x), or edges (i, j, length) instead. y: (vertex, y). Features of more than ``pca_dim``
    columns are projected first, to as many components as reach ``variance_explained`` and at most ``pca_dim``.

    With the counting measure and gamma 0 densities do not change, so nothing iterates. Otherwise densities
    diffuse (for time ``t``, pulled to uniform by ``pull``; from the spectral gap where these are None, and again in each
    round with ``update_t``) until the fitted values settle or GCV has not improved ``patience`` times. gamma above 0
    lowers the edge masses across which the fitted response changes; a negative one is chosen from a grid by GCV.

    The fit carries intervals from ``with_posterior`` samples, and each vertex's extremality with the hops over which at least
    ``extremality_share`` of it holds, when asked for.
    """
    if labeled is not None and gamma:
        raise ValueError("with labelled vertices gamma must be 0")
    if edges is None:
        if pca_dim is not None and points.select(F.max(F.size("x"))).first()[0] > pca_dim:
            points = spectral._checkpointed(metrics.pca(points, variance_explained, pca_dim)[0])
        _, edges = neighbourhood(points, k)
        vertices = points.select("vertex")
    else:
        if measure == "distance":
            raise ValueError("a given graph has no neighbour distances for the distance measure")
        vertices = y.select("vertex")
        edges = edges if "isize" in edges.columns else edges.withColumn("isize", F.lit(None).cast("long"))
    if check_connected and graph.components(vertices, edges).select("component").distinct().count() > 1:
        raise ValueError("the graph is not connected: fit its components one by one, or use a larger k")
    mu = None
    if measure == "distance":
        dk = graph.directed(edges, "length").groupBy("vertex").agg(F.max("length").alias("dk"))
        mu = measures.distance_measure(dk, alpha)
    sets, vertex_rho, edge_rho = geometry(vertices, edges, k, mu)
    settings = {"k": k, "n_eigenpairs": n_eigenpairs, "measure": measure, "gamma": gamma, "t": t, "pull": pull}
    best, last, worse, history = None, None, 0, []
    iteration, moving = 0, measure == "distance" or gamma != 0
    while True:
        mass = edge_rho
        if iteration:
            if settings["t"] is None or (update_t and t is None):
                gap = float(low.values[1]) if len(low.values) > 1 else 0.0
                settings["t"] = t if t is not None else spectral.diffusion_parameters(gap, t_scale, beta_scale)[0]
            used = settings["t"]
            settings["pull"] = pull if pull is not None else max(1e-4, beta_scale / used) if used else 0.0
            vertex_rho = spectral._checkpointed(spectral.diffuse(lap, vertex_rho, used, settings["pull"]))
            edge_rho = spectral._checkpointed(measures.edge_density(edges, sets, vertex_rho.select("vertex", F.col("rho").alias("w"))))
            mass = edge_rho
            if settings["gamma"] > 0:
                hat = last.fitted.select("vertex", F.col("y_hat").alias("y"))
                mass = spectral._checkpointed(measures.response_modulation(edge_rho, hat, settings["gamma"]))
        lap = spectral._checkpointed(measures.laplacian(vertex_rho, mass))
        low = spectral.spectrum(lap, n_eigenpairs)
        eta, scores, fitted = smooth(low, y, filter, labeled)
        now = Fit(vertices, edges, sets, vertex_rho, edge_rho, lap, low, filter, eta, scores, spectral._checkpointed(fitted) if moving else fitted, settings)
        gcv = min(s for _, s in scores)
        change = None
        if last is not None:
            d = fitted.join(last.fitted.select("vertex", F.col("y_hat").alias("old")), "vertex").agg(F.sum(F.pow(F.col("y_hat") - F.col("old"), 2)), F.sum(F.pow("old", F.lit(2)))).first()
            change = (d[0] / max(d[1], 1e-300)) ** 0.5
        history.append({"iteration": iteration + 1, "eta": eta, "gcv": gcv, "change": change})
        worse = 0 if best is None or gcv < min(s for _, s in best.gcv) - 1e-7 else worse + 1
        if best is None or gcv < min(s for _, s in best.gcv):
            best = now
        last = now
        if not iteration and gamma < 0:
            settings["gamma"] = min(gamma_scores(now), key=lambda r: (r[1], r[0]))[0]
        iteration += 1
        if not moving or iteration > max_iterations or change is not None and change < tolerance or worse >= patience:
            break
    best.history = history
    if with_posterior:
        from lumenfield.operators import resample

        best.posterior = resample.posterior(best, y if labeled is None else y.join(labeled.select("vertex").distinct(), "vertex", "left_semi"), with_posterior, seed, credible_level)
    if compute_extremality:
        from lumenfield.plans import pipelines

        best.extremality = pipelines.hop_extremality(best, extremality_share, max_hop)
    return best


#: The exponents that the choice of gamma tries.
GAMMAS = tuple(round(0.05 + 0.078 * t, 3) for t in range(26))


def gamma_scores(model: Fit, grid: tuple[float, ...] = GAMMAS) -> list[tuple[float, float]]:
    """(gamma, gcv): coherence modulation rebuilt for every gamma, so that scores can differ."""
    y = model.fitted.select("vertex", F.col("y_hat").alias("y"))
    out = []
    for gamma in grid:
        rho = spectral._checkpointed(measures.response_modulation(model.edge_rho, y, gamma))
        low = spectral.spectrum(spectral._checkpointed(measures.laplacian(model.vertex_rho, rho)), model.params["n_eigenpairs"])
        _, scores, _ = smooth(low, model.fitted.select("vertex", "y"), model.filter)
        out.append((float(gamma), float(min(s for _, s in scores))))
    return out


def smooth(low: spectral.Spectrum, y: DataFrame, filter: str, labeled: DataFrame | None = None, etas: list[float] | None = None):
    """(eta, [(eta, gcv)], fitted): the response through the filter with the least GCV, the first on ties."""
    etas = etas or eta_grid_fit(max(float(low.values[-1]), 1e-12), filter)
    if labeled is not None:
        return _semi(low, y, labeled, etas)
    m = len(low.values)
    row = spectral.coefficients(low.vectors, y, m).first()
    a = np.array(row.a)
    grid = spectral.filter_matrix(filter, low.values, etas)
    scores = spectral.gcv_scores(grid, a, row.yy, row.n)
    at = int(scores.argmin())
    weights = F.array(*map(F.lit, (grid[at] * a).tolist()))
    fitted = y.join(low.vectors, "vertex").select("vertex", "y", spectral.combine(weights, F.col("v")).alias("y_hat")).withColumn("residual", F.col("y") - F.col("y_hat"))
    return etas[at], list(zip(etas, scores.tolist())), fitted


def _semi(low: spectral.Spectrum, y: DataFrame, labeled: DataFrame, etas: list[float]):
    """Only labelled vertices teach; every vertex gets a fitted value, unlabelled residuals are null."""
    m = len(low.values)
    rows = y.join(labeled.select("vertex").distinct(), "vertex", "left_semi").join(low.vectors, "vertex")
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    got = rows.agg(*[F.sum(F.col("v")[i] * F.col("v")[j]) for i, j in pairs], *[F.sum(F.col("v")[i] * F.col("y")) for i in range(m)], F.sum(F.col("y") * F.col("y")), F.count("*")).first()
    gram = np.zeros((m, m))
    for (i, j), g in zip(pairs, got):
        gram[i, j] = gram[j, i] = g
    b, yy, n = np.array(got[len(pairs) : len(pairs) + m]), got[-2], got[-1]
    lam, best, scores = np.maximum(low.values, 0), None, []
    for eta in etas:
        system = gram + eta * np.diag(lam)
        system += np.sqrt(np.finfo(float).eps) * np.eye(m) * max(1.0, float(np.trace(system)) / m) * (np.linalg.cond(system) > 1e14)
        a = np.linalg.solve(system, b)
        rss = max(0.0, yy - 2 * a @ b + a @ gram @ a)
        score = rss / max(n - float(np.trace(np.linalg.solve(system, gram))), 1e-10) ** 2
        scores.append((eta, score))
        if best is None or score < best[0]:
            best = (score, eta, a)
    known = labeled.select("vertex", F.lit(True).alias("known")).distinct()
    fitted = y.join(low.vectors, "vertex").join(known, "vertex", "left")
    fitted = fitted.select("vertex", "y", spectral.combine(F.array(*map(F.lit, best[2].tolist())), F.col("v")).alias("y_hat"), "known")
    fitted = fitted.select("vertex", "y", "y_hat", F.when(F.col("known"), F.col("y") - F.col("y_hat")).alias("residual"))
    return best[1], scores, fitted


def refit(model: Fit, responses: DataFrame, per_column: bool = True, candidates: int = 40, labeled: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fitted, columns) for responses (vertex, col, y) through the cached spectrum.

    fitted: (vertex, col, y, y_hat, residual); columns: (col, eta, gcv, df). Two aggregations, whatever
    the number of responses; a column's weights travel back to its rows by an equi-join. With labelled
    vertices only these teach, at the model's eta: every vertex gets a value, the others' residuals are null.
    """
    low = model.spectrum
    m = len(low.values)
    if labeled is not None:
        return _refit_labeled(model, responses, labeled.select("vertex").distinct())
    best = _chosen(model, responses, per_column, candidates).withColumn("w", F.zip_with("f", "a", lambda a, b: a * b))
    fitted = responses.join(best.select("col", "w"), "col").join(low.vectors, "vertex")
    fitted = fitted.select("vertex", "col", "y", spectral.combine(F.col("w"), F.col("v")).alias("y_hat")).withColumn("residual", F.col("y") - F.col("y_hat"))
    return fitted, best.select("col", "eta", "gcv", F.aggregate("f", F.lit(0.0), lambda s, x: s + x).alias("df"))


def _chosen(model: Fit, responses: DataFrame, per_column: bool, candidates: int) -> DataFrame:
    """(col, a, yy, n, eta, gcv, f): each column's coefficients and filter."""
    low = model.spectrum
    coef = spectral.coefficients(low.vectors, responses, len(low.values), ["col"])
    if per_column:
        return spectral.gcv_by_column(coef, low.values, model.filter, eta_grid_refit(low.values.tolist(), candidates), ["col"])
    f = model.weights
    rss = F.greatest(F.col("yy") - F.aggregate(F.zip_with("a", F.array(*map(F.lit, (2 * f - f**2).tolist())), lambda x, c: x * x * c), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    return coef.select("col", "a", "yy", "n", F.lit(model.eta).alias("eta"), (rss / F.pow(F.greatest(F.col("n") - float(f.sum()), F.lit(1e-10)), 2)).alias("gcv"), F.array(*map(F.lit, f.tolist())).alias("f"))


def _refit_labeled(model: Fit, responses: DataFrame, labeled: DataFrame) -> tuple[DataFrame, DataFrame]:
    low = model.spectrum
    m = len(low.values)
    known = labeled.join(low.vectors, "vertex")
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    got = known.agg(*[F.sum(F.col("v")[i] * F.col("v")[j]) for i, j in pairs]).first()
    gram = np.zeros((m, m))
    for (i, j), g in zip(pairs, got):
        gram[i, j] = gram[j, i] = g
    system = gram + model.eta * np.diag(np.maximum(low.values, 0))
    if np.linalg.cond(system) > 1e14:
        system += np.sqrt(np.finfo(float).eps) * np.eye(m)
    inverse = np.linalg.inv(system)
    table = F.array(*[F.array(*map(F.lit, row.tolist())) for row in inverse])
    coef = spectral.coefficients(low.vectors, responses.join(labeled, "vertex", "left_semi"), m, ["col"])
    w = coef.select("col", F.transform(table, lambda row: spectral.combine(row, F.col("a"))).alias("w"))
    fitted = responses.join(w, "col").join(low.vectors, "vertex").join(labeled.withColumn("known", F.lit(True)), "vertex", "left")
    fitted = fitted.select("vertex", "col", "y", spectral.combine(F.col("w"), F.col("v")).alias("y_hat"), "known")
    fitted = fitted.select("vertex", "col", "y", "y_hat", F.when(F.col("known"), F.col("y") - F.col("y_hat")).alias("residual"))
    df = float(np.trace(inverse @ gram))
    return fitted, w.select("col", F.lit(float(model.eta)).alias("eta"), F.lit(None).cast("double").alias("gcv"), F.lit(df).alias("df"))


def refit_samples(model: Fit, responses: DataFrame, b: int = 200, seed: int = 1, per_column: bool = True, candidates: int = 40) -> DataFrame:
    """(vertex, col, y, y_hat, s): b posterior samples of each fitted value, as an array.

    Modes are normal around f V'y with variance s^2 / (1 + eta lambda), s^2 the residual sum over n minus the degrees
    of freedom; normal numbers come from hashes of seed, column, draw and mode. A column without degrees of
    freedom has no samples. Draws of modes travel with their column; no row is multiplied by their number.
    """
    low = model.spectrum
    lam = np.maximum(low.values, 0)
    best = _chosen(model, responses, per_column, candidates)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    rss = F.greatest(F.col("yy") - total(F.zip_with("f", "a", lambda f, a: (2 * f - f * f) * a * a)), F.lit(0.0))
    room = F.col("n") - total("f")
    best = best.withColumn("sigma", F.when(room >= 1, F.sqrt(rss / room))).withColumn("mean", F.zip_with("f", "a", lambda f, a: f * a))
    lams = F.array(*map(F.lit, lam.tolist()))
    u = lambda d, k, part: uniform(F.lit(seed), F.col("col"), d, k, F.lit(part))
    normal = lambda d, k: F.sqrt(-2 * F.log(1 - u(d, k, "r"))) * F.cos(2 * math.pi * u(d, k, "a"))
    draw = lambda d: F.transform("mean", lambda mu, k: mu + F.col("sigma") / F.sqrt(1 + F.col("eta") * lams[k]) * normal(d, k))
    w = best.select("col", "mean", F.when(F.col("sigma").isNotNull(), F.transform(F.sequence(F.lit(1), F.lit(b)), draw)).alias("w"))
    rows = responses.join(spectral._checkpointed(w), "col").join(low.vectors, "vertex")
    return rows.select("vertex", "col", "y", spectral.combine(F.col("mean"), F.col("v")).alias("y_hat"), F.transform("w", lambda x: spectral.combine(x, F.col("v"))).alias("s"))


def credible(samples: DataFrame, level: float = 0.95) -> DataFrame:
    """(vertex, col, lower, upper, sd) of samples (vertex, col, s): sorted draws at floor(tail (b - 1))."""
    tail = (1 - level) / 2
    b = F.size("s")
    at = lambda q: F.get(F.array_sort("s"), F.floor(q * (b - 1)).cast("int"))
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / b
    var = F.aggregate(F.transform("s", lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / (b - 1)
    return samples.select("vertex", "col", at(tail).alias("lower"), at(1 - tail).alias("upper"), F.sqrt(var).alias("sd"))


def summary(fitted: DataFrame, k: int | None = None) -> DataFrame:
    """One row: r2, rmse, mae, n, sigma, and with k the r2 adjusted for it."""
    r = F.col("y") - F.col("y_hat")
    mean = fitted.agg(F.avg("y")).scalar()
    total = F.sum(F.pow(F.col("y") - mean, 2))
    r2 = 1 - F.sum(r * r) / total
    adjusted = [(1 - (1 - r2) * (F.count("*") - 1) / (F.count("*") - k - 1)).alias("adj_r_squared")] if k is not None else []
    return fitted.agg(r2.alias("r_squared"), *adjusted, F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"), F.count("*").alias("n"), F.stddev_samp(r).alias("sigma"))


def report(model: Fit) -> DataFrame:
    """One row: the fit's summary, its graph's size and density, and how GCV went over the iterations."""
    s = summary(model.fitted, model.params["k"])
    n, edges = model.vertices.count(), model.edges.count()
    scores = [h["gcv"] for h in model.history]
    best = min(scores)
    facts = {"n_edges": edges, "average_degree": 2 * edges / n, "graph_density": edges / (n * (n - 1) / 2) if n > 1 else None, "n_iterations": len(scores), "optimal_iteration": scores.index(best) + 1, "gcv_initial": scores[0], "gcv_optimal": best, "gcv_gain_percent": (scores[0] - best) / scores[0] * 100 if scores[0] else None, "final_change": model.history[-1]["change"], "gamma": float(model.params["gamma"])}
    return s.withColumns({c: F.lit(v) for c, v in facts.items()})


def refit_summary(fitted: DataFrame) -> DataFrame:
    """(col, n, rmse, mae, max_abs) of refitted responses; null residuals do not count."""
    r = F.col("residual")
    return fitted.where("residual is not null").groupBy("col").agg(F.count("*").alias("n"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"), F.max(F.abs(r)).alias("max_abs"))


def smoothed_density(model: Fit) -> DataFrame:
    """(vertex, density): one over the shortest edge, smoothed through the model, scaled to [0, 1]."""
    raw = measures.least_length_density(model.vertices, model.edges).withColumn("col", F.lit("density"))
    fitted, _ = refit(model, raw, per_column=False)
    return measures.unit_scaled(fitted.select("vertex", F.col("y_hat").alias("density")), "density")
