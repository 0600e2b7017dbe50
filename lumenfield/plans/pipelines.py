"""Compound plans: sweeps over k and p, diagnostics, paired tests, and small selections."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenfield.functions.columns import box_cox, eta_grid_fit, power, uniform
from lumenfield.functions import orders
from lumenfield.functions.orders import winsorize
from lumenfield.operators import bits, extrema, graph, measures, resample, spectral
from lumenfield.operators import metrics
from lumenfield.operators.metrics import pca
from lumenfield.plans import fit as plans
from lumenfield.sources import tables


def k_sweep_edges(neighbours: DataFrame, ks: list[int]) -> DataFrame:
    """(k, i, j, isize, length): the graph of every k from one neighbour table; k others and the vertex itself."""
    near = neighbours.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "vertex", "rank", "nbr", "dist").where("rank <= k")
    return graph.shared(near.select("k", "vertex", "nbr", "dist"), ["k"])


def select_k(rows: DataFrame, wanted: int | None = None, candidates: list[int] | None = None) -> DataFrame:
    """One row (k): the wanted one or its nearest, else the first candidate there is, else the first
    connected, else that with the largest share in its largest component, else the first."""
    if wanted is not None:
        return nearest(rows, "k", wanted).select("k")
    options = [F.max(F.when(F.col("k") == c, c)) for c in candidates or []]
    share = F.max_by("k", F.struct("lcc_frac", -F.col("k"))) if "lcc_frac" in rows.columns else F.lit(None).cast("long")
    return rows.agg(F.coalesce(*options, F.min(F.when(F.col("n_ccomp") == 1, F.col("k"))), share, F.min("k")).alias("k"))


def connected_tail(rows: DataFrame) -> DataFrame:
    """One row (k_cc): the smallest k from which every graph is connected; null if the last is not."""
    last = rows.agg(F.max(F.when(F.col("n_ccomp") > 1, F.col("k")))).scalar()
    return rows.agg(F.min(F.when(F.col("k") > F.coalesce(last, F.lit(-1)), F.col("k"))).alias("k_cc"))


def nearest(rows: DataFrame, key: str, wanted: float) -> DataFrame:
    """The row whose key is nearest, the smaller on ties."""
    return rows.orderBy(F.abs(F.col(key) - wanted), key).limit(1)


def box_cox_grid(rows: DataFrame, value: str, grid: list[float]) -> DataFrame:
    """(lambda, loglik) of an intercept-only model: all grid points in one aggregation."""
    sums = []
    for k, lam in enumerate(grid):
        sums.append(F.var_pop(box_cox(F.col(value), lam)).alias(f"v{k}"))
    one = rows.agg(F.count("*").alias("n"), F.sum(F.log(value)).alias("sl"), *sums)
    pairs = F.explode(F.array(*[F.struct(F.lit(lam).alias("lambda"), F.col(f"v{k}").alias("v")) for k, lam in enumerate(grid)])).alias("e")
    return one.select("n", "sl", pairs).select(F.col("e.lambda").alias("lambda"), (-F.col("n") / 2 * F.log("e.v") + (F.col("e.lambda") - 1) * F.col("sl")).alias("loglik"))


def box_cox_mle(rows: DataFrame, value: str) -> float:
    """Grid from -2 to 2 by 0.1, then golden sections around the best; each look is one aggregation."""
    grid = [t / 10 for t in range(-20, 21)]
    best = max(box_cox_grid(rows, value, grid).collect(), key=lambda r: r.loglik)["lambda"]
    look = lambda x: box_cox_grid(rows, value, [x]).first().loglik
    lo, hi, g = best - 0.1, best + 0.1, (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = look(a), look(b)
    while hi - lo > 1e-4:
        if fa > fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = look(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = look(b)
    return (lo + hi) / 2


def break_ties(y: DataFrame, scale: float = 1e-10, seed: int = 123) -> DataFrame:
    """(vertex, y): distinct values by hashed noise within tied groups.

    In the lowest and highest group the first member keeps its value and the noise is one-sided; in
    others it is centred. Groups are found by an aggregation and joined back.
    """
    lo, hi = y.agg(F.min("y"), F.max("y")).first()
    groups = y.groupBy("y").agg(F.count("*").alias("n"), F.min("vertex").alias("head"), F.avg(uniform(F.lit(seed), F.col("vertex"))).alias("mean")).where("n > 1")
    rows = y.join(groups, "y", "left")
    u = uniform(F.lit(seed), F.col("vertex"))
    size = scale * max(1.0, (hi - lo) if hi is not None else 1.0)
    noise = F.when(F.col("n").isNull(), 0.0).when((F.col("y") == lo) & (F.col("vertex") == F.col("head")), 0.0).when(F.col("y") == lo, size * (u + 0.5)).when((F.col("y") == hi) & (F.col("vertex") == F.col("head")), 0.0).when(F.col("y") == hi, -size * (u + 0.5)).otherwise(size * (u - F.col("mean")))
    return rows.select("vertex", (F.col("y") + noise).alias("y"))


def robust_z(rows: DataFrame, by: str, value: str, least: int = 5) -> DataFrame:
    """rows with z: distance from the group's median in units of 1.4826 MAD; groups without spread go."""
    med = orders.by_group(rows, by, value, 0.5, "_m").join(rows.groupBy(by).agg(F.count("*").alias("_c")), by)
    near = rows.join(med.where(F.col("_c") >= least), by).withColumn("_a", F.abs(F.col(value) - F.col("_m")))
    mad = orders.by_group(near, by, "_a", 0.5, "_d").select(by, (1.4826 * F.col("_d")).alias("_d")).where("_d > 0")
    return near.join(mad, by).withColumn("z", (F.col(value) - F.col("_m")) / F.col("_d")).drop("_m", "_c", "_d", "_a")


def gamma_select(model: plans.Fit, grid: list[float] | None = None) -> DataFrame:
    """(gamma, gcv): coherence modulation rebuilt for every gamma, of the whole grid unless told otherwise."""
    return model.vertices.sparkSession.createDataFrame(plans.gamma_scores(model, tuple(grid or plans.GAMMAS)), "gamma double, gcv double")


def pextrema(model: plans.Fit, share: float = 0.9, degree: float = 0.1, p: float = 0.9, max_hop: int = 30) -> DataFrame:
    """(vertex, type, value, share, radius, label): local extrema whose share of neighbours beyond them and
    effective degree reach the quantiles; numbered by value."""
    y = model.fitted.select("vertex", F.col("y_hat").alias("y"))
    s = extrema.extremp(y, model.edges, model.vertex_rho).join(measures.effective_degree(model.edge_rho), "vertex").join(y, "vertex")
    s = spectral._checkpointed(s)
    least = F.lit(orders.quantiles(s, "effective_degree", [degree])[0])
    out = None
    for kind, col, maxima in (("max", "maxp", True), ("min", "minp", False)):
        cut = F.lit(orders.quantiles(s, col, [share])[0])
        found = s.where((F.col(col) >= cut) & (F.col("effective_degree") >= least)).select("vertex", F.lit(kind).alias("type"), F.col("y").alias("value"), F.col(col).alias("share"))
        found = found.join(extrema.hop_radius(y, model.edges, model.vertex_rho, p, max_hop, maxima), "vertex")
        found = graph.numbered(found.withColumn("_o", F.col("value") * (-1 if maxima else 1)), ["_o", "vertex"], "_r")
        found = found.withColumn("label", F.concat(F.lit("M" if maxima else "m"), F.col("_r"))).drop("_o", "_r")
        out = found if out is None else out.unionByName(found)
    return out


def hop_extremality(model: plans.Fit, p: float = 0.9, max_hop: int = 30) -> DataFrame:
    """(vertex, score, radius, size): hops over which the set around a vertex stays extreme with its sign.

    A set's score compares the mass-weighted values of the members with those just outside. Sets grow together, 64 sources to a
    word of bits: a row for each vertex and word that a set has reached.
    """
    y = model.fitted.select("vertex", F.col("y_hat").alias("y"))
    scores = spectral._checkpointed(extrema.extremality(y, model.vertex_rho, model.edge_rho))
    f = spectral._checkpointed(y.join(model.vertex_rho, "vertex").select("vertex", (F.col("rho") * F.col("y")).alias("m")))
    lo, hi = y.agg(F.min("y"), F.max("y")).first()
    d = graph.directed(model.edges).join(f, "vertex").join(f.select(F.col("vertex").alias("nbr"), F.col("m").alias("mn")), "nbr")
    d = spectral._checkpointed(d.select("vertex", "nbr", (F.col("m") - F.col("mn")).alias("change")))
    source = bits.placed(scores.where(F.abs("score") >= p).select(F.col("vertex").alias("source"), F.signum("score").alias("sign")))
    inside = bits.started(source)
    radius = source.select("source", "word", "bit", F.lit(0).alias("radius"), F.lit(1).cast("long").alias("size"))
    alive = source
    for hop in range(1, max_hop + 1):
        there = inside.select(F.col("vertex").alias("nbr"), "word", F.col("bits").alias("held"))
        out = inside.join(d, "vertex").join(there, ["nbr", "word"], "left")
        out = spectral._checkpointed(out.select("word", "nbr", "change", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("held", F.lit(0).cast("long")))).alias("bits")).where("bits != 0"))
        change = bits.sums(out, {"s": F.col("change"), "a": F.abs("change")})
        state = change.join(alive, ["word", "bit"]).where((F.col("a") > 1e-15) & (F.abs(F.col("s") / F.col("a")) >= p) & (F.signum("s") == F.col("sign")))
        alive = spectral._checkpointed(state.select("source", "word", "bit", "sign"))
        if alive.isEmpty():
            break
        mask = bits.masks(alive)
        grown = out.select(F.col("nbr").alias("vertex"), "word", "bits").unionByName(inside).join(mask, "word").select("vertex", "word", F.col("bits").bitwiseAND(F.col("mask")).alias("bits"))
        inside = spectral._checkpointed(grown.where("bits != 0").groupBy("vertex", "word").agg(F.bit_or("bits").alias("bits")))
        sizes = bits.sums(inside, {"n": F.lit(1.0)}).join(alive.select("word", "bit"), ["word", "bit"])
        radius = radius.join(sizes, ["word", "bit"], "left")
        radius = spectral._checkpointed(radius.select("source", "word", "bit", F.when(F.col("n").isNotNull(), hop).otherwise(F.col("radius")).alias("radius"), F.coalesce(F.col("n").cast("long"), "size").alias("size")))
    out = scores.join(y, "vertex").join(radius.select(F.col("source").alias("vertex"), "radius", "size"), "vertex", "left")
    best = (F.col("y") == lo) | (F.col("y") == hi)
    return out.select("vertex", "score", F.when(best, -1).otherwise(F.coalesce("radius", F.lit(0))).alias("radius"), F.coalesce("size", F.lit(0)).alias("size"))


def k_diagnostics(points: DataFrame, y: DataFrame, ks: list[int]) -> DataFrame:
    """(k, gcv, range_lower, range_upper, stability_corr, n_extrema, is_optimal): one fit for each k."""
    near = spectral._checkpointed(graph.knn(points, max(ks) + 1))
    every = spectral._checkpointed(k_sweep_edges(near, ks))
    mean = y.agg(F.avg("y")).first()[0]
    rows, last = [], None
    for k in sorted(ks):
        model = plans.fit(None, y, k, edges=every.where(F.col("k") == k).drop("k"), check_connected=False)
        hat = spectral._checkpointed(model.fitted.select("vertex", F.col("y_hat").alias("y")))
        lo, hi = winsorize(hat, "y", 0.02, "w").agg(F.min("w"), F.max("w")).first()
        corr = hat.join(last.withColumnRenamed("y", "old"), "vertex").agg(F.corr("y", "old")).first()[0] if last is not None else None
        n = extrema.local_extrema(hat, model.edges).count()
        rows.append((k, float(min(s for _, s in model.gcv)), lo / mean, hi / mean, corr, n))
        last = hat
    best = min(r[1] for r in rows)
    out = [(*r, r[1] == best) for r in rows]
    return points.sparkSession.createDataFrame(out, "k int, gcv double, range_lower double, range_upper double, stability_corr double, n_extrema long, is_optimal boolean")


def cluster_pvalues(model: plans.Fit, y: DataFrame, b: int = 19, seed: int = 1, level: float = 0.95) -> DataFrame:
    """One row (threshold, max_size, p_size, max_mass, p_mass): clusters of large distances from the mean
    against those of permuted responses; the threshold is a quantile of all permuted distances."""
    n, mean = y.agg(F.count("*"), F.avg("y")).first()
    fitted, _ = plans.refit(model, resample.permuted(y, b, seed))
    stat = spectral._checkpointed(fitted.select("vertex", "col", F.abs(F.col("y_hat") - mean).alias("stat")))
    cut = orders.quantiles(stat, "stat", [level])[0]
    own = model.fitted.select("vertex", F.lit(0).alias("col"), F.abs(F.col("y_hat") - mean).alias("stat"))
    # draws are kept apart by pairing them with vertices into one number, so one search serves all
    both = stat.unionByName(own).where(F.col("stat") >= cut).select((F.col("col") * F.lit(1 << 40) + F.col("vertex")).alias("vertex"), "col", "stat")
    both = spectral._checkpointed(both)
    base = F.explode(F.sequence(F.lit(0), F.lit(b))).alias("col")
    edges = model.edges.select(base, "i", "j").select((F.col("col") * F.lit(1 << 40) + F.col("i")).alias("i"), (F.col("col") * F.lit(1 << 40) + F.col("j")).alias("j"))
    inside = edges.join(both.select(F.col("vertex").alias("i")), "i", "left_semi").join(both.select(F.col("vertex").alias("j")), "j", "left_semi")
    per = graph.components(both.select("vertex"), inside).join(both, "vertex").groupBy("col", "component").agg(F.count("*").alias("n"), F.sum("stat").alias("mass"))
    top = per.groupBy("col").agg(F.max("n").alias("n"), F.max("mass").alias("mass"))
    size, mass = (F.coalesce(F.max(F.when(F.col("col") == 0, F.col(c))), F.lit(0.0)) for c in ("n", "mass"))
    seen = top.agg(size.alias("n"), mass.alias("mass")).first()
    draws = top.where("col > 0")
    return draws.agg(
        F.lit(cut).alias("threshold"), F.lit(float(seen.n)).alias("max_size"), ((1 + F.count_if(F.col("n") >= seen.n)) / (b + 1)).alias("p_size"),
        F.lit(float(seen.mass)).alias("max_mass"), ((1 + F.count_if(F.col("mass") >= seen.mass)) / (b + 1)).alias("p_mass"),
    )


#: Components of at most so many vertices have their spectra in a task, many components at once; larger ones are fitted one by one.
DENSE_COMPONENT = 2048
#: Rows of operators that a task is dealt at about.
DEALT_ENTRIES = 200_000


def componentwise_fit(points: DataFrame, y: DataFrame, k: int, least: int = 10, n_eigenpairs: int = 10, filter: str = "heat_kernel") -> DataFrame:
    """(vertex, component, y, y_hat): a fit on every component of at least ``least`` vertices; others keep their mean.

    Sets, densities and operators of all components are made at once, scaled within each, and the blocks of the block-diagonal
    operator are dealt to tasks that find spectra, filters and fits of many; the number of jobs does not depend on the components.
    """
    _, edges = plans.neighbourhood(points, k)
    vertices = points.select("vertex")
    labels = spectral._checkpointed(graph.components(vertices, edges))
    sizes = labels.groupBy("component").count()
    out = spectral._checkpointed(labels.join(y, "vertex").join(sizes, "component"))
    small = out.where(F.col("count") < least)
    done = small.join(small.groupBy("component").agg(F.avg("y").alias("y_hat")), "component").select("vertex", "component", "y", "y_hat")
    large = out.where(F.col("count") >= least)
    kept = large.select("vertex", "component", "count")
    inside = edges.join(kept.select(F.col("vertex").alias("i"), "component"), "i")
    sets = spectral._checkpointed(graph.neighbour_sets(kept, inside, k + 1))
    raw = sets.groupBy("vertex").agg(F.count("*").cast("double").alias("raw")).join(kept.select("vertex", "component"), "vertex")
    vertex_rho = spectral._checkpointed(measures.normalised_by(raw, "component", "raw").select("vertex", "rho"))
    mass = graph.intersection(inside.select("i", "j"), sets).join(inside.select("i", "j", "component"), ["i", "j"])
    edge_rho = spectral._checkpointed(measures.normalised_by(mass, "component", "mass").select("i", "j", "rho"))
    lap = measures.laplacian(vertex_rho, edge_rho).join(kept.select(F.col("vertex").alias("i"), "component", "count"), "i")
    lap = spectral._checkpointed(lap)
    bins = max(1, -(-lap.count() // DEALT_ENTRIES))
    # the response travels as entries without a second vertex
    rows = lap.select("component", "count", "i", "j", "val").unionByName(large.select("component", "count", F.col("vertex").alias("i"), F.lit(None).cast("long").alias("j"), F.col("y").cast("double").alias("val")))
    rows = rows.where(F.col("count") <= DENSE_COMPONENT).withColumn("bin", F.pmod(F.xxhash64("component"), F.lit(bins)).cast("int"))

    filters, scores = spectral.filter_matrix, spectral.gcv_scores

    def run(table: pa.Table) -> pa.Table:
        component, i, val = (table.column(c).to_numpy() for c in ("component", "i", "val"))
        j = table.column("j").to_numpy(zero_copy_only=False).astype(float)
        order = np.argsort(component, kind="stable")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in np.split(order, np.flatnonzero(np.diff(component[order])) + 1) if len(order) else ():
            own = at[np.isnan(j[at])]
            own = own[np.argsort(i[own])]
            ids, entries = i[own], at[~np.isnan(j[at])]
            a = np.zeros((len(ids), len(ids)))
            a[np.searchsorted(ids, i[entries]), np.searchsorted(ids, j[entries].astype(np.int64))] = val[entries]
            values, vectors = np.linalg.eigh((a + a.T) / 2)
            m = min(n_eigenpairs, len(ids))
            values, vectors, response = values[:m], vectors[:, :m], val[own]
            coef = vectors.T @ response
            grid = filters(filter, values, eta_grid_fit(max(float(values[-1]), 1e-12), filter))
            best = grid[int(scores(grid, coef, float(response @ response), len(ids)).argmin())]
            found.append((ids, vectors @ (best * coef)))
        ids, hat = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"vertex": ids, "y_hat": hat})

    fitted = rows.groupBy("bin").applyInArrow(run, "vertex long, y_hat double")
    done = done.unionByName(large.join(fitted, "vertex").select("vertex", "component", "y", "y_hat"))
    # at most one component in DENSE_COMPONENT vertices is as large
    for r in sizes.where(F.col("count") > max(DENSE_COMPONENT, least - 1)).orderBy("component").toLocalIterator():
        low = spectral.spectrum(spectral._checkpointed(lap.where(F.col("component") == r.component).select("i", "j", "val")), n_eigenpairs)
        own = large.where(F.col("component") == r.component)
        hat = plans.smooth(low, own.select("vertex", "y"), filter)[2]
        done = done.unionByName(hat.select("vertex", F.lit(r.component).alias("component"), "y", "y_hat"))
    return done


def data_smoother(points: DataFrame, k_min: int, k_max: int, n_eigenpairs: int = 50, proxy: str = "pc1") -> tuple[DataFrame, int]:
    """(fitted(vertex, col, y, y_hat, residual), k): features smoothed over the graph whose k smooths a proxy best.

    Only k of the connected tail compete; if none is connected, the largest component of the largest k stays.
    """
    near = spectral._checkpointed(graph.knn(points, k_max + 1))
    ks = list(range(k_min, k_max + 1))
    every = spectral._checkpointed(k_sweep_edges(near, ks))
    labels = {k: spectral._checkpointed(graph.components(points.select("vertex"), every.where(F.col("k") == k))) for k in ks}
    parts = {k: labels[k].select("component").distinct().count() for k in ks}
    tail = [k for k in ks if all(parts[j] == 1 for j in ks if j >= k)]
    keep = points
    if not tail:
        tail = ks[-1:]
        big = graph.largest_component(labels[ks[-1]])
        keep = points.join(big, "vertex", "left_semi")
        every = every.join(big.withColumnRenamed("vertex", "i"), "i", "left_semi").join(big.withColumnRenamed("vertex", "j"), "j", "left_semi")
    keep = spectral._checkpointed(keep)
    if proxy == "pc1":
        y = pca(keep, 0.0, 1)[0].select("vertex", F.col("x")[0].alias("y"))
    else:
        long = keep.select("vertex", F.posexplode("x").alias("col", "y"))
        widest = long.groupBy("col").agg(F.var_samp("y").alias("v")).orderBy(F.desc("v"), "col").first().col
        y = keep.select("vertex", F.col("x")[widest].alias("y"))
    models = {k: plans.fit(None, y, k, n_eigenpairs, edges=every.where(F.col("k") == k).drop("k"), check_connected=False) for k in tail}
    best = min(tail, key=lambda k: (min(s for _, s in models[k].gcv), k))
    responses = keep.select("vertex", F.posexplode("x").alias("col", "y"))
    return plans.refit(models[best], responses)[0], best


def lp_graphs(points: DataFrame, y: DataFrame, ps: list[float], ks: list[int], l1: bool = False) -> DataFrame:
    """(p, k, n_ccomp, status, gcv, r_squared): power transforms of non-negative features, a graph and a fit for each."""
    if not points.where(F.exists("x", lambda v: v < 0)).isEmpty():
        raise ValueError("the power transform needs non-negative features")
    rows = []
    for p in ps:
        x = power(F.col("x"), p)
        if l1:
            x = F.transform(x, lambda v: v / F.aggregate(power(F.col("x"), p), F.lit(0.0), lambda a, b: a + b))
        moved = spectral._checkpointed(points.select("vertex", x.alias("x")))
        if moved.groupBy("x").count().where("count > 1").isEmpty() is False:
            rows += [(p, k, None, "duplicate_rows", None, None) for k in ks]
            continue
        every = spectral._checkpointed(k_sweep_edges(graph.knn(moved, max(ks) + 1), ks))
        for k in ks:
            edges = every.where(F.col("k") == k).drop("k")
            n = graph.components(moved.select("vertex"), edges).select("component").distinct().count()
            if n > 1:
                rows.append((p, k, n, "skipped", None, None))
                continue
            model = plans.fit(None, y, k, edges=edges, check_connected=False)
            s = plans.summary(model.fitted).first()
            rows.append((p, k, n, "success", float(min(v for _, v in model.gcv)), s.r_squared))
    return points.sparkSession.createDataFrame(rows, "p double, k int, n_ccomp long, status string, gcv double, r_squared double")


def lp_summary(rows: DataFrame) -> DataFrame:
    """(p, opt_k, gcv, n_connected_k): the best successful fit of each p, and for how many k there was one."""
    ok = rows.where("status = 'success'").groupBy("p")
    return ok.agg(F.min_by("k", F.struct("gcv", "k")).alias("opt_k"), F.min("gcv").alias("gcv"), F.count("*").alias("n_connected_k"))


def lslope_summary(rows: DataFrame) -> DataFrame:
    """One row: vertices tested and significant at three levels, quartiles of p values and effects."""
    shares = (0.25, 0.5, 0.75)
    quartiles = [F.lit(v).cast("double").alias(f"{c}_q{int(100 * q)}") for c in ("p_value", "p_adjusted", "effect") for q, v in zip(shares, orders.quantiles(rows, c, list(shares)))]
    return rows.agg(F.count("p_value").alias("n_tested"), *[F.count_if(F.col("p_adjusted") < a).alias(f"n_{str(a)[2:]}") for a in (0.05, 0.01, 0.001)]).select("*", *quartiles)


def dealt_folds(vertices: DataFrame, folds: int, seed: int = 1) -> DataFrame:
    """(vertex, fold from 0)."""
    return vertices.select("vertex", F.floor(folds * uniform(F.lit(seed), F.col("vertex"))).cast("int").alias("fold"))


def cross_validate(model: plans.Fit, responses: DataFrame, folds: int = 5, seed: int = 1) -> DataFrame:
    """(fold, scaled_mse, raw_mse, n_test): each fold of the vertices is predicted by a masked refit without it.

    Folds are dealt by a hash of seed and vertex. Errors are scaled by the columns' scales on the training vertices.
    """
    dealt = spectral._checkpointed(dealt_folds(model.vertices, folds, seed))
    out = None
    for fold in range(folds):
        train = dealt.where(F.col("fold") != fold)
        fitted, _ = plans.refit(model, responses, labeled=train)
        scale = metrics.column_scales(responses.join(train, "vertex", "left_semi"), "col", "y")
        test = fitted.join(dealt.where(F.col("fold") == fold).select("vertex"), "vertex", "left_semi").join(scale, "col")
        r = F.col("y") - F.col("y_hat")
        row = test.agg(F.lit(fold).alias("fold"), F.avg(F.pow(r / F.col("scale"), 2)).alias("scaled_mse"), F.avg(r * r).alias("raw_mse"), F.count_distinct("vertex").alias("n_test"))
        out = row if out is None else out.unionByName(row)
    return out


def optimal_p(rows: DataFrame, wanted: float | None = None) -> DataFrame:
    """The successful row of the wanted p's nearest grid value, else that of the least score."""
    ok = rows.where("status = 'success'")
    return nearest(ok, "p", wanted) if wanted is not None else ok.orderBy("gcv", "p", "k").limit(1)


def equivalent_range(curve: DataFrame) -> DataFrame:
    """One row (best, low, high) of a fitted curve (x, fit, lower, upper): the x of its least value, the first on ties, and the
    range of x whose lower bounds do not exceed the upper bound there."""
    best = curve.agg(F.min_by(F.struct("x", "upper"), F.struct("fit", "x")).alias("b")).select("b.x", "b.upper").first()
    if best is None or best.x is None:
        return curve.select(F.lit(None).cast("double").alias("best"), F.col("x").alias("low"), F.col("x").alias("high")).limit(0)
    return curve.where(F.col("lower") <= best.upper).agg(F.lit(best.x).alias("best"), F.min("x").alias("low"), F.max("x").alias("high"))


def lp_round_trip(points: DataFrame, ps: list[float], wanted: list[float]) -> DataFrame:
    """Transforms written by p, then only the wanted partitions read."""
    spark = points.sparkSession
    path = f"{tables.shared_folder(spark)}/lp-{uuid.uuid4().hex}"
    out = None
    for p in ps:
        part = points.select("vertex", F.lit(p).alias("p"), F.aggregate(power(F.col("x"), p), F.lit(0.0), lambda a, b: a + b).alias("total"))
        out = part if out is None else out.unionByName(part)
    tables.lp_save(out, path)
    return tables.lp_load(spark, path, wanted)


def iknn_response(points: DataFrame, y: DataFrame, ks: list[int], wanted: int | None = None) -> DataFrame:
    """(vertex, k, component, y, y_hat): graphs for every k, one chosen; fitted only if it is connected."""
    every = spectral._checkpointed(k_sweep_edges(graph.knn(points, max(ks) + 1), ks))
    labels = {k: spectral._checkpointed(graph.components(points.select("vertex"), every.where(F.col("k") == k))) for k in ks}
    n = points.count()
    spark = points.sparkSession
    info = [(k, labels[k].select("component").distinct().count(), labels[k].groupBy("component").count().agg(F.max("count")).first()[0] / n) for k in ks]
    k = select_k(spark.createDataFrame(info, "k int, n_ccomp long, lcc_frac double"), wanted).first().k
    if dict((i[0], i[1]) for i in info)[k] > 1:
        return labels[k].join(y, "vertex").select("vertex", F.lit(k).alias("k"), "component", "y", F.lit(None).cast("double").alias("y_hat"))
    model = plans.fit(None, y, k, edges=every.where(F.col("k") == k).drop("k"), check_connected=False)
    return model.fitted.join(labels[k], "vertex").select("vertex", F.lit(k).alias("k"), "component", "y", "y_hat")


