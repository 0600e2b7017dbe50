"""Draws through a fitted spectrum: permutations, Bayesian bootstrap, posterior samples."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lumenfield.functions.columns import clip_open, uniform
from lumenfield.plans.fit import Fit, refit

from . import spectral
from .extrema import bh_adjust


def draw_index(b: int, spark) -> DataFrame:
    return spark.range(1, b + 1).select(F.col("id").cast("int").alias("b"))


def permuted(y: DataFrame, b: int, seed: int = 1, subjects: DataFrame | None = None) -> DataFrame:
    """(vertex, col, y): b permutations of the response, by vertex or by whole subjects.

    Units are ranked by a hash of seed, draw and unit; the unit of rank r gets the value of the r-th
    unit by name. With subjects y must be constant in each.
    """
    spark = y.sparkSession
    if subjects is None:
        units = y.select(F.col("vertex").alias("unit"), "y")
    else:
        per = y.join(subjects, "vertex").groupBy(F.col("subject").alias("unit")).agg(F.min("y").alias("y"), F.max("y").alias("hi"))
        if not per.where("y != hi").isEmpty():
            raise ValueError("the response must be constant within a subject")
        units = per.drop("hi")
    from .graph import numbered

    ranked = numbered(units, ["unit"], "r")
    n = units.count()
    draws = units.select("unit").crossJoin(F.broadcast(draw_index(b, spark))).withColumn("u", uniform(F.lit(seed), F.col("b"), F.col("unit")))
    # one range sort numbers all draws, so that no task holds a whole one
    draws = numbered(draws, ["b", "u", "unit"], "r").withColumn("r", F.col("r") - (F.col("b") - 1) * n).join(ranked.select("r", "y"), "r")
    draws = draws.select("unit", F.col("b").alias("col"), "y")
    if subjects is None:
        return draws.withColumnRenamed("unit", "vertex")
    return subjects.join(draws, subjects.subject == draws.unit).select("vertex", "col", "y")


STATISTICS = ("l2", "l1", "lp", "max", "log", "logit")


def global_statistics(fitted: DataFrame, mean: float, n: int, by: list[str], exponent: float = 2.0) -> DataFrame:
    """Distances of fitted values from the mean response, for each draw: sums of squares, of absolute values and of their
    powers, the largest, and sums of squares on the scales of logarithms and logits."""
    d = F.abs(F.col("y_hat") - mean)
    p, q = clip_open(F.col("y_hat"), n), clip_open(F.lit(mean), n)
    log = F.log(p) - F.log(q)
    logit = F.log(p / (1 - p)) - F.log(q / (1 - q))
    sums = {"l2": F.sum(d * d), "l1": F.sum(d), "lp": F.sum(F.pow(d, F.lit(float(exponent)))), "max": F.max(d), "log": F.sum(log * log), "logit": F.sum(logit * logit)}
    return fitted.groupBy(*by).agg(*[v.alias(k) for k, v in sums.items()])


def p_values(own: DataFrame, draws: DataFrame, mean: float, b: int, two_sided: bool = True) -> DataFrame:
    """(vertex, p_value): share of the draws (vertex, col, y_hat) at least as far from the mean as own (vertex, y_hat), or at least as high."""
    far = draws.join(own.select("vertex", F.col("y_hat").alias("own")), "vertex")
    size = (lambda c: F.abs(F.col(c) - mean)) if two_sided else (lambda c: F.col(c))
    return far.groupBy("vertex").agg(((1 + F.count_if(size("y_hat") >= size("own"))) / (b + 1)).alias("p_value"))


def permutation_test(
    model: Fit, y: DataFrame, b: int = 99, seed: int = 1, subjects: DataFrame | None = None, per_column: bool = True, two_sided: bool = True, exponent: float = 2.0
) -> tuple[DataFrame, DataFrame]:
    """(global, vertices): p values (1 + draws at least as far) / (b + 1), overall and by vertex with BH adjustment.

    One-sided p values of vertices are of the upper tail. ``exponent`` is the power of the statistic lp.
    """
    if exponent <= 0:
        raise ValueError("the exponent must be positive")
    n, mean = y.agg(F.count("*"), F.avg("y")).first()
    fitted, _ = refit(model, permuted(y, b, seed, subjects), per_column)
    draws = global_statistics(fitted, mean, n, ["col"], exponent)
    seen = global_statistics(model.fitted.withColumn("one", F.lit(1)), mean, n, ["one"], exponent).first()
    overall = draws.agg(*[((1 + F.count_if(F.col(s) >= float(seen[s]))) / (b + 1)).alias(s) for s in STATISTICS])
    return overall, bh_adjust(p_values(model.fitted, fitted, mean, b, two_sided))


def dirichlet(y: DataFrame, b: int, seed: int = 1) -> DataFrame:
    """(vertex, col, y): responses n w y under b draws of Dirichlet weights."""
    n = y.count()
    draws = y.crossJoin(F.broadcast(draw_index(b, y.sparkSession))).withColumn("e", -F.log(1 - uniform(F.lit(seed), F.col("b"), F.col("vertex"))))
    totals = draws.groupBy("b").agg(F.sum("e").alias("t"))
    return draws.join(F.broadcast(totals), "b").select("vertex", F.col("b").alias("col"), (n * F.col("e") / F.col("t") * F.col("y")).alias("y"))


def intervals(draws: DataFrame, mean: float, level: float = 0.95) -> DataFrame:
    """(vertex, lower, upper, sd, p_above, pseudo_p) of draws (vertex, col, y_hat)."""
    tail = (1 - level) / 2
    above = F.avg((F.col("y_hat") > mean).cast("double"))
    return draws.groupBy("vertex").agg(
        F.percentile("y_hat", tail).alias("lower"), F.percentile("y_hat", 1 - tail).alias("upper"), F.stddev_samp("y_hat").alias("sd"), above.alias("p_above"), F.least(F.lit(1.0), 2 * F.least(above, 1 - above)).alias("pseudo_p")
    )


def posterior(model: Fit, y: DataFrame, b: int = 200, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(vertex, lower, upper, sd): modes are normal around f V'y with variance s^2 / (1 + eta lambda).

    s^2 is the residual sum over n minus the degrees of freedom. Normal numbers come from hashes by
    Box and Muller; quantiles are the sorted draws at floor(tail (b - 1)).
    """
    low, f = model.spectrum, model.weights
    m = len(f)
    row = spectral.coefficients(low.vectors, y, m).first()
    a = np.array(row.a)
    room = row.n - float(f.sum())
    if room < 1:
        raise ValueError("no degrees of freedom are left")
    sigma = math.sqrt(max(row.yy - float(((2 * f - f**2) * a**2).sum()), 0) / room)
    spark = y.sparkSession
    modes = spark.createDataFrame([(k, float(f[k] * a[k]), float(sigma / math.sqrt(1 + model.eta * max(low.values[k], 0)))) for k in range(m)], "mode int, mean double, sd double")
    u = lambda part: uniform(F.lit(seed), F.col("b"), F.col("mode"), F.lit(part))
    z = F.sqrt(-2 * F.log(1 - u("r"))) * F.cos(2 * math.pi * u("a"))
    # b rows of m numbers, whatever the number of vertices
    draws = draw_index(b, spark).crossJoin(modes).withColumn("x", F.col("mean") + F.col("sd") * z).groupBy("b").agg(F.array_sort(F.collect_list(F.struct("mode", "x"))).alias("w"))
    values = low.vectors.crossJoin(F.broadcast(draws.select(F.expr("transform(w, e -> e.x)").alias("w")))).select("vertex", spectral.combine(F.col("w"), F.col("v")).alias("s"))
    tail = (1 - level) / 2
    lo, hi = math.floor(tail * (b - 1)), math.floor((1 - tail) * (b - 1))
    per = values.groupBy("vertex").agg(F.array_sort(F.collect_list("s")).alias("s"), F.stddev_samp("s").alias("sd"))
    return per.select("vertex", F.col("s")[lo].alias("lower"), F.col("s")[hi].alias("upper"), "sd")


def cluster_max(stat: DataFrame, edges: DataFrame, threshold: float, vertices: DataFrame | None = None) -> DataFrame:
    """One row: size and mass of the largest connected clusters of vertices whose statistic reaches the threshold."""
    from .graph import components

    hot = stat.where(F.col("stat") >= threshold)
    inside = edges.join(hot.select(F.col("vertex").alias("i")), "i", "left_semi").join(hot.select(F.col("vertex").alias("j")), "j", "left_semi")
    per = components(hot.select("vertex"), inside).join(hot, "vertex").groupBy("component").agg(F.count("*").alias("n"), F.sum("stat").alias("mass"))
    return per.agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_size"), F.coalesce(F.max("mass"), F.lit(0.0)).alias("max_mass"))


SLOPES = ("gradient", "normalized", "sign", "neighborhood")


def local_slope(y: DataFrame, z: DataFrame, edges: DataFrame, kind: str = "gradient", by_length: bool = False) -> DataFrame:
    """(vertex, slope): dz / dy along the edge of steepest ascent of y, bounded by tanh, or its sign; 0 where no neighbour is higher.

    Kind neighborhood regresses the changes of z on those of y over all edges, weighed by 1 / length^2 with ``by_length``; 0 where y
    does not change.
    """
    from .graph import directed

    if kind not in SLOPES:
        raise ValueError(f"kind must be in {SLOPES}")
    near = directed(edges, "length").join(y.select("vertex", "y"), "vertex").join(z.select("vertex", F.col("y").alias("z")), "vertex")
    near = near.join(y.select(F.col("vertex").alias("nbr"), F.col("y").alias("yn")), "nbr").join(z.select(F.col("vertex").alias("nbr"), F.col("y").alias("zn")), "nbr")
    w = 1 / (F.col("length") * F.col("length")) if by_length else F.lit(1.0)
    near = near.select("vertex", "nbr", (F.col("yn") - F.col("y")).alias("dy"), (F.col("zn") - F.col("z")).alias("dz"), w.alias("w"))
    if kind == "neighborhood":
        square = F.sum(F.col("w") * F.col("dy") * F.col("dy"))
        found = near.groupBy("vertex").agg(F.when(square > 1e-15, F.sum(F.col("w") * F.col("dy") * F.col("dz")) / square).alias("slope"))
        return y.select("vertex").join(found, "vertex", "left").fillna(0.0, ["slope"])
    best = near.groupBy("vertex").agg(F.max_by(F.struct("dy", "dz"), F.struct("dy", -F.col("nbr"))).alias("e"))
    ratio = F.col("e.dz") / F.col("e.dy")
    slope = F.signum("e.dz") if kind == "sign" else F.tanh(ratio) if kind == "normalized" else ratio
    return y.select("vertex").join(best, "vertex", "left").select("vertex", F.when(F.col("e.dy") > 0, slope).otherwise(0.0).alias("slope"))


def local_correlation(y: DataFrame, z: DataFrame, edges: DataFrame, kind: str = "unit") -> DataFrame:
    """(vertex, lcor): cosine of edge differences around each vertex; weights 1, 1 / length^2, or signs only."""
    from .graph import directed

    near = directed(edges, "length").join(y, "vertex").join(z.select("vertex", F.col("y").alias("z")), "vertex")
    near = near.join(y.select(F.col("vertex").alias("nbr"), F.col("y").alias("yn")), "nbr").join(z.select(F.col("vertex").alias("nbr"), F.col("y").alias("zn")), "nbr")
    dy, dz = F.col("yn") - F.col("y"), F.col("zn") - F.col("z")
    if kind == "sign":
        dy, dz = F.signum(dy), F.signum(dz)
    w = 1 / (F.col("length") * F.col("length")) if kind == "derivative" else F.lit(1.0)
    low = F.sqrt(F.sum(w * dy * dy)) * F.sqrt(F.sum(w * dz * dz))
    return near.groupBy("vertex").agg(F.when(low > 1e-10, F.sum(w * dy * dz) / low).otherwise(0.0).alias("lcor"))


def lcor_posterior(model: Fit, responses: DataFrame, b: int = 100, seed: int = 1, level: float = 0.95, kind: str = "derivative", per_column: bool = True) -> DataFrame:
    """(vertex, col, lcor, lower, upper, sd): local correlation of the fitted values with each refitted response.

    lcor is that with the refitted values themselves; the interval comes from ``b`` posterior samples of them.
    """
    from lumenfield.plans.fit import credible, refit_samples

    from .graph import directed

    rows = spectral._checkpointed(refit_samples(model, responses, b, seed, per_column))
    base = model.fitted.select("vertex", F.col("y_hat").alias("f"))
    d = directed(model.edges, "length").join(base, "vertex").join(base.select(F.col("vertex").alias("nbr"), F.col("f").alias("fn")), "nbr")
    w = 1 / (F.col("length") * F.col("length")) if kind == "derivative" else F.lit(1.0)
    sign = (lambda c: F.signum(c)) if kind == "sign" else (lambda c: c)
    d = d.select("vertex", "nbr", w.alias("w"), sign(F.col("fn") - F.col("f")).alias("dy"))
    # draw 0 is the fitted value itself
    every = rows.select("vertex", "col", F.concat(F.array("y_hat"), F.coalesce("s", F.array().cast("array<double>"))).alias("z"))
    near = d.join(every, "vertex").join(every.select(F.col("vertex").alias("nbr"), "col", F.col("z").alias("zn")), ["nbr", "col"])
    near = near.select("vertex", "col", "w", "dy", F.posexplode(F.zip_with("zn", "z", lambda x, z: sign(x - z))).alias("draw", "dz"))
    low = F.sqrt(F.sum(F.col("w") * F.col("dy") * F.col("dy"))) * F.sqrt(F.sum(F.col("w") * F.col("dz") * F.col("dz")))
    per = near.groupBy("vertex", "col", "draw").agg(F.when(low > 1e-10, F.sum(F.col("w") * F.col("dy") * F.col("dz")) / low).otherwise(0.0).alias("c"))
    one = per.groupBy("vertex", "col").agg(F.max(F.when(F.col("draw") == 0, F.col("c"))).alias("lcor"), F.collect_list(F.when(F.col("draw") > 0, F.col("c"))).alias("s"))
    return one.select("vertex", "col", "lcor").join(credible(one.where(F.size("s") > 0), level), ["vertex", "col"], "left")
