"""Recovery and selection metrics, column scales, classical baselines and PCA."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lumenfield.functions import orders

TINY = 2.220446049250313e-16


def recovery(rows: DataFrame) -> DataFrame:
    """One row of metrics for (y, y_true, y_hat)."""
    r, raw = F.col("y_hat") - F.col("y_true"), F.col("y") - F.col("y_true")
    rmse_raw, rmse_fit = F.sqrt(F.avg(raw * raw)), F.sqrt(F.avg(r * r))
    safe = lambda a: F.when((F.stddev_samp(a) > 1e-12) & (F.stddev_samp("y_true") > 1e-12), F.corr(a, "y_true"))
    return rows.agg(
        F.count("*").alias("n"), rmse_raw.alias("rmse_raw"), rmse_fit.alias("rmse_fit"), (rmse_raw - rmse_fit).alias("rmse_improvement"), ((rmse_raw - rmse_fit) / F.greatest(rmse_raw, F.lit(TINY))).alias("rmse_improvement_fraction"),
        safe("y").alias("cor_raw_truth"), safe("y_hat").alias("cor_fit_truth"), F.when(F.var_samp("y_true") > 1e-12, F.var_samp("y_hat") / F.var_samp("y_true")).alias("var_ratio_fit_truth"),
        F.avg(r).alias("residual_mean"), F.stddev_samp(r).alias("residual_sd"), F.max(F.abs(r)).alias("residual_max_abs"),
    )


def boundary_rmse(rows: DataFrame, kind: str, coordinate: str, width: float | None = None) -> DataFrame:
    """One row (boundary_rmse) of (y_true, y_hat) near the ends: on a circle within ``width`` (0.25) of angle 0, on a line within the
    share ``width`` (0.1) of its range from either end; null where there is no such row or no range."""
    if kind == "circle":
        at = F.pmod(F.col(coordinate), F.lit(2 * np.pi))
        near = (at <= (width or 0.25)) | (at >= 2 * np.pi - (width or 0.25))
    elif kind == "line":
        lo, hi = rows.agg(F.min(coordinate), F.max(coordinate)).first()
        if lo is None or hi - lo <= np.sqrt(TINY):
            return rows.agg(F.lit(None).cast("double").alias("boundary_rmse"))
        margin = (width or 0.1) * (hi - lo)
        near = (F.col(coordinate) <= lo + margin) | (F.col(coordinate) >= hi - margin)
    else:
        raise ValueError("kind must be circle or line")
    r = F.col("y_hat") - F.col("y_true")
    return rows.where(near).agg(F.sqrt(F.avg(r * r)).alias("boundary_rmse"))


def column_scales(rows: DataFrame, column: str, value: str) -> DataFrame:
    """(column, scale): 1.4826 MAD, or the standard deviation where that vanishes, or 1."""
    med = orders.by_group(rows, column, value, 0.5, "m").join(rows.groupBy(column).agg(F.stddev_samp(value).alias("sd")), column)
    far = rows.join(med, column).withColumn("far", F.abs(F.col(value) - F.col("m")))
    mad = orders.by_group(far, column, "far", 0.5, "mad").select(column, (1.4826 * F.col("mad")).alias("mad")).join(med.select(column, "sd"), column)
    small = float(np.sqrt(TINY))
    return mad.select(column, F.when(F.col("mad") > small, F.col("mad")).when(F.col("sd") > small, F.col("sd")).otherwise(1.0).alias("scale"))


def weighted_summary(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """(by, mean, se): weighted mean and its error by the effective sample size."""
    ok = rows.where((F.col(weight) > 0) & F.col(value).isNotNull() & ~F.isnan(value))
    s = ok.groupBy(by).agg(F.sum(weight).alias("sw"), F.sum(F.col(weight) * F.col(weight)).alias("sw2"), F.sum(F.col(weight) * F.col(value)).alias("swx"))
    s = s.select(by, "sw", "sw2", (F.col("swx") / F.col("sw")).alias("mean"))
    v = ok.join(s, by).groupBy(by).agg(F.first("mean").alias("mean"), (F.sum(F.col(weight) * F.pow(F.col(value) - F.col("mean"), 2)) / F.first("sw")).alias("var"), (F.first("sw") * F.first("sw") / F.first("sw2")).alias("ess"))
    return v.select(by, "mean", F.when(F.col("ess") <= 1, 0.0).otherwise(F.sqrt(F.col("var") / F.col("ess"))).alias("se"))


def one_se_rule(scores: DataFrame) -> DataFrame:
    """One row: of models (k, n_eigenpairs, eta, mean, se) within one error of the best, fewer eigenpairs,
    then higher k, then higher eta."""
    limit = scores.agg(F.min_by(F.col("mean") + F.col("se"), "mean")).scalar()
    return scores.where(F.col("mean") <= limit).orderBy("n_eigenpairs", F.desc("k"), F.desc("eta")).limit(1)


def knn_mean(neighbours: DataFrame, y: DataFrame) -> DataFrame:
    """(vertex, y_hat): mean response of the neighbours without the vertex itself."""
    return neighbours.where("rank > 0").join(y.select(F.col("vertex").alias("nbr"), "y"), "nbr").groupBy("vertex").agg(F.avg("y").alias("y_hat"))


def gaussian_smooth(neighbours: DataFrame, y: DataFrame, bandwidth: float) -> DataFrame:
    """(vertex, y_hat): Gaussian weights over the k nearest others; the nearest alone if all vanish."""
    h = max(bandwidth, 1e-6)
    near = neighbours.where("rank > 0").join(y.select(F.col("vertex").alias("nbr"), "y"), "nbr").withColumn("w", F.exp(-F.col("dist") * F.col("dist") / (2 * h * h)))
    low = F.sum("w")
    return near.groupBy("vertex").agg(F.when(low > 1e-12, F.sum(F.col("w") * F.col("y")) / low).otherwise(F.min_by("y", F.struct("dist", "nbr"))).alias("y_hat"))


def k_sweep_normalised(rows: DataFrame) -> DataFrame:
    """rows (k, gcv, ...) with min_norm_gcv and robust_norm_gcv (MAD, else quartile range, else deviation, else 1)."""
    med, best = rows.agg(F.median("gcv"), F.min("gcv")).first()
    small = float(np.sqrt(TINY))
    mad = rows.agg((1.4826 * F.median(F.abs(F.col("gcv") - med))).alias("a"), (F.percentile("gcv", 0.75) - F.percentile("gcv", 0.25)).alias("b"), F.stddev_samp("gcv").alias("c")).first()
    scale = next((v for v in mad if v is not None and v > small), 1.0)
    return rows.withColumns({"min_norm_gcv": F.col("gcv") / best, "robust_norm_gcv": (F.col("gcv") - med) / scale})


def k_sweep_selection(rows: DataFrame) -> DataFrame:
    """(criterion, k_selected, value) for the five criteria; the smaller k on ties."""
    out = None
    for name, field, high in (("min.rmse_fit", "rmse_fit", False), ("max.cor_fit_truth", "cor_fit_truth", True), ("min.gcv", "gcv", False), ("min.min_norm_gcv", "min_norm_gcv", False), ("min.robust_norm_gcv", "robust_norm_gcv", False)):
        ok = rows.where(F.col(field).isNotNull() & ~F.isnan(field))
        pick = F.min_by(F.struct("k", F.col(field).alias("value")), F.struct(-F.col(field) if high else F.col(field), F.col("k")))
        row = ok.agg(pick.alias("r")).select(F.lit(name).alias("criterion"), F.col("r.k").alias("k_selected"), F.col("r.value").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def moments(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance) by d (d + 3) / 2 sums in one aggregation over partial sums of blocks."""
    import pyarrow as pa

    d = len(points.first().x)

    def part(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), np.float64).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.sum(0).tolist()]), pa.array([(x.T @ x).ravel().tolist()])], ["n", "s", "g"])

    # partial sums of batches meet in groups before the driver adds what is left of them
    rows = points.select("x").mapInArrow(part, "n long, s array<double>, g array<double>")
    add = lambda c, m: F.array(*[F.sum(F.col(c)[i]) for i in range(m)])
    if d <= 16:
        n, s, g = rows.agg(F.sum("n"), add("s", d), add("g", d * d)).first()
    else:
        flat = rows.select("n", F.posexplode(F.concat("s", "g"))).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("v")).orderBy("pos").collect()
        n, v = flat[0].n, [r.v for r in flat]
        s, g = v[:d], v[d:]
    s, g = np.array(s), np.array(g).reshape(d, d)
    return n, s / n, (g - np.outer(s, s) / n) / (n - 1)


def pca(points: DataFrame, variance: float = 0.95, limit: int = 50) -> tuple[DataFrame, list[float]]:
    """(scores(vertex, x), cumulative variance shares): the fewest centred components that reach the variance."""
    _, mean, cov = moments(points)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    share = np.cumsum(np.maximum(values, 0)) / max(np.maximum(values, 0).sum(), TINY)
    q = min(limit, int(np.argmax(share >= variance - 1e-12)) + 1 if (share >= variance - 1e-12).any() else len(share))
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    centre = F.array(*map(F.lit, mean.tolist()))
    score = lambda v: F.aggregate(F.zip_with(F.zip_with("x", centre, lambda a, b: a - b), F.array(*map(F.lit, v.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return points.select("vertex", F.array(*[score(vectors[:, c]) for c in range(q)]).alias("x")), share.tolist()
