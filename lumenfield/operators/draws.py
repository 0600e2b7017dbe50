"""Bootstrap draws as arrays: every draw's coefficients in one pass, then all that a vertex needs in its own row.

A draw weighs vertices by exponential numbers, hashes of seed, draw and vertex, over their sum. Tasks hand on sums for each
draw and mode; no row is multiplied by the number of draws, and none is shuffled for them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenfield.functions.columns import eta_grid_refit
from lumenfield.functions.tails import box_cox_rows, normal_upper, shapiro_wilk, t_test, wilcoxon
from lumenfield.plans.fit import Fit

from . import spectral
from .extrema import bh_adjust
from .graph import directed
from .resample import permuted

#: Numbers that a task holds at once.
HELD = 1 << 21
#: Vertices whose edges meet in one task of the slope test.
TOGETHER = 2048


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def exponentials(vertex: np.ndarray, b: int, seed: int) -> np.ndarray:
    """(vertices, draws) of exponential numbers."""
    with np.errstate(over="ignore"):
        own = _mixed(vertex.astype(np.int64).view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        draw = _mixed(np.arange(1, b + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        u = (_mixed(own[:, None] ^ draw[None]) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return -np.log1p(-u)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(n, -1)


def _summed(rows: DataFrame) -> np.ndarray:
    """Sums over partitions' arrays (s), place by place."""
    flat = rows.select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("v")).toArrow()
    out = np.zeros(flat.num_rows)
    out[flat.column("pos").to_numpy()] = flat.column("v").to_numpy()
    return out


def coefficients(rows: DataFrame, b: int, seed: int, m: int, responses: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients (response, draw, mode), squared sums (response, draw)) of n w y for rows (vertex, v, y array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + b + responses * b * (m + 1))
        for batch in batches:
            n = batch.num_rows
            ids, v, y = batch.column("vertex").to_numpy(), _matrix(batch.column("v"), n), _matrix(batch.column("y"), n)
            step = max(1, HELD // b)
            for a in range(0, n, step):
                w = exponentials(ids[a : a + step], b, seed)
                parts = [np.array([len(w)]), w.sum(0)]
                for r in range(responses):
                    weighed = w * y[a : a + step, r : r + 1]
                    parts += [(weighed.T @ v[a : a + step]).ravel(), (weighed**2).sum(0)]
                total += np.concatenate(parts)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["s"])

    s = _summed(rows.select("vertex", "v", "y").mapInArrow(run, "s array<double>"))
    if not len(s):
        raise ValueError("there are no vertices")
    scale = s[0] / s[1 : 1 + b]
    rest = s[1 + b :].reshape(responses, b * (m + 1))
    coef = rest[:, : b * m].reshape(responses, b, m) * scale[None, :, None]
    return coef, rest[:, b * m :] * scale[None] ** 2


def filtered(model: Fit, coef: np.ndarray, yy: np.ndarray, n: int, per_column: bool) -> np.ndarray:
    """Coefficients (draw, mode) of the fitted values: by the model's filter, or by each draw's own of least GCV."""
    if not per_column:
        return coef * model.weights
    grid = spectral.filter_matrix(model.filter, model.spectrum.values, eta_grid_refit(model.spectrum.values.tolist(), 40))
    best = [grid[int(spectral.gcv_scores(grid, a, q, n).argmin())] for a, q in zip(coef, yy)]
    return coef * np.array(best)


def _drawn(model: Fit, y: DataFrame, b: int, seed: int, per_column: bool) -> tuple[DataFrame, np.ndarray, float, int]:
    """(rows (vertex, y_hat, v), coefficients of the draws' fitted values, mean response, n)."""
    n, mean = y.agg(F.count("*"), F.avg("y")).first()
    rows = spectral._checkpointed(y.join(model.spectrum.vectors, "vertex").select("vertex", "v", F.array(F.col("y").cast("double")).alias("y")))
    coef, yy = coefficients(rows, b, seed, len(model.spectrum.values), 1)
    own = rows.select("vertex", "v").join(model.fitted.select("vertex", F.col("y_hat").cast("double").alias("y_hat")), "vertex")
    return own, filtered(model, coef[0], yy[0], n, per_column), float(mean), n


def bootstrap(model: Fit, y: DataFrame, b: int = 99, seed: int = 1, level: float = 0.95, per_column: bool = False) -> DataFrame:
    """(vertex, y_hat, lower, median, upper, sd, p_above, pseudo_p) under Dirichlet weights.

    Quantiles interpolate between draws; p_above is the share of draws above the mean response, pseudo_p twice the smaller share
    of draws that are at least, or at most, as far from it as the fitted value.
    """
    rows, coef, mean, _ = _drawn(model, y, b, seed, per_column)
    tail = (1 - level) / 2
    names = ["lower", "median", "upper", "sd", "p_above", "pseudo_p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, max(1, HELD // b)):
                part = batch.slice(a, max(1, HELD // b))
                s, own = _matrix(part.column("v"), part.num_rows) @ coef.T, part.column("y_hat").to_numpy()
                far, seen = np.abs(s - mean), np.abs(own - mean)[:, None]
                pseudo = np.minimum(2 * np.minimum((far >= seen).mean(1), (far <= seen).mean(1)), 1)
                columns = [*np.quantile(s, [tail, 0.5, 1 - tail], axis=1), s.std(1, ddof=1), (s > mean).mean(1), pseudo]
                yield pa.RecordBatch.from_arrays([part.column("vertex"), part.column("y_hat"), *map(pa.array, columns)], ["vertex", "y_hat", *names])

    return rows.select("vertex", "y_hat", "v").mapInArrow(run, "vertex long, y_hat double, " + ", ".join(f"{c} double" for c in names))


STATISTICS = ("l2", "log", "logit")


def bootstrap_global(model: Fit, y: DataFrame, b: int = 99, seed: int = 1, level: float = 0.95, per_column: bool = False) -> DataFrame:
    """(stat, observed, mean, lower, upper, prob_ge) for squared distances of fitted values from the mean response, as they are
    and on the scales of logarithms and logits: over the draws' mean, interval, and share at least as large as observed."""
    rows, coef, mean, n = _drawn(model, y, b, seed, per_column)
    edge = max(1e-6, 0.5 / n)
    clip = lambda p: np.clip(p, edge, 1 - edge)
    scales = {"l2": lambda p: p, "log": lambda p: np.log(clip(p)), "logit": lambda p: np.log(clip(p) / (1 - clip(p)))}
    at = {name: float(f(np.array(mean))) for name, f in scales.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(STATISTICS), b + 1))
        for batch in batches:
            for a in range(0, batch.num_rows, max(1, HELD // (b + 1))):
                part = batch.slice(a, max(1, HELD // (b + 1)))
                s = np.column_stack([part.column("y_hat").to_numpy(), _matrix(part.column("v"), part.num_rows) @ coef.T])
                total += np.array([((scales[k](s) - at[k]) ** 2).sum(0) for k in STATISTICS])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["s"])

    got = _summed(rows.select("y_hat", "v").mapInArrow(run, "s array<double>")).reshape(len(STATISTICS), b + 1)
    tail = (1 - level) / 2
    out = [(k, float(o), float(d.mean()), *(float(q) for q in np.quantile(d, [tail, 1 - tail])), float((d >= o).mean())) for k, (o, *d) in zip(STATISTICS, got) for d in [np.array(d)]]
    return y.sparkSession.createDataFrame(out, "stat string, observed double, mean double, lower double, upper double, prob_ge double")


TESTS, BOX_COX, SLOPES = ("paired.t", "weighted.pvalue", "wilcoxon"), ("auto", "always", "never"), ("normalized", "slope", "sign")
_SIGMOIDS = {"tanh": np.tanh, "arctan": lambda x: 2 / math.pi * np.arctan(x), "algebraic": lambda x: x / np.sqrt(1 + x * x)}
_REPORT = ("lslope", "signal_mean", "signal_sd", "null_mean", "null_sd", "null_median", "null_mad", "diff_mean", "diff_sd", "z", "robust_z", "shapiro_p", "boxcox_lambda", "p_value")


def tested(signal: np.ndarray, null: np.ndarray, test: str, box_cox: str, alpha: float) -> dict[str, np.ndarray]:
    """Paired tests of rows of draws; nan where the differences do not vary."""
    diff = signal - null
    vary = diff.std(1, ddof=1) > np.finfo(float).eps
    shapiro, lam, p = (np.full(len(diff), np.nan) for _ in range(3))
    shapiro[vary] = shapiro_wilk(diff[vary])[1]
    moved = vary & ((box_cox == "always") | ((box_cox == "auto") & (np.nan_to_num(shapiro, nan=1.0) < alpha)))
    used = diff.copy()
    if moved.any():
        used[moved], lam[moved], _ = box_cox_rows(diff[moved])
    if test == "paired.t":
        p[vary] = t_test(used[vary])[1]
    elif test == "wilcoxon":
        p[vary] = wilcoxon(diff[vary])[1]
    else:
        one, other = signal.copy(), null.copy()
        if moved.any():
            low = null[moved].min(1)
            shift = np.where(low <= 0, np.abs(low) + 0.01 * null[moved].std(1, ddof=1), 0.0)[:, None]
            power = lam[moved][:, None]
            with np.errstate(invalid="ignore", divide="ignore"):
                change = lambda x: np.where(np.abs(power) > np.finfo(float).eps, ((x + shift) ** power - 1) / np.where(power == 0, 1, power), np.log(x + shift))
                one[moved], other[moved] = change(signal[moved]), change(null[moved])
        with np.errstate(invalid="ignore", divide="ignore"):
            z = np.abs(one - other.mean(1, keepdims=True)) / other.std(1, ddof=1, keepdims=True)
            p[vary] = np.nanmean(2 * normal_upper(z[vary]), 1) if vary.any() else p[vary]
    return {"shapiro_p": shapiro, "boxcox_lambda": lam, "p_value": p}


def slope_test(
    model: Fit, y: DataFrame, z: DataFrame, b: int = 500, seed: int = 1, test: str = "paired.t", box_cox: str = "auto", alpha: float = 0.05, slope: str = "normalized", ascending: bool = True,
    sigmoid: str = "tanh", smoothed: bool = False,
) -> DataFrame:
    """(vertex, lslope, ..., p_value, p_adjusted): slopes of z along the steepest edge of the smoothed y, against a permuted y.

    In each draw the response and one permutation of it get the same Dirichlet weights and are smoothed by the model's filter. At a
    vertex the edge of the largest rise (or fall) gives the slope dz / dy, bounded by a sigmoid when normalised, or its sign; it is 0
    where no neighbour is higher. Differences of the paired slopes are tested by Student's t, by signed ranks, or by the mean normal tail
    of the signal's draws under the null's mean and deviation; where they are not normal at level ``alpha`` (Shapiro and Wilk),
    or always, a Box-Cox power comes first. Vertices whose differences do not vary have no p value.

    Edges carry the neighbours' modes, not their draws: a task makes the draws of its own vertices.
    """
    if test not in TESTS or box_cox not in BOX_COX or slope not in SLOPES:
        raise ValueError(f"test must be in {TESTS}, box_cox in {BOX_COX}, slope in {SLOPES}")
    vectors, m, f = model.spectrum.vectors, len(model.spectrum.values), model.weights
    shuffled = permuted(y, 1, seed + 1).select("vertex", F.col("y").alias("other"))
    rows = spectral._checkpointed(y.join(shuffled, "vertex").join(vectors, "vertex").select("vertex", "v", F.array(F.col("y").cast("double"), F.col("other").cast("double")).alias("y")))
    coef, _ = coefficients(rows, b, seed, m, 2)
    point = np.array(spectral.coefficients(vectors, y, m).first().a) * f
    if smoothed:
        z_hat = z.select("vertex", F.col("y").cast("double").alias("z"))
    else:
        of_z = np.array(spectral.coefficients(vectors, z, m).first().a) * f
        z_hat = vectors.select("vertex", spectral.combine(F.array(*map(F.lit, of_z.tolist())), F.col("v")).alias("z"))
    fits = np.vstack([point[None], coef[0] * f, coef[1] * f])  # the fit itself, then draws of both
    at = spectral._checkpointed(rows.select("vertex", "v").join(z_hat, "vertex"))
    near = directed(model.edges).join(at.select(F.col("vertex").alias("nbr"), "v", "z"), "nbr").select("vertex", "nbr", "v", "z")
    own = at.select("vertex", F.lit(None).cast("long").alias("nbr"), "v", "z")
    buckets = max(1, -(-at.count() // TOGETHER))
    both = own.unionByName(near).withColumn("bucket", F.pmod(F.xxhash64("vertex"), F.lit(buckets)).cast("int"))
    sign = 1.0 if ascending else -1.0

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vertex").to_numpy()
        nbr = table.column("nbr").to_numpy(zero_copy_only=False).astype(float)
        v, z = _matrix(table.column("v").combine_chunks(), len(ids)), table.column("z").to_numpy()
        mine = np.flatnonzero(np.isnan(nbr))
        mine = mine[np.argsort(ids[mine], kind="stable")]
        edges = np.flatnonzero(~np.isnan(nbr))
        edges = edges[np.lexsort((nbr[edges], ids[edges]))]
        slopes = np.zeros((len(mine), len(fits)))
        bounds = np.searchsorted(ids[edges], ids[mine]), np.searchsorted(ids[edges], ids[mine], "right")
        a = 0
        while a < len(mine):
            # as many vertices as their edges' draws fit
            e = max(a + 1, int(np.searchsorted(bounds[1], bounds[0][a] + max(1, HELD // len(fits)), "right")))
            some, span = mine[a:e], edges[bounds[0][a] : bounds[1][e - 1]]
            has = bounds[1][a:e] > bounds[0][a:e]
            if len(span):
                place = np.searchsorted(ids[some], ids[span])
                rise = sign * (v[span] - v[some[place]]) @ fits.T
                first = (bounds[0][a:e] - bounds[0][a])[has]
                top = np.maximum.reduceat(rise, first, axis=0)
                wide = np.repeat(top, (bounds[1][a:e] - bounds[0][a:e])[has], axis=0)
                # of equal rises the smaller neighbour's counts
                where = np.minimum.reduceat(np.where(rise == wide, np.arange(len(span))[:, None], len(span)), first, axis=0)
                dz = z[span][where] - z[some[has]][:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = np.where(top > 0, dz / (sign * top), 0.0)
                slopes[a:e][has] = value if slope == "slope" else np.where(top > 0, np.sign(dz), 0.0) if slope == "sign" else _SIGMOIDS[sigmoid](value)
            a = e
        own_slope, signal, null = slopes[:, 0], slopes[:, 1 : 1 + b], slopes[:, 1 + b :]
        middle = np.median(null, 1)
        mad = 1.4826 * np.median(np.abs(null - middle[:, None]), 1)
        sd = null.std(1, ddof=1)
        eps = np.finfo(float).eps
        with np.errstate(divide="ignore", invalid="ignore"):
            z_score, robust = np.where(sd > eps, (own_slope - null.mean(1)) / sd, np.nan), np.where(mad > eps, (own_slope - middle) / mad, np.nan)
        out = {
            "lslope": own_slope, "signal_mean": signal.mean(1), "signal_sd": signal.std(1, ddof=1), "null_mean": null.mean(1), "null_sd": sd, "null_median": middle, "null_mad": mad,
            "diff_mean": (signal - null).mean(1), "diff_sd": (signal - null).std(1, ddof=1), "z": z_score, "robust_z": robust,
        } | tested(signal, null, test, box_cox, alpha)
        return pa.table({"vertex": ids[mine]} | {c: pa.array(out[c], pa.float64(), mask=np.isnan(out[c])) for c in _REPORT})

    found = both.groupBy("bucket").applyInArrow(run, "vertex long, " + ", ".join(f"{c} double" for c in _REPORT))
    return bh_adjust(spectral._checkpointed(found))
