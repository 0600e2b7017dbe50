"""Univariate logistic fits, one for each group, and their predictions."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

RIDGE, TOLERANCE, ROUNDS, BOUND = 0.002, 1e-8, 100, 100.0
#: Half the decrease in deviance that a further step would bring, for fits that have settled.
SETTLED = 1e-12


def newton_step(rows: DataFrame, b0: float, b1: float, ridge: float = RIDGE) -> DataFrame:
    """One row (b0, b1): a penalised Newton step over rows (x, y), x centred at its mean; one aggregation."""
    xc = F.col("x") - rows.agg(F.avg("x")).scalar()
    p = 1 / (1 + F.exp(-(b0 + b1 * xc)))
    s = rows.select((p - F.col("y")).alias("e"), (p * (1 - p)).alias("v"), xc.alias("x")).agg(
        F.sum("e").alias("g0"), F.sum(F.col("e") * F.col("x")).alias("g1"), F.sum("v").alias("h00"), F.sum(F.col("v") * F.col("x")).alias("h01"), F.sum(F.col("v") * F.col("x") * F.col("x")).alias("h11")
    )
    s = s.select((F.col("g0") + ridge * b0).alias("g0"), (F.col("g1") + ridge * b1).alias("g1"), (F.col("h00") + ridge).alias("h00"), "h01", (F.col("h11") + ridge).alias("h11"))
    det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
    return s.select((b0 - (F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1")) / det).alias("b0"), (b1 - (F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0")) / det).alias("b1"))


def fit_distributed(rows: DataFrame, ridge: float = RIDGE) -> tuple[float, float, float]:
    """(b0, b1, mean x) over a table of any size: each Newton step is one aggregation."""
    n, ybar, xbar = rows.agg(F.count("*"), F.avg("y"), F.avg("x")).first()
    if ybar in (0.0, 1.0):
        return (BOUND if ybar else -BOUND), 0.0, xbar
    b0, b1 = float(np.log(ybar / (1 - ybar))), 0.0
    for _ in range(ROUNDS):
        new = newton_step(rows, b0, b1, ridge).first()
        done = abs(new.b0 - b0) < TOLERANCE and abs(new.b1 - b1) < TOLERANCE
        b0, b1 = (float(np.clip(v, -BOUND, BOUND)) for v in new)
        if done:
            break
    return b0, b1, xbar


def predict(x: Column, b0: float, b1: float, xbar: float) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), b0 + b1 * (x - xbar)))))


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray, xbar: float, ridge: float) -> tuple[float, float]:
    mean = min(max(float((w * y).sum() / w.sum()), TOLERANCE), 1 - TOLERANCE)
    b = np.array([np.log(mean / (1 - mean)), 0.0])
    c = x - xbar
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(b[0] + b[1] * c, -BOUND, BOUND)))
        e, v = w * (p - y), w * p * (1 - p)
        g = np.array([e.sum(), (e * c).sum()]) + ridge * b
        h = np.array([[v.sum() + ridge, (v * c).sum()], [(v * c).sum(), (v * c * c).sum() + ridge]])
        b = np.clip(b - np.linalg.solve(h, g), -BOUND, BOUND)
        if np.abs(g).max() < TOLERANCE:
            break
    return float(b[0]), float(b[1])


def _without(x: np.ndarray, y: np.ndarray, w: np.ndarray, xbar: float, b: tuple[float, float], ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(settled, linear predictor of each row by the fit without it), all rows at once.

    The gradient of all rows near their fit is its Taylor polynomial, whose coefficients are moments;
    without row i it lacks that row's own term, which is exact. Newton's method runs on this for every
    row. A fit counts as settled if it converged and its predictors all moved so little that the
    remainder stays below 1e-10; others need a refit.
    """
    c = x - xbar
    size = max(float(np.abs(c).max()), 1e-300)
    z = c / size
    b0, b1 = b[0], b[1] * size
    p = 1 / (1 + np.exp(-np.clip(b0 + b1 * z, -700, 700)))
    v = p * (1 - p)
    # derivatives of the logistic function, in falling powers of p
    slopes = [p, v, v * (1 - 2 * p), v * (1 - 6 * v), v * (1 - 2 * p) * (1 - 12 * v), v * (1 - 30 * v + 120 * v * v)]
    powers = [np.ones_like(z)]
    for _ in range(len(slopes)):
        powers.append(powers[-1] * z)
    moment = [[float((w * f * powers[j]).sum()) for j in range(k + 2)] for k, f in enumerate(slopes)]
    r0, r1 = float((w * y).sum()), float((w * y * z).sum())
    left = w.sum() - w
    shift = w * (xbar - x) / left / size  # of the mean, in units of size
    d0, d1 = np.zeros_like(z), np.zeros_like(z)
    fine = np.zeros(len(z), bool)
    with np.errstate(all="ignore"):
        for _ in range(20):
            g0, g1, h00, h01, h11 = (np.zeros_like(z) for _ in range(5))
            for k in range(len(slopes)):
                for j in range(k + 1):
                    t = math.comb(k, j) / math.factorial(k) * d0 ** (k - j) * d1**j
                    g0 += t * moment[k][j]
                    g1 += t * moment[k][j + 1]
                for j in range(k):
                    t = math.comb(k - 1, j) / math.factorial(k - 1) * d0 ** (k - 1 - j) * d1**j
                    h00 += t * moment[k][j]
                    h01 += t * moment[k][j + 1]
                    h11 += t * moment[k][j + 2]
            q = 1 / (1 + np.exp(-np.clip(b0 + d0 + (b1 + d1) * z, -700, 700)))
            own = w * q * (1 - q)
            # the penalty is on the intercept at the mean of the rows left, a0 = b0 + b1 shift, and on b1 / size
            a0, a1 = b0 + d0 + (b1 + d1) * shift, (b1 + d1) / size**2
            g0 += ridge * a0 - r0 - w * (q - y)
            g1 += ridge * (a0 * shift + a1) - r1 - w * (q - y) * z
            h00 += ridge - own
            h01 += ridge * shift - own * z
            h11 += ridge * (shift * shift + 1 / size**2) - own * z * z
            det = h00 * h11 - h01 * h01
            m0, m1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
            d0, d1 = d0 - m0, d1 - m1
            fine = np.abs(m0) + np.abs(m1) < 1e-11
            if fine.all():
                break
    reach = np.abs(d0) + np.abs(d1)
    # coefficients at their bound are left to a refit; predictors beyond it are 0 or 1 to rounding anyway
    inside = (np.abs(b1 + d1) / size < BOUND - 1) & (np.abs(b0 + d0 + (b1 + d1) * shift) < BOUND - 1)
    return fine & (reach < 0.05) & inside, np.clip(b0 + d0 + (b1 + d1) * z, -BOUND, BOUND)


def ulogit(rows: DataFrame, by: str, leave_one_out: bool = True, ridge: float = RIDGE) -> DataFrame:
    """(by, x, y, prediction, loo_error) for rows (by, x, y, w): groups small enough for a task each.

    loo_error is the squared error of the prediction by a fit without the row; fits that lie near the
    whole one come from its moments, the others from a refit. A constant response is predicted as itself.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (pdf[c].to_numpy(float) for c in ("x", "y", "w"))
        w = w / w.sum() * len(w)
        mean = float((w * y).sum() / w.sum())
        if mean < TOLERANCE or mean > 1 - TOLERANCE:
            return pdf[[by, "x", "y"]].assign(prediction=float(mean > 0.5), loo_error=0.0)
        xbar = float((w * x).sum() / w.sum())
        b = _newton(x, y, w, xbar, ridge)
        of = lambda v, b, m: 1 / (1 + np.exp(-np.clip(b[0] + b[1] * (v - m), -BOUND, BOUND)))
        loo = np.full(len(x), np.nan)
        again = np.zeros(len(x), bool)
        if leave_one_out:
            settled, eta = _without(x, y, w, xbar, b, ridge)
            left = w.sum() - w
            mean_left = ((w * y).sum() - w * y) / np.where(left > 0, left, 1)
            again = ~settled | (mean_left < 2 * TOLERANCE) | (mean_left > 1 - 2 * TOLERANCE) | (left < 1e-9 * len(x))
            loo[~again] = (y[~again] - 1 / (1 + np.exp(-eta[~again]))) ** 2
        for i in np.flatnonzero(again):
            u = w.copy()
            u[i] = 0
            m = float((u * y).sum() / u.sum()) if u.sum() > 0 else 0.5
            if m < TOLERANCE or m > 1 - TOLERANCE:
                guess = float(m > 0.5)
            else:
                xm = float((u * x).sum() / u.sum())
                guess = float(of(x[i], _newton(x, y, u, xm, ridge), xm))
            loo[i] = (y[i] - guess) ** 2
        return pdf[[by, "x", "y"]].assign(prediction=of(x, b, xbar), loo_error=loo)

    kind = rows.schema[by].dataType.simpleString()
    return rows.select(by, F.col("x").cast("double"), F.col("y").cast("double"), F.col("w").cast("double")).groupBy(by).applyInPandas(run, f"{by} {kind}, x double, y double, prediction double, loo_error double")


def iwls(rows: DataFrame, by: str, quadratic: bool = False, ridge: float = 0.0) -> DataFrame:
    """(by, x, y, prediction, loo_brier, loo_deviance): reweighted least squares with step halving; the
    left-out fits are approximated by the hat matrix."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (pdf[c].to_numpy(float) for c in ("x", "y", "w"))
        w = w / w.sum() * len(w)
        c = x - (w * x).sum() / w.sum()
        design = np.stack([np.ones_like(c), c, *([c * c] if quadratic else [])], 1)
        bound = max(1e-15, 0.1 / len(x))
        b = np.zeros(design.shape[1])
        m = np.clip((w * y).sum() / w.sum(), bound, 1 - bound)
        b[0] = np.log(m / (1 - m))
        curve = lambda b: 1 / (1 + np.exp(-np.clip(design @ b, -700, 700)))
        deviance = lambda b: float(2 * (w * (np.logaddexp(0, design @ b) - y * (design @ b))).sum())
        last, settled = deviance(b), False
        for _ in range(ROUNDS):
            p = curve(b)
            g = design.T @ (w * (y - p))
            move = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + 1e-12 * np.eye(len(b)), g)
            if g @ move < SETTLED:
                settled = True
                break
            size = 1.0
            while size > 1e-6 and deviance(b + size * move) > last + 1e-12:
                size /= 2
            b = b + size * move
            last = deviance(b)
        if not settled:
            warnings.warn(f"a fit has not settled after {ROUNDS} rounds")
        p = np.clip(curve(b), bound, 1 - bound)
        v = w * p * (1 - p)
        inverse = np.linalg.inv((design * v[:, None]).T @ design + (ridge + 1e-12) * np.eye(len(b)))
        hat = v * np.einsum("ij,jk,ik->i", design, inverse, design)
        eta = design @ b - hat * (y - p) / np.maximum(1 - hat, 1e-10) / np.maximum(p * (1 - p), 1e-10)
        q = np.clip(1 / (1 + np.exp(-np.clip(eta, -700, 700))), bound, 1 - bound)
        return pdf[[by, "x", "y"]].assign(prediction=p, loo_brier=(y - q) ** 2, loo_deviance=-(y * np.log(q) + (1 - y) * np.log(1 - q)))

    kind = rows.schema[by].dataType.simpleString()
    return rows.select(by, F.col("x").cast("double"), F.col("y").cast("double"), F.col("w").cast("double")).groupBy(by).applyInPandas(run, f"{by} {kind}, x double, y double, prediction double, loo_brier double, loo_deviance double")


def iwls_table(rows: DataFrame, quadratic: bool = False, ridge: float = 0.0) -> tuple[DataFrame, np.ndarray]:
    """(rows with prediction, loo_brier and loo_deviance; coefficients at the centred x) for one fit over a table of any size.

    The same fit as ``iwls``: each look at the deviance, its gradient and its Hessian is one aggregation,
    and left-out fits follow from the hat matrix row by row. Predictions are kept off 0 and 1 by their bound, the fit's
    equations are not; a fit that does not settle within ROUNDS, as one of separated responses, warns.
    """
    n, sw, swx, swy = rows.agg(F.count("*"), F.sum("w"), F.sum(F.col("w") * F.col("x")), F.sum(F.col("w") * F.col("y"))).first()
    c = F.col("x") - swx / sw
    design = [F.lit(1.0), c, *([c * c] if quadratic else [])]
    d, w, y = len(design), F.col("w") * (n / sw), F.col("y")
    bound = max(1e-15, 0.1 / n)

    def linear(b: np.ndarray) -> Column:
        out = F.lit(float(b[0]))
        for v, x in zip(b[1:], design[1:]):
            out = out + float(v) * x
        return out

    def prob(eta: Column) -> Column:
        return F.least(F.greatest(1 / (1 + F.exp(-F.least(F.greatest(eta, F.lit(-700.0)), F.lit(700.0)))), F.lit(bound)), F.lit(1 - bound))

    def look(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Deviance, gradient and Hessian with probabilities as they are: bounds would bend the equations of the fit."""
        eta = linear(b)
        p = 1 / (1 + F.exp(-F.least(F.greatest(eta, F.lit(-700.0)), F.lit(700.0))))
        deviance = 2 * w * (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))) - y * eta)
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        got = rows.agg(F.sum(deviance), *[F.sum(w * (y - p) * x) for x in design], *[F.sum(w * p * (1 - p) * design[i] * design[j]) for i, j in pairs]).first()
        h = np.zeros((d, d))
        for (i, j), v in zip(pairs, got[1 + d :]):
            h[i, j] = h[j, i] = v
        return got[0], np.array(got[1 : 1 + d]), h

    m = float(np.clip(swy / sw, bound, 1 - bound))
    b = np.zeros(d)
    b[0] = math.log(m / (1 - m))
    last, g, h = look(b)
    for _ in range(ROUNDS):
        move, size = np.linalg.solve(h + 1e-12 * np.eye(d), g), 1.0
        if g @ move < SETTLED:
            break
        now = look(b + move)
        while size > 1e-6 and now[0] > last + 1e-12:
            size /= 2
            now = look(b + size * move)
        b, (last, g, h) = b + size * move, now
    else:
        warnings.warn(f"the fit has not settled after {ROUNDS} rounds")
    inverse = np.linalg.inv(h + (ridge + 1e-12) * np.eye(d))
    p = F.col("prediction")
    v = w * p * (1 - p)
    hat = F.lit(0.0)
    for i in range(d):
        for j in range(d):
            hat = hat + float(inverse[i, j]) * design[i] * design[j]
    q = prob(linear(b) - v * hat * (y - p) / F.greatest(1 - v * hat, F.lit(1e-10)) / F.greatest(p * (1 - p), F.lit(1e-10)))
    out = rows.withColumn("prediction", prob(linear(b)))
    return out.withColumns({"loo_brier": F.pow(y - q, F.lit(2.0)), "loo_deviance": -(y * F.log(q) + (1 - y) * F.log(1 - q))}), b


def predict_quadratic(x: Column, b: list[float], xbar: float, link: bool = False) -> Column:
    """Prediction of a fit with coefficients b at the centred x, on the scale of the response or of its logit."""
    c = x - xbar
    eta = sum((float(v) * F.pow(c, F.lit(float(k))) for k, v in enumerate(b)), F.lit(0.0))
    return eta if link else 1 / (1 + F.exp(-eta))
