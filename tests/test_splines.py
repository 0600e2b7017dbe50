"""Splines of curves of any length against dense algebra."""

import numpy as np
import pytest

from lumenfield.operators import splines


def dense(x, y, penalty=None):
    """(penalty, GCV scores, fit at the distinct x, curve at any x) by the band matrices of Reinsch, solved densely."""
    at, back = np.unique(x, return_inverse=True)
    w = np.bincount(back).astype(float)
    mean = np.bincount(back, y) / w
    n, h = len(at), np.diff(at)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j, j - 1] = r[j - 1, j] = h[j] / 6
    tried = [penalty] if penalty is not None else splines.PENALTIES * (at[-1] - at[0]) ** 3
    fits, scores = [], []
    for lam in tried:
        gamma = np.linalg.solve(r + lam * q.T @ (q / w[:, None]), q.T)
        s = np.eye(n) - lam * (q @ gamma) / w[:, None]
        fits.append(s @ mean)
        scores.append((w * (mean - fits[-1]) ** 2).sum() / (n - np.trace(s)) ** 2)
    fit = fits[int(np.argmin(scores))]
    m = np.concatenate([[0], np.linalg.solve(r, q.T @ fit), [0]])

    def curve(g):
        k = np.clip(np.searchsorted(at, g) - 1, 0, n - 2)
        a, b = (at[k + 1] - g) / h[k], (g - at[k]) / h[k]
        return a * fit[k] + b * fit[k + 1] + ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1]) * h[k] ** 2 / 6

    return np.array(scores), mean - fit, curve


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    x = np.round(np.concatenate([rng.uniform(-3, 9, 60), rng.uniform(2, 2.2, 30), rng.integers(0, 5, 25)]), 3)
    return x, np.sin(x) + 0.1 * x**2 + rng.normal(0, 0.3, len(x))


@pytest.mark.parametrize("block", [7, splines.BLOCK])
def test_scores_and_curve_equal_dense_algebra(spark, rows, block):
    x, y = rows
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    scores, rest, curve = dense(x, y)
    got = np.array([s for s, _ in splines.Chain(frame, block).scores(splines.PENALTIES)])
    assert np.allclose(got, scores, rtol=1e-5)
    out = splines.spline(frame, block=block).orderBy("x").toPandas()
    n = len(np.unique(x))
    assert np.allclose(out.x, np.linspace(x.min(), x.max(), max(200, 5 * n)), rtol=0, atol=1e-12)
    assert np.allclose(out.fit, curve(out.x.to_numpy()), atol=1e-6)
    band = 1.96 * np.sqrt((rest**2).mean())
    assert np.allclose(out.upper - out.fit, band) and np.allclose(out.fit - out.lower, band)


def test_a_given_penalty_is_in_units_of_x(spark, rows):
    x, y = rows
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    _, _, curve = dense(x, y, 0.3)
    out = splines.spline(frame, 0.3, 11).toPandas()
    assert np.allclose(out.fit, curve(out.x.to_numpy()), atol=1e-7)


def test_blocks_of_one_knot_and_the_fewest_knots(spark):
    four = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (4.0, 2.0), (6.0, 5.0)], "x double, y double")
    _, _, curve = dense(np.array([0.0, 1, 4, 6]), np.array([1.0, 3, 2, 5]), 2.0)
    out = splines.spline(four, 2.0, block=1).orderBy("x").toPandas()
    assert len(out) == 200 and np.allclose(out.fit, curve(out.x.to_numpy()))


def test_rows_that_are_not_finite_are_left_out(spark):
    line = [(float(k), 2.0 * k + 1) for k in range(10)]
    odd = [(None, 1.0), (3.0, None), (float("nan"), 1.0), (2.0, float("nan")), (float("inf"), 0.0), (5.0, float("-inf"))]
    out = splines.spline(spark.createDataFrame(line + line[:3] + odd, "x double, y double")).toPandas()
    assert len(out) == 200 and np.allclose(out.fit, 2 * out.x + 1) and out.x.max() == 9.0
    for few in (line[:3] * 2, odd, []):
        with pytest.raises(ValueError):
            splines.spline(spark.createDataFrame(few, "x double, y double"))


def in_sequence(u, y, penalty):
    """Smoothed values by a filter forth and a pass back, knot by knot; the first two knots stand for the flat start."""
    n = len(u)
    # the first state is known but for noise so large that it says nothing
    mean, cov = np.array([y[0], 0.0]), np.diag([1.0, 1e8])
    means, covs, ahead = [mean], [cov], [None]
    for k in range(1, n):
        h = u[k] - u[k - 1]
        f = np.array([[1, h], [0, 1]])
        q = np.array([[h**3 / 3, h**2 / 2], [h**2 / 2, h]]) / penalty
        m, p = f @ mean, f @ cov @ f.T + q
        gain = p[:, 0] / (p[0, 0] + 1)
        mean, cov = m + gain * (y[k] - m[0]), p - np.outer(gain, p[0])
        means.append(mean), covs.append(cov), ahead.append((f, m, p))
    out = [means[-1]]
    for k in range(n - 2, -1, -1):
        f, m, p = ahead[k + 1]
        out.append(means[k] + covs[k] @ f.T @ np.linalg.solve(p, out[-1] - m))
    return np.array(out[::-1])[:, 0]


def test_a_long_curve_equals_a_filter_knot_by_knot(spark):
    n = 60_000
    frame = spark.range(n).selectExpr(f"id / {n}D AS x", f"sin(12 * id / {n}D) + (rand(3) - 0.5) AS y").persist()
    chain = splines.Chain(frame, 8192)
    tried = splines.PENALTIES[::6]
    scores = chain.scores(tried)
    best = int(np.argmin([s for s, _ in scores]))
    assert scores[best][1] == pytest.approx(12**-0.5, rel=0.02)  # the spread of the noise
    out = chain.curve(float(tried[best]), n, 1.0).orderBy("x").toPandas()
    given = frame.orderBy("x").toPandas()
    assert len(out) == n and np.allclose(out.x, given.x)
    assert np.abs(out.fit - in_sequence(given.x.to_numpy() / given.x.max(), given.y.to_numpy(), tried[best])).max() < 1e-6
    assert np.sqrt(((out.fit - np.sin(12 * out.x)) ** 2).mean()) < 0.02
