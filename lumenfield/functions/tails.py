"""Tails of distributions and tests on rows of numbers, in numpy: each row of a matrix is a sample of its own."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_lgamma = math.lgamma


def normal_upper(z: np.ndarray) -> np.ndarray:
    """P(Z > z)."""
    z = np.asarray(z, float)
    return np.array([math.erfc(v) / 2 for v in (z / math.sqrt(2)).ravel().tolist()]).reshape(z.shape)


def incomplete_beta(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that settles fast."""
    x = np.asarray(x, float)
    out = np.empty_like(x)
    for swap in (False, True):
        here = (x > (a + 1) / (a + b + 2)) == swap
        p, q, t = (b, a, 1 - x[here]) if swap else (a, b, x[here])
        tiny = 1e-300
        c, d = np.ones_like(t), 1 - (p + q) * t / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for step in (m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))):
                d, c = 1 + step * d, 1 + step / c
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = np.where(np.abs(c) < tiny, tiny, c)
                h *= d * c
            if not len(t) or np.abs(d * c - 1).max() < 1e-15:
                break
        with np.errstate(divide="ignore"):
            front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(t) + q * np.log1p(-t)) / p
        value = np.where(t <= 0, 0.0, front * h)
        out[here] = 1 - value if swap else value
    return out


def student_two_sided(t: np.ndarray, df: float) -> np.ndarray:
    t = np.asarray(t, float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_test(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(t, two-sided p) of the mean of each row against 0."""
    n = rows.shape[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = rows.mean(1) / (rows.std(1, ddof=1) / math.sqrt(n))
    return t, np.where(np.isnan(t), np.nan, student_two_sided(np.nan_to_num(t), n - 1))


#: Royston's polynomials (1995, AS R94), lowest power first.
_A1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_A2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN, _SMALL_SD = (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN, _LARGE_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
_EDGE = (-2.273, 0.459)


def _poly(c: tuple[float, ...], x: float) -> float:
    return sum(v * x**k for k, v in enumerate(c))


def _shapiro_weights(n: int) -> np.ndarray:
    """Weights of the ordered sample, antisymmetric."""
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    total, root = float(m @ m), 1 / math.sqrt(n)
    out = np.zeros(n)
    ends = [_poly(_A1, root) + m[-1] / math.sqrt(total)]
    if n > 5:
        ends.append(_poly(_A2, root) + m[-2] / math.sqrt(total))
    k = len(ends)
    rest = (total - 2 * sum(m[-1 - i] ** 2 for i in range(k))) / (1 - 2 * sum(e * e for e in ends))
    out[k : n - k] = m[k : n - k] / math.sqrt(rest)
    for i, e in enumerate(ends):
        out[n - 1 - i], out[i] = e, -e
    return out


def shapiro_wilk(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(W, p) of each row, for 3 to 5000 numbers; nan where all are equal."""
    n = rows.shape[1]
    if not 3 <= n <= 5000:
        return np.full(len(rows), np.nan), np.full(len(rows), np.nan)
    x = np.sort(rows, 1)
    spread = ((x - x.mean(1, keepdims=True)) ** 2).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.minimum((x @ _shapiro_weights(n)) ** 2 / spread, 1.0)
    w = np.where(spread > 0, w, np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        if n == 3:
            return w, np.maximum(6 / math.pi * (np.arcsin(np.sqrt(w)) - math.asin(math.sqrt(0.75))), 0)
        y = np.log1p(-w)
        if n <= 11:
            edge = _poly(_EDGE, n)
            z = (-np.log(edge - y) - _poly(_SMALL_MEAN, n)) / math.exp(_poly(_SMALL_SD, n))
            z = np.where(y >= edge, np.inf, z)
        else:
            z = (y - _poly(_LARGE_MEAN, math.log(n))) / math.exp(_poly(_LARGE_SD, math.log(n)))
    return w, np.where(np.isnan(w), np.nan, normal_upper(np.nan_to_num(z, nan=0.0, posinf=40.0, neginf=-40.0)))


def _signed_rank_shares(n: int) -> np.ndarray:
    """P(V <= v) of the signed-rank sum of n numbers: subsets of the ranks are counted by their sums."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] += ways[:-r].copy()
    return np.cumsum(ways) / 2.0**n


def wilcoxon(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(V, two-sided p) of the signed ranks of each row: exact for fewer than 50 numbers without zeros and ties,
    else by the normal distribution with corrections for ties and continuity. Zeros are left out; nan if all are."""
    stat, p = np.full(len(rows), np.nan), np.full(len(rows), np.nan)
    exact: dict[int, np.ndarray] = {}
    for k, row in enumerate(rows):
        x = row[row != 0]
        n = len(x)
        if not n:
            continue
        _, at, count = np.unique(np.abs(x), return_inverse=True, return_counts=True)
        rank = (np.cumsum(count) - (count - 1) / 2)[at]
        v = stat[k] = float(rank[x > 0].sum())
        middle = n * (n + 1) / 4
        if n < 50 and len(count) == n and n == len(row):
            below = exact.setdefault(n, exact[n] if n in exact else _signed_rank_shares(n))
            one = 1 - below[int(v) - 1] if v > middle else below[int(v)]
            p[k] = min(2 * one, 1.0)
        else:
            sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - float((count.astype(float) ** 3 - count).sum()) / 48)
            z = (v - middle - 0.5 * np.sign(v - middle)) / sd if sd else 0.0
            p[k] = min(2 * float(normal_upper(np.array(abs(z)))), 1.0)
    return stat, p


def box_cox_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transformed, lambda, shift): rows moved above 0 where need be, each by its most likely power.

    A grid from -2 to 2 by 0.1, then golden sections around its best; all rows at once.
    """
    low = rows.min(1)
    shift = np.where(low <= 0, np.abs(low) + 0.01 * rows.std(1, ddof=1), 0.0)
    x = rows + shift[:, None]
    logs = np.log(x)
    total = logs.sum(1)

    def power(lam: np.ndarray) -> np.ndarray:
        safe = np.where(np.abs(lam) < 1e-8, 1.0, lam)[:, None]
        return np.where(np.abs(lam)[:, None] < 1e-8, logs, np.expm1(safe * logs) / safe)

    def likelihood(lam: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return -x.shape[1] / 2 * np.log(power(lam).var(1)) + (lam - 1) * total

    grid = np.arange(-20, 21) / 10
    best = grid[np.argmax([likelihood(np.full(len(x), g)) for g in grid], 0)]
    lo, hi, g = best - 0.1, best + 0.1, (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = likelihood(a), likelihood(b)
    while (hi - lo).max(initial=0) > 1e-4:
        left = fa > fb
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
        new = np.where(left, hi - g * (hi - lo), lo + g * (hi - lo))
        value = likelihood(new)
        a, b, fa, fb = np.where(left, new, b), np.where(left, a, new), np.where(left, value, fb), np.where(left, fa, value)
    lam = (lo + hi) / 2
    return power(lam), lam, shift
