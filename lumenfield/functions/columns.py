"""Scalar building blocks as Column expressions: kernels, filters, grids and transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Kernels by name, as functions of t >= 0 and whether they vanish from 1 on.
KERNELS = {
    "epanechnikov": (lambda t: 1 - t * t, True),
    "triangular": (lambda t: 1 - t, True),
    "tr_exponential": (lambda t: (1 - t) * F.exp(-t), True),
    "laplace": (lambda t: 0.5 * F.exp(-F.abs(t)), False),
    "normal": (lambda t: 0.3989423 * F.exp(-t * t / 2), False),
    "biweight": (lambda t: (1 - t * t) * (1 - t * t), True),
    "tricube": (lambda t: (1 - t * t * t) * (1 - t * t * t) * (1 - t * t * t), True),
    "cosine": (lambda t: F.cos(math.pi * t / 2), True),
    "hyperbolic": (lambda t: F.when(t == 0, 1.7976931348623157e308).otherwise(1 / F.abs(t)), False),
    "constant": (lambda t: F.lit(1.0), False),
}

#: Spectral low-pass filters by name, as functions of the eigenvalue and eta.
FILTERS = {
    "heat_kernel": lambda lam, eta: F.exp(-eta * lam),
    "tikhonov": lambda lam, eta: 1 / (1 + eta * lam),
    "cubic_spline": lambda lam, eta: 1 / (1 + eta * lam * lam),
    "gaussian": lambda lam, eta: F.exp(-eta * lam * lam),
    "exponential": lambda lam, eta: F.exp(-eta * F.sqrt(F.greatest(lam, F.lit(0.0)))),
    "butterworth": lambda lam, eta: 1 / (1 + F.pow(lam / eta, 4)),
}


def kernel(name: str, t: Column, scale: float = 1.0) -> Column:
    f, compact = KERNELS[name]
    value = f(t / scale)
    return F.when(t / scale >= 1, 0.0).otherwise(value) if compact else value


def kernel_with_stop(name: str, x: Column, bandwidth: float) -> Column:
    """struct<w, stop> for an ascending array: weights up to the first that vanishes, and the place of the last that does not.

    For compact kernels; stop is -1 if the first weight vanishes, and the last place if none does.
    """
    inside = F.filter(x, lambda t: F.abs(t / bandwidth) < 1)
    # the array ascends from zero, so that what lies inside comes first
    w = F.transform(x, lambda t: kernel(name, F.abs(t), bandwidth))
    return F.struct(w.alias("w"), (F.size(inside) - 1).alias("stop"))


def spectral_filter(name: str, lam: Column, eta: Column) -> Column:
    return FILTERS[name](lam, eta)


def power(x: Column, p: float) -> Column:
    """Elementwise x^p of a non-negative array, p in (0, 1]."""
    if not 0 < p <= 1:
        raise ValueError("p must lie in (0, 1]")
    return F.transform(x, lambda v: F.pow(v, F.lit(p)))


def l1(x: Column) -> Column:
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return F.transform(x, lambda v: v / total)


def box_cox(y: Column, lam: float) -> Column:
    return F.log(y) if abs(lam) < 1e-8 else (F.pow(y, F.lit(lam)) - 1) / lam


def clip_open(value: Column, n: int) -> Column:
    """Into [e, 1 - e] with e = max(1e-6, 0.5 / n), for logarithms."""
    e = max(1e-6, 0.5 / n)
    return F.least(F.greatest(value, F.lit(e)), F.lit(1 - e))


def bounded_slope(kind: str, x: Column) -> Column:
    """Sigmoids onto (-1, 1)."""
    return {"tanh": F.tanh(x), "arctan": 2 / math.pi * F.atan(x), "algebraic": x / F.sqrt(1 + x * x)}[kind]


def eta_grid_fit(largest: float, name: str = "heat_kernel", count: int = 40) -> list[float]:
    """Log-spaced from 1e-10 (exclusive) to where the filter has all but vanished."""
    top = -math.log(1e-10) / largest if name in ("heat_kernel", "gaussian", "exponential") else 1e10
    lo, hi = math.log(1e-10), math.log(top)
    return [math.exp(lo + (hi - lo) * (t + 1) / count) for t in range(count)]


def eta_grid_fit_of(largest: Column, name: str = "heat_kernel", count: int = 40) -> Column:
    """The same grid for a column of largest eigenvalues, as an array."""
    top = -math.log(1e-10) / largest if name in ("heat_kernel", "gaussian", "exponential") else F.lit(1e10)
    lo = F.lit(math.log(1e-10))
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda t: F.exp(lo + (F.log(top) - lo) * t / count))


def eta_grid_refit_of(least: Column, largest: Column, count: int = 40) -> Column:
    """The refit's grid for columns of the least positive and the largest eigenvalue, as an array."""
    count = max(5, count)
    lo, hi = F.log(F.greatest(F.lit(1e-6), 1 / largest)), F.log(1 / least)
    flat = lambda t: 1e-3 + (1 - 1e-3) * t / (count - 1)
    known = least.isNotNull() & (least > 1e-12) & (largest > least)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda t: F.when(known, F.exp(lo + (hi - lo) * t / (count - 1))).otherwise(flat(t)))


def eta_grid_refit(eigenvalues: list[float], count: int = 40) -> list[float]:
    """Log-spaced from 1 / largest to 1 / smallest positive eigenvalue."""
    positive = [v for v in eigenvalues if v > 1e-12]
    count = max(5, count)
    if not positive or max(positive) <= min(positive):
        return [1e-3 + (1 - 1e-3) * t / (count - 1) for t in range(count)]
    lo, hi = math.log(max(1e-6, 1 / max(positive))), math.log(1 / min(positive))
    return [math.exp(lo + (hi - lo) * t / (count - 1)) for t in range(count)]


def uniform(*parts: Column) -> Column:
    """A reproducible number in [0, 1) from the md5 of its parts joined by a colon."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
