"""Synthetic points with a known truth: (vertex, x, y_true, y). All random numbers are hashes of seed, vertex and part."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenfield.functions.columns import uniform


def normal(seed: int, part: str) -> Column:
    """Box and Muller."""
    u = lambda p: uniform(F.lit(seed), F.col("vertex"), F.lit(f"{part}{p}"))
    return F.sqrt(-2 * F.log(1 - u("r"))) * F.cos(2 * math.pi * u("a"))


def bumps(x: Column, centres: list[float], heights: list[float], sds: list[float]) -> Column:
    """A sum of Gaussian bumps."""
    out = F.lit(0.0)
    for c, h, s in zip(centres, heights, sds):
        out = out + h * F.exp(-0.5 * F.pow((x - c) / s, F.lit(2.0)))
    return out


def _vertices(of: DataFrame | SparkSession, n: int | None) -> DataFrame:
    """The given vertices, or ``n`` of them numbered from 0."""
    return of.select("vertex") if isinstance(of, DataFrame) else of.range(n).withColumnRenamed("id", "vertex")


def mixture(of: DataFrame | SparkSession, n: int | None = None, noise: float = 0.35, seed: int = 1) -> DataFrame:
    """Points on [0, 1] in order, three bumps."""
    rows = _vertices(of, n)
    x = F.col("vertex") / F.lit(float(max(rows.agg(F.max("vertex")).first()[0] or 1, 1)))
    truth = bumps(x, [0.2, 0.5, 0.8], [1.0, -0.8, 1.2], [0.06, 0.08, 0.05])
    return rows.select("vertex", F.array(x).alias("x"), truth.alias("y_true"), (truth + noise * normal(seed, "y")).alias("y"))


def circle(of: DataFrame | SparkSession, n: int | None = None, noise: float = 0.05, response_noise: float = 0.1, gap: float = 0.0, dims: int = 2, seed: int = 1) -> DataFrame:
    """A noisy circle of radius 1, without an arc of the share ``gap``, in ``dims`` dimensions; the truth is two bumps by angle."""
    theta = 2 * math.pi * (1 - gap) * uniform(F.lit(seed), F.col("vertex"), F.lit("theta"))
    rows = _vertices(of, n).withColumn("theta", theta)
    x = [F.cos("theta"), F.sin("theta"), *[F.lit(0.0)] * (dims - 2)]
    truth = bumps(F.col("theta"), [1.5, 4.0], [1.0, -1.0], [0.5, 0.7])
    moved = F.array(*[c + noise * normal(seed, f"x{k}") for k, c in enumerate(x)])
    return rows.select("vertex", moved.alias("x"), truth.alias("y_true"), (truth + response_noise * normal(seed, "y")).alias("y"))


def branches(of: DataFrame | SparkSession, n: int | None = None, noise: float = 0.025, response_noise: float = 0.09, seed: int = 1) -> DataFrame:
    """Three arms that meet in the origin, dealt in turn; the truth grows along one and falls along another."""
    t, arm = uniform(F.lit(seed), F.col("vertex"), F.lit("t")), F.col("vertex") % 3
    dx = F.when(arm == 0, 0.0).when(arm == 1, -0.85).otherwise(0.85)
    dy = F.when(arm == 0, -1.0).otherwise(0.85)
    truth = F.when(arm == 1, t).when(arm == 2, -t).otherwise(0.0)
    x = F.array(dx * t + noise * normal(seed, "x0"), dy * t + noise * normal(seed, "x1"))
    return _vertices(of, n).select("vertex", x.alias("x"), truth.alias("y_true"), (truth + response_noise * normal(seed, "y")).alias("y"))
