"""Mean-shift denoising of points towards the ridges of their density. One step is joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenfield.functions import orders
from lumenfield.functions.columns import kernel

from . import graph
from .spectral import _checkpointed

#: Methods: neighbours anew each step, averaged directions, own step sizes with momentum.
METHODS = {"basic": (False, False, False), "grad_field": (False, True, False), "adaptive": (False, True, True), "knn_adaptive_grad": (True, True, False), "adaptive_momentum": (True, True, True)}


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _unit(v: Column) -> Column:
    n = F.sqrt(_dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def _mean(rows: DataFrame, by: str, vector: str, weight: str, d: int, name: str) -> DataFrame:
    """Weighted mean vector by key; sums combine before the shuffle."""
    low = F.sum(weight)
    low = F.when(low > 0, low).otherwise(1e-12)
    return rows.groupBy(by).agg(F.array(*[F.sum(F.col(weight) * F.col(vector)[i]) / low for i in range(d)]).alias(name))


def neighbour_weights(near: DataFrame, name: str = "epanechnikov", factor: float = 1.01) -> DataFrame:
    """(vertex, nbr, w): kernel of the distance over the largest of the vertex, itself left out."""
    others = near.where("rank > 0")
    top = others.groupBy("vertex").agg(F.max("dist").alias("top"))
    t = F.col("dist") / (F.when(F.col("top") == 0, 1.0).otherwise(F.col("top")) * factor)
    return others.join(top, "vertex").select("vertex", "nbr", kernel(name, t).alias("w"))


def directions(points: DataFrame, weights: DataFrame, d: int) -> DataFrame:
    """(vertex, g): unit vector from each point to its neighbours' weighted mean."""
    far = weights.join(points.select(F.col("vertex").alias("nbr"), F.col("x").alias("xn")), "nbr")
    mean = _mean(far, "vertex", "xn", "w", d, "m")
    return points.join(mean, "vertex").select("vertex", "x", _unit(F.zip_with("m", "x", lambda m, x: m - x)).alias("g"))


def averaged(field: DataFrame, weights: DataFrame, d: int) -> DataFrame:
    """(vertex, x, g): directions averaged over neighbours; the own one where they cancel."""
    far = weights.join(field.select(F.col("vertex").alias("nbr"), F.col("g").alias("gn")), "nbr")
    mean = _mean(far, "vertex", "gn", "w", d, "m")
    u = _unit(F.col("m"))
    return field.join(mean, "vertex").select("vertex", "x", F.when(_dot(F.col("m"), F.col("m")) > 0, u).otherwise(F.col("g")).alias("g"))


def magnitudes(field: DataFrame, anchor: DataFrame, weights: DataFrame) -> DataFrame:
    """(vertex, size): weighted mean of the absolute projections of neighbours' offsets on the direction."""
    near = weights.join(field.select("vertex", "g"), "vertex").join(anchor.select("vertex", F.col("x").alias("xo")), "vertex")
    near = near.join(anchor.select(F.col("vertex").alias("nbr"), F.col("x").alias("xn")), "nbr")
    along = F.abs(_dot(F.zip_with("xn", "xo", lambda a, b: a - b), F.col("g")))
    low = F.sum("w")
    return near.groupBy("vertex").agg((F.sum(F.col("w") * along) / F.when(low > 0, low).otherwise(1e-12)).alias("size"))


def step(points: DataFrame, weights: DataFrame, size: float = 0.1, average: bool = False) -> DataFrame:
    """(vertex, x) after one step with fixed neighbours."""
    d = len(points.first().x)
    field = directions(points, weights, d)
    if average:
        field = averaged(field, weights, d)
    moved = field.join(magnitudes(field, points, weights), "vertex")
    return moved.select("vertex", F.zip_with("x", "g", lambda x, g: x + g * F.lit(size) * F.col("size")).alias("x"))


def median_kdistance(points: DataFrame, k: int) -> float:
    """Median distance to the k-th neighbour, the point itself counting as the first."""
    return orders.median(graph.knn(points, k).where(F.col("rank") == k - 1), "dist")


def smooth(
    points: DataFrame, k: int = 5, density_k: int | None = None, steps: int = 5, size: float = 0.1, method: str = "basic", kernel_name: str = "epanechnikov",
    increase: float = 1.2, decrease: float = 0.5, momentum: float = 0.9,
) -> tuple[DataFrame, list[float]]:
    """(trajectory(step, vertex, x), median k-distance of every step). Fixed-neighbour adaptive steps aim at the original points."""
    again, average, adaptive = METHODS[method]
    density_k = density_k or k
    d = len(points.first().x)
    origin = now = _checkpointed(points.select("vertex", "x"))

    def measured(now: DataFrame) -> tuple[DataFrame, float]:
        """Neighbours, which serve both the weights and the median k-distance."""
        near = _checkpointed(graph.knn(now, max(k + 1, density_k)))
        return near, orders.median(near.where(F.col("rank") == density_k - 1), "dist")

    near, median = measured(now)
    weights = _checkpointed(neighbour_weights(near.where(F.col("rank") <= k), kernel_name))
    out, medians = now.withColumn("step", F.lit(0)), [median]
    state = now.select("vertex", F.lit(size).alias("s"), F.array(*[F.lit(0.0)] * d).alias("before"))
    for t in range(1, steps + 1):
        if again and t > 1:
            weights = _checkpointed(neighbour_weights(near.where(F.col("rank") <= k), kernel_name))
        if adaptive and not again:
            far = weights.join(origin.select(F.col("vertex").alias("nbr"), F.col("x").alias("xn")), "nbr")
            field = now.join(_mean(far, "vertex", "xn", "w", d, "m"), "vertex").select("vertex", "x", _unit(F.zip_with("m", "x", lambda m, x: m - x)).alias("g"))
        else:
            field = directions(now, weights, d)
        if average:
            field = averaged(field, weights, d)
        moved = field.join(magnitudes(field, origin if adaptive and not again else now, weights), "vertex").join(state, "vertex")
        if adaptive:
            moved = moved.withColumn("s", F.col("s") * F.when(_dot(F.col("g"), F.col("before")) > 0, increase).otherwise(decrease))
            moved = moved.withColumn("before", F.zip_with("before", "g", lambda b, g: momentum * b + (1 - momentum) * g))
        moved = _checkpointed(moved.select("vertex", F.zip_with("x", "g", lambda x, g: x + g * F.col("s") * F.col("size")).alias("x"), "s", "before"))
        now, state = moved.select("vertex", "x"), moved.select("vertex", "s", "before")
        out = out.unionByName(now.withColumn("step", F.lit(t)))
        near, median = measured(now)
        medians.append(median)
    return out, medians


def chosen_step(medians: list[float]) -> int:
    """The step whose median k-distance is least, the start left out; the first on ties, and the start if there is no other."""
    return min(range(1, len(medians)), key=lambda t: (medians[t], t)) if len(medians) > 1 else 0


def denoised(points: DataFrame, **options) -> tuple[DataFrame, int]:
    """(points (vertex, x) at the chosen step, that step) of a trajectory by ``smooth``."""
    path, medians = smooth(points, **options)
    step = chosen_step(medians)
    return path.where(F.col("step") == step).select("vertex", "x"), step
