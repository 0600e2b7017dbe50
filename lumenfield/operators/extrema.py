"""Extrema of a function on a graph, and who is around a vertex."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lumenfield.sources.tables import checkpointed

from . import bits, members, spectral
from .graph import carried, directed, numbered, ranged, running


def local_extrema(y: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, vertex, value, type, hop_idx): not below, or not above, every neighbour; isolated ones are both."""
    around = directed(edges).join(y.select(F.col("vertex").alias("nbr"), F.col("y").alias("yn")), "nbr").groupBy("vertex").agg(F.max("yn").alias("hi"), F.min("yn").alias("lo"))
    rows = y.join(around, "vertex", "left")
    top, low = y.agg(F.max("y"), F.min("y")).first()
    out = None
    for kind, prefix, test, best in (("max", "M", F.col("hi").isNull() | (F.col("y") >= F.col("hi")), top), ("min", "m", F.col("lo").isNull() | (F.col("y") <= F.col("lo")), low)):
        found = numbered(rows.where(test).select("vertex", "y"), ["vertex"], "r")
        found = found.select(F.concat(F.lit(prefix), F.col("r")).alias("label"), "vertex", F.col("y").alias("value"), F.lit(kind).alias("type"), F.when(F.col("y") == best, float("inf")).otherwise(1.0).alias("hop_idx"))
        out = found if out is None else out.unionByName(found)
    return out


def extremp(y: DataFrame, edges: DataFrame, rho: DataFrame) -> DataFrame:
    """(vertex, maxp, minp): density share of the neighbours strictly below and above; null without neighbours."""
    near = directed(edges).join(y.join(rho, "vertex").select(F.col("vertex").alias("nbr"), F.col("y").alias("yn"), "rho"), "nbr").join(y, "vertex")
    total = F.sum("rho")
    share = lambda test: F.when(total >= 2.220446049250313e-16, F.sum(F.when(test, F.col("rho")).otherwise(0.0)) / total)
    found = near.groupBy("vertex").agg(share(F.col("y") > F.col("yn")).alias("maxp"), share(F.col("y") < F.col("yn")).alias("minp"))
    return y.select("vertex").join(found, "vertex", "left")


def hop_radius(y: DataFrame, edges: DataFrame, rho: DataFrame, p: float = 0.95, max_hop: int = 30, maxima: bool = True) -> DataFrame:
    """(vertex, radius) of strict local extrema: hops up to which at least the share p of the density is beyond them.

    Global extrema get -1, other vertices 0. The frontiers of all extrema grow together, a hop a round, 64 to a word of bits:
    a row for each vertex and word that was reached. A frontier ends where its share does not hold.
    """
    sign = 1.0 if maxima else -1.0
    f = checkpointed(y.select("vertex", (F.col("y") * sign).alias("f")).join(rho, "vertex"))
    best, low = f.agg(F.max("f"), F.min("f")).first()
    eps = 1e-14 * max(abs(best), abs(low))
    d = directed(edges)
    at = f.select(F.col("vertex").alias("nbr"), F.col("f").alias("fn"), F.col("rho").alias("rn"))
    high = d.join(at, "nbr").groupBy("vertex").agg(F.max("fn").alias("hi"))
    kind = f.join(high, "vertex", "left").select("vertex", "f", F.when(F.abs(F.col("f") - best) <= eps, "global").when(F.col("hi").isNull() | (F.col("f") > F.col("hi")), "strict").otherwise("none").alias("kind"))
    kind = checkpointed(kind)
    source = bits.placed(kind.where("kind = 'strict'").select(F.col("vertex").alias("source"), F.col("f").alias("fs")))
    # the heights of a word's sources by bit
    heights = checkpointed(source.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("bit", "fs"))).alias("m")))
    heights = heights.select("word", F.transform(F.sequence(F.lit(0), F.lit(bits.WIDTH - 1)), lambda k: F.element_at("m", k)).alias("fs"))
    reached = frontier = bits.started(source)
    totals = source.select("word", "bit", F.lit(0.0).alias("total"), F.lit(0.0).alias("good"))
    radius, active = source.select("source", "word", "bit", F.lit(0).alias("radius")), source
    for hop in range(1, max_hop + 1):
        held = reached.select("vertex", "word", F.col("bits").alias("held"))
        new = bits.spread(frontier, d).join(held, ["vertex", "word"], "left")
        new = checkpointed(new.select("vertex", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("held", F.lit(0).cast("long")))).alias("bits")).where("bits != 0"))
        seen = new.join(f.select("vertex", F.col("f").alias("limit"), "rho"), "vertex").join(heights, "word")
        gain = bits.sums(seen, {"t": F.col("rho"), "g": (F.col("rho"), F.col("fs"))}).withColumn("n", F.lit(True))
        # a source whose frontier is used up keeps its share and stops after one more hop that the last share passes
        state = totals.join(active.select("word", "bit"), ["word", "bit"]).join(gain, ["word", "bit"], "left")
        state = state.select("word", "bit", (F.col("total") + F.coalesce("t", F.lit(0.0))).alias("total"), (F.col("good") + F.coalesce("g", F.lit(0.0))).alias("good"), F.coalesce("n", F.lit(False)).alias("n"))
        state = checkpointed(state.withColumn("ok", (F.col("total") >= 2.220446049250313e-16) & (F.col("good") / F.col("total") >= p)))
        radius = checkpointed(radius.join(state.where("ok").select("word", "bit", F.lit(hop).alias("now")), ["word", "bit"], "left").select("source", "word", "bit", F.coalesce("now", "radius").alias("radius")))
        active = state.where("ok and n").select("word", "bit")
        if active.isEmpty():
            break
        mask = bits.masks(active)
        only = lambda rows: rows.join(mask, "word").select("vertex", "word", F.col("bits").bitwiseAND(F.col("mask")).alias("bits")).where("bits != 0")
        frontier = only(new)
        reached = checkpointed(only(reached.unionByName(new)).groupBy("vertex", "word").agg(F.bit_or("bits").alias("bits")))
        totals = state.select("word", "bit", "total", "good")
    out = kind.join(radius.select(F.col("source").alias("vertex"), "radius"), "vertex", "left")
    return out.select("vertex", F.when(F.col("kind") == "global", -1).otherwise(F.coalesce("radius", F.lit(0))).alias("radius"))


def coboundary(y: DataFrame, vertex_rho: DataFrame, edge_rho: DataFrame) -> DataFrame:
    """(i, j, rho, delta): (m_j f_j - m_i f_i) / m_e for each edge, masses floored at 1e-15."""
    f = y.join(vertex_rho, "vertex").select("vertex", (F.greatest("rho", F.lit(1e-15)) * F.col("y")).alias("mf"))
    e = edge_rho.join(f.select(F.col("vertex").alias("i"), F.col("mf").alias("fi")), "i").join(f.select(F.col("vertex").alias("j"), F.col("mf").alias("fj")), "j")
    return e.select("i", "j", "rho", ((F.col("fj") - F.col("fi")) / F.greatest("rho", F.lit(1e-15))).alias("delta"))


def coboundary_full(y: DataFrame, vertex_rho: DataFrame, mass: DataFrame, ridge: float = 1e-10, rounds: int | None = None) -> DataFrame:
    """(i, j, right, delta) with (M1 + ridge I) delta = right = B1' M0 y for edge masses (i, j, i2, j2, val), off the diagonal too.

    Masses between edges need not make a definite matrix: in neighbour graphs they often exceed the diagonal. Where it takes steps, they go on until
    the residual is small, or RuntimeError; only ``rounds`` ends them before, and a warning tells the residual.
    """
    edges = checkpointed(numbered(mass.where("i = i2 and j = j2").select("i", "j"), ["i", "j"], "e"))
    right = checkpointed(_right(edges, y, vertex_rho).select("i", "j", F.col("e").alias("vertex"), F.col("right").alias("x")))
    second = edges.select(F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("e").alias("e2"))
    matrix = mass.join(edges, ["i", "j"]).join(second, ["i2", "j2"]).groupBy(F.col("e").alias("i"), F.col("e2").alias("j")).agg(F.sum("val").alias("val"))
    found, residual = spectral.least_residual(checkpointed(matrix), right.select("vertex", "x"), ridge, rounds=rounds)
    _told(residual)
    return right.withColumnRenamed("x", "right").join(found.withColumnRenamed("x", "delta"), "vertex").select("i", "j", "right", "delta")


def _right(edges: DataFrame, y: DataFrame, vertex_rho: DataFrame) -> DataFrame:
    """``edges`` with right: the change of mass times response along each."""
    f = y.join(vertex_rho, "vertex").select("vertex", (F.greatest("rho", F.lit(1e-15)) * F.col("y")).alias("mf"))
    both = edges.join(f.select(F.col("vertex").alias("i"), F.col("mf").alias("fi")), "i").join(f.select(F.col("vertex").alias("j"), F.col("mf").alias("fj")), "j")
    return both.select(*edges.columns, (F.col("fj") - F.col("fi")).alias("right"))


def _told(residual: float) -> None:
    if residual > 1e-6:
        warnings.warn(f"the coboundary's equation has a residual of {residual:.3g} of its right side")


def coboundary_by_members(y: DataFrame, vertex_rho: DataFrame, edge_rho: DataFrame, common: DataFrame, ridge: float = 1e-10, rounds: int | None = None) -> DataFrame:
    """``coboundary_full`` for masses that ``members.edge_members`` gives as sums over members (i, j, member, rho), whose triangles are never made.

    One kernel up to spectral.ENTRIES; beyond, products are joins, in as many steps as the same residual needs.
    """
    edges = checkpointed(_right(edge_rho.select("i", "j", F.greatest("rho", F.lit(1e-15)).alias("d")), y, vertex_rho))
    if 2 * common.count() <= spectral.ENTRIES and edges.count() <= spectral.ENTRIES // 2:
        got, pairs = edges.toArrow(), common.select("i", "j", "member", "rho").toArrow()
        i, j, d, right = (got.column(c).to_numpy() for c in ("i", "j", "d", "right"))
        pi, pj, member, rho = (pairs.column(c).to_numpy() for c in ("i", "j", "member", "rho"))
        ends = np.unique(np.r_[i, j])
        key = lambda a, b: np.searchsorted(ends, a) * len(ends) + np.searchsorted(ends, b)
        order = np.argsort(key(i, j))
        i, j, d, right = i[order], j[order], d[order], right[order]
        kernel = members.Members.of(d + ridge, np.searchsorted(key(i, j), key(pi, pj)), pi, pj, member, rho)
        delta, residual = kernel.solve(right)
        _told(residual)
        return checkpointed(y.sparkSession.createDataFrame(pa.table({"i": i, "j": j, "right": right, "delta": delta})))
    both, edge = F.struct("i", "j").alias("vertex"), ["vertex.i", "vertex.j"]
    product = lambda x: members.times(edges, common, x.select(*edge, "x")).select(both, "x")
    found, residual = spectral.least_residual(None, edges.select(both, F.col("right").alias("x")), ridge, rounds=rounds, product=product)
    _told(residual)
    return edges.select("i", "j", "right").join(found.select(*edge, F.col("x").alias("delta")), ["i", "j"])


def extremality(y: DataFrame, vertex_rho: DataFrame, edge_rho: DataFrame) -> DataFrame:
    """(vertex, score) in [-1, 1]; null where a vertex is isolated or nothing changes around it."""
    d = coboundary(y, vertex_rho, edge_rho).withColumn("m", F.greatest("rho", F.lit(1e-15)))
    both = d.select(F.col("i").alias("vertex"), "m", F.col("delta").alias("s")).unionByName(d.select(F.col("j").alias("vertex"), "m", (-F.col("delta")).alias("s")))
    low = F.sum(F.col("m") * F.abs("s"))
    found = both.groupBy("vertex").agg(F.when(low > 1e-15, -F.sum(F.col("m") * F.col("s")) / low).alias("score"))
    return y.select("vertex").join(found, "vertex", "left")


def subject_stats(subjects: DataFrame, edges: DataFrame, weights: DataFrame, include_self: bool = True) -> DataFrame:
    """Concentration of subjects around each vertex.

    subjects: (vertex, subject); weights: (vertex, nbr, conductance, mass_sym). A first aggregation
    by vertex and subject leaves few rows for the second.
    """
    d = directed(edges)
    own = subjects.select(F.col("vertex").alias("nbr"), "subject")
    near = d.join(own, "nbr")
    hat = near.select("vertex", "subject").unionByName(subjects.select("vertex", "subject")) if include_self else near.select("vertex", "subject")
    hat = hat.groupBy("vertex", "subject").agg(F.count("*").alias("n")).groupBy("vertex").agg(F.sum("n").alias("n_hat"), F.count("*").alias("n_subjects_hat"))
    by = weights.join(own, "nbr").groupBy("vertex", "subject").agg(F.count("*").alias("n"), F.sum("conductance").alias("c"), F.sum("mass_sym").alias("o"))
    stats = [F.sum("n").alias("n_neighbors")]
    for col, name in (("c", "conductance"), ("o", "operator")):
        total = F.sum(col)
        stats += [F.count("*").alias(f"n_subjects_{name}"), total.alias(f"weight_sum_{name}"), (F.max(col) / total).alias(f"p_max_{name}"), (total * total / F.sum(F.col(col) * F.col(col))).alias(f"s_eff_{name}")]
    out = subjects.select("vertex").join(hat, "vertex", "left").join(by.groupBy("vertex").agg(*stats), "vertex", "left")
    ratio = F.when(F.col("n_subjects_hat") > 0, F.col("n_hat") / F.col("n_subjects_hat"))
    out = out.fillna(0, ["n_hat", "n_subjects_hat", "n_neighbors", "n_subjects_conductance", "n_subjects_operator", "weight_sum_conductance", "weight_sum_operator"])
    return out.withColumn("R", ratio)


def significant(rows: DataFrame, value: str = "p_adjusted", level: float = 0.05) -> DataFrame:
    return rows.where(F.col(value) < level)


def bh_adjust(rows: DataFrame, p: str = "p_value", name: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg over the rows whose p value is not null; others get null.

    Only distinct p values are sorted, by ranges, with the number of rows up to each; the running minimum from
    the end is taken within ranges and over the least of the ranges after.
    """
    n = rows.where(F.col(p).isNotNull()).count()
    at = running(rows.where(F.col(p).isNotNull()).groupBy(p).count(), [p], F.col("count"), "_r")
    spread = ranged(at.select(p, F.least(F.lit(1.0), F.col(p) * n / F.col("_r")).alias("_q")), [p])
    low, later = 1.0, []
    for r in spread.groupBy("_p").agg(F.min("_q").alias("m")).orderBy(F.desc("_p")).collect():
        later.append((r[0], low))
        low = min(low, r[1])
    if not later:
        return rows.withColumn(name, F.lit(None).cast("double"))
    w = Window.partitionBy("_p").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    done = carried(spread, later, "_later", "double").select(p, F.least(F.min("_q").over(w), "_later").alias(name))
    return rows.join(done, p, "left")
