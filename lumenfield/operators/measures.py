"""Measures, densities and mass-symmetrised operators of a graph."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from lumenfield.functions.orders import at_ranks, order_statistic
from lumenfield.sources.tables import checkpointed

from .graph import directed, intersection

LEAST_DENSITY = 1e-8


def counting_measure(vertices: DataFrame, total: float | None = None) -> DataFrame:
    n = vertices.count()
    return vertices.select("vertex", F.lit((total or n) / n if n else 0.0).alias("w"))


def distance_measure(dk: DataFrame, alpha: float = 1.5, epsilon: float = 1e-10, clamp: float | None = None, ratio: float = 1000.0, total: float | None = None) -> DataFrame:
    """(vertex, w, dk_used, outside): weights (epsilon + d_k)^-alpha, compressed to a largest ratio, scaled to ``total``.

    ``clamp`` bounds d_k to [median / clamp, median * clamp], the median being the upper one; ``outside`` flags
    vertices beyond these bounds (factor 10 when not clamping).
    """
    median = order_statistic(dk, "dk", lambda n: n // 2)
    factor = clamp or 10.0
    low, high = median / factor, median * factor
    rows = dk.select("vertex", "dk", F.when(F.col("dk") < low, -1).when(F.col("dk") > high, 1).otherwise(0).alias("outside"))
    used = F.least(F.greatest("dk", low), high) if clamp else F.col("dk")
    rows = rows.withColumn("dk_used", used).withColumn("w", F.pow(F.col("dk_used") + epsilon, F.lit(-alpha)))
    rows = compress(rows, "w", ratio)
    n = rows.count()
    return rows.withColumn("w", F.col("w") * (total or n) / rows.agg(F.sum("w")).scalar())


def compress(df: DataFrame, value: str, ratio: float = 1000.0, pathological: float = 1e12) -> DataFrame:
    """Power compression to a largest ratio of weights; beyond 1e12 their log1p over the median comes first."""

    def spread(rows: DataFrame):
        lo, hi = rows.agg(F.min(value), F.max(value)).first()
        return math.inf if not lo else hi / lo

    r = spread(df)
    if not r > ratio:
        return df
    if not r <= pathological:
        median = order_statistic(df, value, lambda n: n // 2)
        df = df.withColumn(value, F.log1p(F.col(value) / median))
        r = spread(df)
    return df.withColumn(value, F.pow(F.col(value), F.lit(math.log(ratio) / math.log(r)))) if r > ratio else df


def normalised(df: DataFrame, raw: str, name: str = "rho") -> DataFrame:
    """Scales to the number of rows, lifts what is below 1e-8 at the others' cost, scales again.

    If the others have too little to give, everything is blended with 0.3 of the uniform density.
    Statistics are scalar aggregates, so no row moves.
    """
    n, total = df.agg(F.count("*"), F.sum(raw)).first()
    if not n:
        return df.withColumn(name, F.lit(0.0))
    value = F.col(raw) * (n / total) if total > 1e-15 else F.lit(1.0)
    rows = df.withColumn(name, value)
    low = F.col(name) < LEAST_DENSITY
    clamped, added, room = rows.agg(
        F.count_if(low), F.coalesce(F.sum(F.when(low, LEAST_DENSITY - F.col(name))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col(name) > LEAST_DENSITY, F.col(name) - LEAST_DENSITY)), F.lit(0.0))
    ).first()
    rows = rows.withColumn(name, F.greatest(F.col(name), F.lit(LEAST_DENSITY)))
    if added > 1e-10 and clamped < n:
        if room > added * 1.01:
            rows = rows.withColumn(name, F.lit(LEAST_DENSITY) + (F.col(name) - LEAST_DENSITY) * ((room - added) / room))
        else:
            rows = rows.withColumn(name, 0.7 * F.col(name) + 0.3)
    return rows.withColumn(name, F.col(name) * (n / rows.agg(F.sum(name)).first()[0]))


def normalised_by(df: DataFrame, by: str, raw: str, name: str = "rho") -> DataFrame:
    """``normalised`` within each group of ``by``; groups' totals are aggregates that join back."""
    low, up = F.col(name) < LEAST_DENSITY, F.col(name) > LEAST_DENSITY
    per = df.groupBy(by).agg(F.count("*").alias("_n"), F.sum(raw).alias("_t"))
    rows = df.join(per, by).withColumn(name, F.when(F.col("_t") > 1e-15, F.col(raw) * F.col("_n") / F.col("_t")).otherwise(1.0))
    nought = F.lit(0.0)
    ends = rows.groupBy(by).agg(F.count_if(low).alias("_c"), F.coalesce(F.sum(F.when(low, LEAST_DENSITY - F.col(name))), nought).alias("_a"), F.coalesce(F.sum(F.when(up, F.col(name) - LEAST_DENSITY)), nought).alias("_r"))
    lifted = F.greatest(F.col(name), F.lit(LEAST_DENSITY))
    moved = F.when(F.col("_r") > F.col("_a") * 1.01, F.lit(LEAST_DENSITY) + (lifted - LEAST_DENSITY) * ((F.col("_r") - F.col("_a")) / F.col("_r"))).otherwise(0.7 * lifted + 0.3)
    rows = checkpointed(rows.join(ends, by).withColumn(name, F.when((F.col("_a") > 1e-10) & (F.col("_c") < F.col("_n")), moved).otherwise(lifted)).drop("_t", "_c", "_a", "_r"))
    total = rows.groupBy(by).agg(F.sum(name).alias("_s"))
    return rows.join(total, by).withColumn(name, F.col(name) * F.col("_n") / F.col("_s")).drop("_n", "_s")


def vertex_density(sets: DataFrame, measure: DataFrame) -> DataFrame:
    """(vertex, rho): measure of each vertex's neighbour set."""
    raw = sets.join(measure.select(F.col("vertex").alias("member"), "w"), "member").groupBy("vertex").agg(F.sum("w").alias("raw"))
    return normalised(raw, "raw").select("vertex", "rho")


def edge_density(edges: DataFrame, sets: DataFrame, measure: DataFrame) -> DataFrame:
    """(i, j, isize, rho): measure of the common part of both ends' sets. With current vertex densities
    as the measure this is the update of an iteration."""
    return normalised(intersection(edges, sets, measure), "mass").select("i", "j", "isize", "rho")


def effective_degree(edge_rho: DataFrame) -> DataFrame:
    return directed(edge_rho, "rho").groupBy("vertex").agg(F.sum("rho").alias("effective_degree"))


def conductance(edge_rho: DataFrame) -> DataFrame:
    return edge_rho.select("i", "j", (1 / F.greatest(F.col("rho"), F.lit(1e-10))).alias("c"))


def laplacian(vertex_rho: DataFrame, edge_rho: DataFrame) -> DataFrame:
    """(i, j, val) of D^-1/2 (B C B') D^-1/2 with D the vertex masses; both triangles and the diagonal."""
    mass = vertex_rho.select("vertex", F.greatest("rho", F.lit(LEAST_DENSITY)).alias("m"))
    d = directed(conductance(edge_rho), "c")
    off = d.join(mass, "vertex").join(mass.select(F.col("vertex").alias("nbr"), F.col("m").alias("mn")), "nbr")
    off = off.select(F.col("vertex").alias("i"), F.col("nbr").alias("j"), (-F.col("c") / F.sqrt(F.col("m") * F.col("mn"))).alias("val"))
    degree = d.groupBy("vertex").agg(F.sum("c").alias("d"))
    diagonal = mass.join(degree, "vertex", "left").select(F.col("vertex").alias("i"), F.col("vertex").alias("j"), (F.coalesce("d", F.lit(0.0)) / F.col("m")).alias("val"))
    return off.unionByName(diagonal)


def hodge_l0(vertex_rho: DataFrame, edge_rho: DataFrame) -> DataFrame:
    """(i, j, val) of M0^-1 B C B' with diagonal masses (the random-walk form of the same operator)."""
    mass = vertex_rho.select(F.col("vertex").alias("i"), F.greatest("rho", F.lit(LEAST_DENSITY)).alias("m"))
    d = directed(conductance(edge_rho), "c").select(F.col("vertex").alias("i"), F.col("nbr").alias("j"), "c")
    entries = d.select("i", "j", (-F.col("c")).alias("v")).unionByName(d.groupBy("i").agg(F.sum("c").alias("v")).select("i", F.col("i").alias("j"), "v"))
    return entries.join(mass, "i").select("i", "j", (F.col("v") / F.col("m")).alias("val"))


def edge_mass(edges: DataFrame, tri: DataFrame, edge_rho: DataFrame, vertex_rho: DataFrame, sets: DataFrame, policy: str = "always", limit: int = 200_000) -> DataFrame:
    """(i, j, i2, j2, val): mass between edges; off the diagonal the density of a triangle's common members.

    Policy ``always`` gives both parts at every size, ``never`` the diagonal only, ``auto`` the diagonal
    only above ``limit`` edges. Without triangles there is only a diagonal.
    """
    if policy not in ("auto", "never", "always"):
        raise ValueError("policy must be auto, never or always")
    own = edge_rho.select("i", "j", F.col("i").alias("i2"), F.col("j").alias("j2"), F.greatest("rho", F.lit(1e-15)).alias("val"))
    if policy == "never" or (policy == "auto" and edges.count() > limit):
        return own
    mass = triangle_mass(tri, sets, vertex_rho).withColumnRenamed("mass", "val")
    edge = lambda a, b: F.struct(F.col(a).alias("i"), F.col(b).alias("j"))
    ab, ac, bc = edge("v0", "v1"), edge("v0", "v2"), edge("v1", "v2")
    both = F.explode(F.array(*[F.struct(p.alias("p"), q.alias("q")) for p, q in ((ab, ac), (ac, ab), (ab, bc), (bc, ab), (ac, bc), (bc, ac))])).alias("e")
    off = mass.select("val", both).select(F.col("e.p.i").alias("i"), F.col("e.p.j").alias("j"), F.col("e.q.i").alias("i2"), F.col("e.q.j").alias("j2"), "val")
    return own.unionByName(off)


def boundary(edges_with_id: DataFrame) -> DataFrame:
    """(vertex, edge_id, sign): -1 at the tail, the smaller end, and +1 at the head."""
    tail = edges_with_id.select(F.col("i").alias("vertex"), "edge_id", F.lit(-1).alias("sign"))
    return tail.unionByName(edges_with_id.select(F.col("j").alias("vertex"), "edge_id", F.lit(1).alias("sign")))


def boundary2(tri: DataFrame) -> DataFrame:
    """(i, j, v0, v1, v2, sign): edges of each triangle, +1 for (v0, v1) and (v1, v2), -1 for (v0, v2)."""
    ends = [("v0", "v1", 1), ("v0", "v2", -1), ("v1", "v2", 1)]
    edge = F.explode(F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j"), F.lit(sign).alias("sign")) for a, b, sign in ends])).alias("e")
    return tri.select("v0", "v1", "v2", edge).select("e.i", "e.j", "v0", "v1", "v2", "e.sign")


def triangle_mass(tri: DataFrame, sets: DataFrame, vertex_rho: DataFrame) -> DataFrame:
    """(v0, v1, v2, mass): density of the members that all three vertices' sets have in common; triangles may carry it already."""
    if "mass" in tri.columns:
        return tri.select("v0", "v1", "v2", "mass")
    member = tri.select("v0", "v1", "v2")
    for v in ("v0", "v1", "v2"):
        member = member.join(sets.select(F.col("vertex").alias(v), "member"), [v] if v == "v0" else [v, "member"])
    return member.join(vertex_rho.select(F.col("vertex").alias("member"), "rho"), "member").groupBy("v0", "v1", "v2").agg(F.sum("rho").alias("mass"))


def hodge_l1(vertex_rho: DataFrame, edge_rho: DataFrame, tri_mass: DataFrame | None = None) -> DataFrame:
    """(i, j, i2, j2, val) of M1^-1 B1' M0 B1, and with triangles (v0, v1, v2, mass) also B2 M2^-1 B2' M1; diagonal masses.

    Entries come from equi-joins on shared vertices and triangles, at any number of edges.
    """
    mass = edge_rho.select("i", "j", F.greatest("rho", F.lit(1e-15)).alias("m"))
    ends = mass.select("i", "j", "m", F.explode(F.array(F.struct(F.col("i").alias("vertex"), F.lit(-1).alias("s")), F.struct(F.col("j").alias("vertex"), F.lit(1).alias("s")))).alias("e")).select("i", "j", "m", "e.vertex", "e.s")
    other = ends.select(F.col("i").alias("i2"), F.col("j").alias("j2"), "vertex", F.col("s").alias("s2"))
    # what a pair's value needs lies on its first edge before the edges of a vertex meet, so that pairs are dealt once
    first = ends.join(vertex_rho.select("vertex", F.greatest("rho", F.lit(LEAST_DENSITY)).alias("m0")), "vertex").select("vertex", "i", "j", (F.col("s") * F.col("m0") / F.col("m")).alias("val"))
    parts = first.join(other, "vertex").select("i", "j", "i2", "j2", (F.col("val") * F.col("s2")).alias("val"))
    if tri_mass is not None:
        sides = [("v0", "v1", 1.0), ("v0", "v2", -1.0), ("v1", "v2", 1.0)]
        three = tri_mass.select("v0", "v1", "v2", F.greatest("mass", F.lit(1e-15)).alias("mass"))
        for k, (a, b, _) in enumerate(sides):
            three = three.join(mass.select(F.col("i").alias(a), F.col("j").alias(b), F.col("m").alias(f"m{k}")), [a, b])
        pairs = [F.struct(F.col(a).alias("i"), F.col(b).alias("j"), F.col(c).alias("i2"), F.col(d).alias("j2"), (F.lit(s * t) / F.col("mass") * F.col(f"m{k}")).alias("val")) for a, b, s in sides for k, (c, d, t) in enumerate(sides)]
        parts = parts.unionByName(three.select(F.explode(F.array(*pairs)).alias("e")).select("e.*"))
    return parts.groupBy("i", "j", "i2", "j2").agg(F.sum("val").alias("val"))


def neighbour_weights(vertex_rho: DataFrame, edge_rho: DataFrame) -> DataFrame:
    """(vertex, nbr, conductance, mass_sym) for both directions of each edge."""
    mass = vertex_rho.select("vertex", F.greatest("rho", F.lit(1e-15)).alias("m"))
    d = directed(conductance(edge_rho), "c").join(mass, "vertex").join(mass.select(F.col("vertex").alias("nbr"), F.col("m").alias("mn")), "nbr")
    return d.select("vertex", "nbr", F.col("c").alias("conductance"), (F.col("c") / F.sqrt(F.col("m") * F.col("mn"))).alias("mass_sym"))


def response_modulation(edge_rho: DataFrame, y: DataFrame, gamma: float) -> DataFrame:
    """(i, j, rho): edge masses times (1 + (dy / s)^2)^-gamma, total kept; s is the quartile range of |dy| by order statistics."""
    ends = edge_rho.join(y.select(F.col("vertex").alias("i"), F.col("y").alias("yi")), "i").join(y.select(F.col("vertex").alias("j"), F.col("y").alias("yj")), "j")
    d = ends.select("i", "j", F.col("rho").alias("old"), F.abs(F.col("yi") - F.col("yj")).alias("d"))
    s = order_statistic(d, "d", lambda n: 3 * n // 4) - order_statistic(d, "d", lambda n: n // 4)
    d = d.withColumn("raw", F.col("old") * F.pow(1 + F.pow(F.col("d") / F.greatest(s, F.lit(1e-10)), 2), F.lit(-gamma)))
    t = d.agg(F.sum("old"), F.sum("raw")).first()
    return d.select("i", "j", (F.col("raw") * ((t[0] / t[1]) if t[1] else 1.0)).alias("rho"))


def triangle_modulation(mass: DataFrame, tri: DataFrame, y: DataFrame, gamma: float) -> DataFrame:
    """(i, j, i2, j2, val): edge masses lowered where the response changes, on the diagonal and off it, total kept.

    The diagonal is scaled by (1 + (dy / s1)^2)^-gamma of the edge's change, and an entry between two edges by the same of the
    largest change within a triangle that holds both, over s2. Each s is the quartile range, by order statistics, of all
    edges' or all triangles' changes, at least 1e-10. For masses (i, j, i2, j2, val) and triangles (v0, v1, v2).
    """
    at = lambda v, name: y.select(F.col("vertex").alias(v), F.col("y").alias(name))

    def spread(rows: DataFrame) -> float:
        q1, q3 = at_ranks(rows, "d", lambda n: [n // 4, 3 * n // 4])
        return max(q3 - q1, 1e-10) if q1 is not None else 1e-10

    own = mass.where("i = i2 and j = j2").join(at("i", "yi"), "i").join(at("j", "yj"), "j").select("i", "j", "i2", "j2", "val", F.abs(F.col("yi") - F.col("yj")).alias("d"))
    own = checkpointed(own)
    three = tri.select("v0", "v1", "v2").join(at("v0", "y0"), "v0").join(at("v1", "y1"), "v1").join(at("v2", "y2"), "v2")
    three = checkpointed(three.select("v0", "v1", "v2", (F.greatest("y0", "y1", "y2") - F.least("y0", "y1", "y2")).alias("d")))
    s1, s2 = spread(own), spread(three)
    edge = lambda a, b: F.struct(F.col(a).alias("i"), F.col(b).alias("j"))
    ab, ac, bc = edge("v0", "v1"), edge("v0", "v2"), edge("v1", "v2")
    pairs = F.explode(F.array(*[F.struct(p.alias("p"), q.alias("q")) for p, q in ((ab, ac), (ab, bc), (ac, bc), (ac, ab), (bc, ab), (bc, ac))])).alias("e")
    most = three.select("d", pairs).select(F.col("e.p.i").alias("i"), F.col("e.p.j").alias("j"), F.col("e.q.i").alias("i2"), F.col("e.q.j").alias("j2"), "d").groupBy("i", "j", "i2", "j2").agg(F.max("d").alias("d"))
    lowered = lambda s: F.pow(1 + F.pow(F.col("d") / F.lit(s), 2), F.lit(-float(gamma)))
    off = mass.where("i != i2 or j != j2").join(most, ["i", "j", "i2", "j2"], "left").select("i", "j", "i2", "j2", F.col("val").alias("old"), (F.col("val") * F.coalesce(lowered(s2), F.lit(1.0))).alias("val"))
    rows = checkpointed(own.select("i", "j", "i2", "j2", F.col("val").alias("old"), (F.col("val") * lowered(s1)).alias("val")).unionByName(off))
    before, after = rows.agg(F.sum("old"), F.sum("val")).first()
    if after is not None and not after > 1e-15:
        raise ValueError(f"gamma {gamma} leaves no mass: choose a smaller one")
    return rows.select("i", "j", "i2", "j2", (F.col("val") * ((before / after) if after else 1.0)).alias("val"))


def least_length_density(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, y): one over the shortest incident edge; an isolated vertex is an error."""
    near = directed(edges.where("length > 0"), "length").groupBy("vertex").agg(F.min("length").alias("l"))
    if not vertices.select("vertex").join(near, "vertex", "left_anti").isEmpty():
        raise ValueError("an isolated vertex has no density")
    return near.select("vertex", (1 / F.col("l")).alias("y"))


def unit_scaled(df: DataFrame, value: str) -> DataFrame:
    """Min-max to [0, 1]; a constant becomes 1."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    return df.withColumn(value, F.lit(1.0) if hi == lo else (F.col(value) - lo) / (hi - lo))
