"""Registered queries of the smoothing engine over the given tables, and their DuckDB equivalents.

Vertices are the rows of ``embeddings``; the response and the subjects are its labels. Numbers are
rounded to six places, as sums of doubles depend on their order.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenfield.functions import columns as fx
from lumenfield.functions import orders
from lumenfield.operators import draws, extrema, graph, logit, meanshift, measures, members, metrics, resample, spectral, splines, walks
from lumenfield.oracles import sql
from lumenfield.plans import fit as plans
from lumenfield.plans import pipelines
from lumenfield.sources import synthetic, tables

K = 5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def r6up(c: str) -> Column:
    """Rounded off the exact halves that ratios of small whole numbers make."""
    return F.round(F.col(c) + 3e-10, 6).alias(c)


class Base:
    """The inputs of most queries; built on demand, and only as far as a query reaches."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.raw = tables.table(spark, sf_dir, "embeddings")
        self.points = tables.points(self.raw, "vec_id", "embedding")
        self.vertices = self.points.select("vertex")
        self.y = self.raw.select(F.col("vec_id").alias("vertex"), F.col("label").cast("double").alias("y"))
        self.subjects = self.raw.select(F.col("vec_id").alias("vertex"), F.col("label").cast("string").alias("subject"))

    def knn(self, k: int = K + 1) -> DataFrame:
        return spectral._checkpointed(graph.knn(self.points, k))

    def edges(self) -> DataFrame:
        return spectral._checkpointed(graph.iknn(self.knn()))

    def sparse(self) -> DataFrame:
        """Edges of a graph of many components."""
        return spectral._checkpointed(graph.iknn(self.knn(2)))

    def geometry(self):
        edges = self.edges()
        return (edges, *plans.geometry(self.vertices, edges, K))

    def fit(self, binary: bool = False, **options) -> plans.Fit:
        y = self.y.select("vertex", (F.col("y") < 5).cast("double").alias("y")) if binary else self.y
        return plans.fit(self.points, y, K, check_connected=False, **options)


def _weights(rho: DataFrame) -> DataFrame:
    """Densities as a measure."""
    return rho.select("vertex", F.col("rho").alias("w"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = tables.table(spark, sf_dir, "lineitem")
    sums = [F.sum(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_tax", "l_discount")]
    return line.groupBy(F.col("l_suppkey").cast("long").alias("vertex")).agg(F.array(*sums).alias("x"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").cast("double").alias("value"))


def positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of which logarithms and powers exist."""
    return values(spark, sf_dir).where("value > 0")


# -- sources, projections and column transforms


@query(sql("SELECT vertex, len(x)::BIGINT AS dim, round(list_sum(x), 6) AS total, round(sqrt(list_dot_product(x, x)), 6) AS norm FROM points"))
def points_ingest(spark, sf_dir):
    p = Base(spark, sf_dir).points
    total = lambda f: F.aggregate("x", F.lit(0.0), lambda a, v: a + f(v))
    return p.select("vertex", F.size("x").cast("long").alias("dim"), r6(total(lambda v: v), "total"), r6(F.sqrt(total(lambda v: v * v)), "norm"))


_SPOILT = """SELECT vertex, nbr, CASE WHEN (vertex + 2 * nbr) % 23 = 0 THEN -length WHEN vertex < nbr AND (vertex * nbr) % 19 = 0 THEN length + 0.5 ELSE length END AS length
    FROM adj WHERE NOT (vertex > nbr AND (vertex + nbr) % 17 = 0) UNION ALL SELECT vertex, nbr, length FROM adj WHERE (vertex * 3 + nbr) % 29 = 0 UNION ALL SELECT vertex, vertex, 1.0 FROM points WHERE vertex % 50 = 0"""


@query(sql("""SELECT 'self_loop' AS problem, count(*) AS n FROM spoilt WHERE vertex = nbr
    UNION ALL SELECT 'bad_weight', count(*) FROM spoilt WHERE length <= 0
    UNION ALL SELECT 'duplicate', count(*) FROM (SELECT 1 FROM spoilt GROUP BY vertex, nbr HAVING count(*) > 1)
    UNION ALL SELECT 'not_reciprocal', count(*) FROM spoilt a WHERE NOT EXISTS (SELECT 1 FROM spoilt b WHERE b.vertex = a.nbr AND b.nbr = a.vertex)
    UNION ALL SELECT 'unequal_weights', count(*) FROM spoilt a JOIN spoilt b ON b.vertex = a.nbr AND b.nbr = a.vertex WHERE abs(a.length - b.length) > 1e-10 * greatest(1, abs(a.length), abs(b.length))""", spoilt=_SPOILT))  # fmt: skip
def graph_validate(spark, sf_dir):
    """Defects of the neighbour graph after some were planted in it."""
    b = Base(spark, sf_dir)
    adj = graph.directed(b.edges(), "length")
    v, n = F.col("vertex"), F.col("nbr")
    length = F.when((v + 2 * n) % 23 == 0, -F.col("length")).when((v < n) & ((v * n) % 19 == 0), F.col("length") + 0.5).otherwise(F.col("length"))
    spoilt = adj.where(~((v > n) & ((v + n) % 17 == 0))).select("vertex", "nbr", length.alias("length"))
    spoilt = spoilt.unionByName(adj.where((v * 3 + n) % 29 == 0)).unionByName(b.vertices.where("vertex % 50 = 0").select("vertex", v.alias("nbr"), F.lit(1.0).alias("length")))
    return tables.graph_problems(spoilt)


@query(sql("SELECT vertex, round(pow(x[1], 0.5), 6) AS a, round(pow(x[2], 0.5), 6) AS b, round(pow(x[3], 0.5), 6) AS c, round(pow(x[4], 0.5), 6) AS d FROM feat"))
def lp_transform(spark, sf_dir):
    f = features(spark, sf_dir).withColumn("x", fx.power(F.col("x"), 0.5))
    return f.select("vertex", *[r6(F.col("x")[i], c) for i, c in enumerate("abcd")])


@query(sql("SELECT vertex, round(x[1] / list_sum(x), 6) AS a, round(x[2] / list_sum(x), 6) AS b, round(x[3] / list_sum(x), 6) AS c, round(x[4] / list_sum(x), 6) AS d FROM feat"))
def l1_normalize(spark, sf_dir):
    f = features(spark, sf_dir).withColumn("x", fx.l1(F.col("x")))
    return f.select("vertex", *[r6(F.col("x")[i], c) for i, c in enumerate("abcd")])


@query(sql("SELECT event_id, round(least(greatest(value, q[1]), q[2]), 6) AS value FROM vals, (SELECT quantile_cont(value, [0.05, 0.95]) AS q FROM vals)"))
def winsorize(spark, sf_dir):
    return orders.winsorize(values(spark, sf_dir), "value", 0.05, "value").select("event_id", r6("value"))


@query(sql("SELECT event_id, round(least(value, q), 6) AS value FROM vals, (SELECT quantile_cont(value, 0.9) AS q FROM vals)"))
def right_winsorize(spark, sf_dir):
    return orders.right_winsorize(values(spark, sf_dir), "value", 0.1, "value").select("event_id", r6("value"))


@query(sql("SELECT event_id, round(value / m, 6) AS relative, round(least(greatest(value, q[1]), q[2]) / m, 6) AS winsorized FROM vals, (SELECT avg(value) AS m, quantile_cont(value, [0.025, 0.975]) AS q FROM vals)"))
def relative_fit(spark, sf_dir):
    v = values(spark, sf_dir)
    mean = v.agg(F.avg("value")).scalar()
    return orders.winsorize(v, "value", 0.025, "w").select("event_id", r6(F.col("value") / mean, "relative"), r6(F.col("w") / mean, "winsorized"))


@query(sql("SELECT event_id, round(ln(value), 6) AS log, round((pow(value, 0.5) - 1) / 0.5, 6) AS half, round((pow(value, -1.0) - 1) / -1.0, 6) AS inverse FROM positive"))
def boxcox_transform(spark, sf_dir):
    v = F.col("value")
    return positive(spark, sf_dir).select("event_id", r6(fx.box_cox(v, 0.0), "log"), r6(fx.box_cox(v, 0.5), "half"), r6(fx.box_cox(v, -1.0), "inverse"))


@query(sql("""SELECT lam, round(-n / 2.0 * ln(rss / n) + (lam - 1) * sl, 3) AS loglik FROM (
    SELECT lam, count(*) AS n, sum(ln(value)) AS sl, var_pop(CASE WHEN abs(lam) < 1e-8 THEN ln(value) ELSE (pow(value, lam) - 1) / lam END) * count(*) AS rss
    FROM positive, (SELECT t / 10.0::DOUBLE AS lam FROM range(-20, 21) r(t)) GROUP BY lam)"""))  # fmt: skip
def boxcox_loglik(spark, sf_dir):
    grid = pipelines.box_cox_grid(positive(spark, sf_dir), "value", [t / 10 for t in range(-20, 21)])
    return grid.select(F.col("lambda").alias("lam"), F.round("loglik", 3).alias("loglik"))


@query(sql("""SELECT event_id, round(least(greatest(s, 0), top, 1), 6) AS p FROM (SELECT event_id, (value - 20) / 40 AS s FROM vals),
    (SELECT s AS top FROM (SELECT greatest((value - 20) / 40, 0) AS s, row_number() OVER (ORDER BY greatest((value - 20) / 40, 0)) AS r, count(*) OVER () AS n FROM vals) WHERE r = floor(n * (1 - 0.02)) + 1)"""))  # fmt: skip
def binary_clip(spark, sf_dir):
    v = values(spark, sf_dir).select("event_id", ((F.col("value") - 20) / 40).alias("s"))
    return orders.binary_clip(v, "s", "p").select("event_id", r6("p"))


_T = "t >= 1"
_KERNELS = {
    "epanechnikov": f"CASE WHEN {_T} THEN 0 ELSE 1 - t * t END", "triangular": f"CASE WHEN {_T} THEN 0 ELSE 1 - t END", "tr_exponential": f"CASE WHEN {_T} THEN 0 ELSE (1 - t) * exp(-t) END",
    "laplace": "0.5 * exp(-abs(t))", "normal": "0.3989423 * exp(-t * t / 2)", "biweight": f"CASE WHEN {_T} THEN 0 ELSE pow(1 - t * t, 2) END", "tricube": f"CASE WHEN {_T} THEN 0 ELSE pow(1 - t * t * t, 3) END",
    "cosine": f"CASE WHEN {_T} THEN 0 ELSE cos(pi() * t / 2) END", "hyperbolic": "1 / abs(t)", "constant": "1.0::DOUBLE",
}


@query(sql("SELECT event_id, " + ", ".join(f"round(({e})::DOUBLE, 6) AS {k}" for k, e in _KERNELS.items()) + " FROM (SELECT event_id, value / 40 AS t FROM vals)"))
def kernel_eval(spark, sf_dir):
    v = values(spark, sf_dir).select("event_id", (F.col("value") / 40).alias("t"))
    # the largest double stands for the hyperbolic kernel's pole, which is infinite here
    pole = lambda k: (F.col("t") == 0) & F.lit(k == "hyperbolic")
    w = v.select("event_id", *[F.when(pole(k), float("inf")).otherwise(fx.kernel(k, F.col("t"))).alias(k) for k in fx.KERNELS])
    # millionths are rounded as doubles, as the SQL does, which tells beyond 2^33 or so; what overflows stays as it is
    millionths = lambda k: F.col(k) * 1e6
    return w.select("event_id", *[F.when(F.abs(millionths(k)) < float("inf"), F.round(millionths(k)) / 1e6).otherwise(F.col(k)).alias(k) for k in fx.KERNELS])


_U = "('0x' || substr(md5({}), 1, 13))::BIGINT::DOUBLE / pow(2, 52)"


@query(sql("""SELECT vertex, y + CASE WHEN n = 1 THEN 0 WHEN y = lo AND vertex = head THEN 0 WHEN y = lo THEN size * (u + 0.5) WHEN y = hi AND vertex = head THEN 0 WHEN y = hi THEN -size * (u + 0.5) ELSE size * (u - mean) END AS y FROM grp""",
           tied=f"SELECT event_id AS vertex, round(value, 1) AS y, {_U.format("'123:' || event_id")} AS u FROM vals",
           grp="SELECT *, count(*) OVER (PARTITION BY y) AS n, min(vertex) OVER (PARTITION BY y) AS head, avg(u) OVER (PARTITION BY y) AS mean, min(y) OVER () AS lo, max(y) OVER () AS hi, 1e-10::DOUBLE * greatest(1, max(y) OVER () - min(y) OVER ()) AS size FROM tied"))
def break_ties(spark, sf_dir):
    """Values made distinct by noise within tied groups only."""
    return pipelines.break_ties(values(spark, sf_dir).select(F.col("event_id").alias("vertex"), F.round("value", 1).alias("y")))


@query()
def pca_variance(spark, sf_dir):
    _, share = metrics.pca(Base(spark, sf_dir).points)
    return spark.createDataFrame([(k + 1, round(v, 6)) for k, v in enumerate(share)], "component int, cumulative double")


@query()
def pca_scores(spark, sf_dir):
    return metrics.pca(Base(spark, sf_dir).points, variance=0.5)[0]


# -- neighbourhood graphs


@query(sql("SELECT vertex, rank::BIGINT AS rank, nbr, round(dist, 6) AS dist FROM knn6"))
def knn_edges(spark, sf_dir):
    return graph.knn(Base(spark, sf_dir).points, K + 1).select("vertex", F.col("rank").cast("long").alias("rank"), "nbr", r6("dist"))


@query(sql("SELECT i, j, isize, round(length, 6) AS length FROM edges"))
def iknn_edges(spark, sf_dir):
    return graph.iknn(Base(spark, sf_dir).knn()).select("i", "j", "isize", r6("length"))


@query(sql("""SELECT k, count(*) AS edges, round(sum(length), 4) AS total FROM (SELECT k, a.vertex, b.vertex AS w, min(a.dist + b.dist) AS length
    FROM (SELECT unnest([3, 5, 8]) AS k) ks, knn a JOIN knn b ON a.nbr = b.nbr AND a.vertex < b.vertex WHERE a.rank <= k AND b.rank <= k GROUP BY ALL) GROUP BY k"""))  # fmt: skip
def iknn_sweep(spark, sf_dir):
    """One neighbour table at the largest k serves every k."""
    near = Base(spark, sf_dir).knn(9)
    e = pipelines.k_sweep_edges(near, [3, 5, 8])
    return e.groupBy("k").agg(F.count("*").alias("edges"), F.round(F.sum("length"), 4).alias("total"))


@query(sql("SELECT vertex, member FROM sets"))
def neighbor_sets(spark, sf_dir):
    b = Base(spark, sf_dir)
    return graph.neighbour_sets(b.vertices, b.edges(), K + 1)


@query(sql("SELECT i, j, isize FROM isz"))
def edge_isize(spark, sf_dir):
    b = Base(spark, sf_dir)
    edges = b.edges()
    return graph.intersection(edges, graph.neighbour_sets(b.vertices, edges, K + 1)).select("i", "j", "isize")


@query(sql("SELECT vertex, component FROM comp"))
def connected_components(spark, sf_dir):
    b = Base(spark, sf_dir)
    return graph.components(b.vertices, b.sparse())


@query(sql("SELECT vertex FROM comp WHERE component = (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)"))
def largest_cc(spark, sf_dir):
    b = Base(spark, sf_dir)
    return graph.largest_component(graph.components(b.vertices, b.sparse()))


@query(sql("""SELECT i, j, a.id AS new_i, b.id AS new_j, round(length, 6) AS length FROM sparse JOIN big a ON a.vertex = i JOIN big b ON b.vertex = j""",
           big="SELECT vertex, row_number() OVER (ORDER BY vertex) AS id FROM comp WHERE component = (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)"))
def induced_subgraph(spark, sf_dir):
    b = Base(spark, sf_dir)
    edges = b.sparse()
    return graph.induced(graph.largest_component(graph.components(b.vertices, edges)), edges).select("i", "j", "new_i", "new_j", r6("length"))


@query(sql("SELECT row_number() OVER (ORDER BY i, j) - 1 AS edge_id, i, j, round(length, 6) AS length FROM edges"))
def edge_list(spark, sf_dir):
    return graph.edge_list(Base(spark, sf_dir).edges()).select("edge_id", "i", "j", r6("length"))


@query(sql("SELECT v0, v1, v2, isize FROM tri"))
def triangles(spark, sf_dir):
    b = Base(spark, sf_dir)
    edges = b.edges()
    return graph.triangles(edges, graph.neighbour_sets(b.vertices, edges, K + 1))


@query(sql("""SELECT least(a, b) AS i, greatest(a, b) AS j, round(CASE WHEN tb < ta THEN tb - ta + 2 * pi() ELSE tb - ta END, 6) AS length FROM (
    SELECT vertex AS a, theta AS ta, coalesce(lead(vertex) OVER w, first(vertex) OVER w) AS b, coalesce(lead(theta) OVER w, first(theta) OVER w) AS tb
    FROM (SELECT vertex, 2 * pi() * ((vertex * 7919) % 10007) / 10007.0::DOUBLE AS theta FROM points) WINDOW w AS (ORDER BY theta, vertex ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""))  # fmt: skip
def circle_graph(spark, sf_dir):
    v = Base(spark, sf_dir).vertices
    return graph.circle(v.select("vertex", (2 * math.pi * ((F.col("vertex") * 7919) % 10007) / 10007.0).alias("theta"))).select("i", "j", r6("length"))


@query(sql("""SELECT (SELECT count(*) FROM sparse) AS edge_count, (SELECT count(*) FROM sz) AS component_count, (SELECT max(c) FROM sz) AS lcc_size, round((SELECT max(c) FROM sz) / (SELECT n FROM n), 6) AS lcc_fraction,
    coalesce((SELECT c FROM sz ORDER BY c DESC LIMIT 1 OFFSET 1), 0) AS second_lcc, round(avg(d), 6) AS degree_mean, min(d) AS degree_min, max(d) AS degree_max
    FROM (SELECT p.vertex, count(s.nbr) AS d FROM points p LEFT JOIN sadj s ON s.vertex = p.vertex GROUP BY p.vertex)""", sz="SELECT component, count(*) AS c FROM comp GROUP BY component"))  # fmt: skip
def graph_summary(spark, sf_dir):
    b = Base(spark, sf_dir)
    edges = b.sparse()
    s = graph.summary(b.vertices, edges, graph.components(b.vertices, edges))
    return s.select("edge_count", "component_count", "lcc_size", r6("lcc_fraction"), "second_lcc", r6("degree_mean"), "degree_min", "degree_max")


_KEDGES = "SELECT k, a.vertex AS i, b.vertex AS j FROM (SELECT unnest([3, 5]) AS k) ks, knn a JOIN knn b ON a.nbr = b.nbr AND a.vertex < b.vertex WHERE a.rank <= k AND b.rank <= k GROUP BY ALL"


@query(sql("""SELECT round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS degree_js,
    (SELECT count(*) FROM (SELECT i, j FROM ke GROUP BY i, j HAVING count(*) = 1)) AS edit_distance
    FROM (SELECT degree, coalesce(sum(s) FILTER (k = 3), 0) AS p, coalesce(sum(s) FILTER (k = 5), 0) AS q FROM sh GROUP BY degree)""",
    ke=_KEDGES, dg="SELECT k, v, count(*) AS degree FROM (SELECT k, i AS v FROM ke UNION ALL SELECT k, j FROM ke) GROUP BY k, v", sh="SELECT k, degree, count(*) / sum(count(*)) OVER (PARTITION BY k) AS s FROM dg GROUP BY k, degree"))
def k_stability(spark, sf_dir):
    e = spectral._checkpointed(pipelines.k_sweep_edges(Base(spark, sf_dir).knn(), [3, 5]))
    out = graph.degree_divergence(e.where("k = 3"), e.where("k = 5"))
    return out.select(r6("degree_js"), "edit_distance")


_NCC = "SELECT user_id::BIGINT AS k, 1 + (count(*) % 3)::BIGINT AS n_ccomp, round(avg(value)::DOUBLE / 100, 6) AS lcc_frac FROM vals GROUP BY user_id"


@query(sql("SELECT coalesce((SELECT min(k) FROM s WHERE n_ccomp = 1), (SELECT k FROM s ORDER BY lcc_frac DESC, k LIMIT 1)) AS k", s=_NCC))
def select_k(spark, sf_dir):
    v = values(spark, sf_dir).groupBy(F.col("user_id").cast("long").alias("k")).agg((1 + F.count("*") % 3).alias("n_ccomp"), F.round(F.avg("value") / 100, 6).alias("lcc_frac"))
    return pipelines.select_k(v)


@query(sql("SELECT CASE WHEN m IS NULL THEN (SELECT min(k) FROM s) ELSE (SELECT min(k) FROM s WHERE k > m) END AS k_cc FROM (SELECT max(k) FILTER (n_ccomp > 1) AS m FROM s)", s=_NCC))
def connected_tail(spark, sf_dir):
    v = values(spark, sf_dir).groupBy(F.col("user_id").cast("long").alias("k")).agg((1 + F.count("*") % 3).alias("n_ccomp"))
    return pipelines.connected_tail(v)


@query(sql("""SELECT i, j, round(length, 6) AS length FROM edges e WHERE NOT EXISTS (SELECT 1 FROM way w WHERE w.i = e.i AND w.j = e.j AND w.at_ = e.j)""", recursive=True,
           way="SELECT i, j, length, i AS at_, 0.0::DOUBLE AS way FROM edges UNION SELECT w.i, w.j, w.length, a.nbr, w.way + a.length FROM way w JOIN adj a ON a.vertex = w.at_ WHERE w.at_ <> w.j AND a.nbr <> w.i AND NOT (w.at_ = w.i AND a.nbr = w.j) AND (w.way + a.length) / w.length - 1 < 0.1").replace("way AS MATERIALIZED", "way AS"))
def geom_prune(spark, sf_dir):
    return graph.prune_long_ways(Base(spark, sf_dir).edges(), 0.1).select("i", "j", r6("length"))


@query(sql("""SELECT i, j, round(length, 6) AS length FROM ord WHERE length <= cut OR EXISTS (SELECT 1 FROM bridge b WHERE b.o = ord.o AND NOT EXISTS (SELECT 1 FROM met m WHERE m.o = b.o AND m.v = b.j))""", recursive=True,
           ord="SELECT i, j, length, row_number() OVER (ORDER BY length, i, j) AS o, quantile_cont(length, 0.8) OVER () AS cut FROM edges",
           oadj="SELECT i AS v, j AS w, o, length <= cut AS short FROM ord UNION ALL SELECT j, i, o, length <= cut FROM ord",
           near="SELECT vertex AS v, vertex AS seen FROM points UNION SELECT n.v, a.w FROM near n JOIN oadj a ON a.v = n.seen AND a.short",
           lab="SELECT v, min(seen) AS c FROM near GROUP BY v",
           bridge="SELECT o, i, j FROM ord JOIN lab a ON a.v = i JOIN lab b ON b.v = j WHERE length > cut AND a.c <> b.c",
           met="SELECT o, i AS v FROM bridge UNION SELECT m.o, a.w FROM met m JOIN oadj a ON a.v = m.v AND a.o < m.o").replace("near AS MATERIALIZED", "near AS").replace("met AS MATERIALIZED", "met AS"))
def quantile_prune(spark, sf_dir):
    b = Base(spark, sf_dir)
    return graph.prune_longest(b.vertices, b.edges(), 0.2).select("i", "j", r6("length"))


# -- measures, densities and operators


@query(sql("SELECT vertex, 1.0::DOUBLE AS w FROM points"))
def reference_measure(spark, sf_dir):
    return measures.counting_measure(Base(spark, sf_dir).vertices)


_MED = "SELECT dk AS m FROM (SELECT dk, row_number() OVER (ORDER BY dk) AS r, count(*) OVER () AS n FROM dk) WHERE r = n // 2 + 1"


@query(sql("""SELECT vertex, round(pow(1e-10 + used, -1.5) * (SELECT n FROM n) / (SELECT sum(pow(1e-10 + used, -1.5)) FROM u), 6) AS w, outside FROM u""",
           med=_MED, u="SELECT vertex, least(greatest(dk, m / 1.05), m * 1.05) AS used, CASE WHEN dk < m / 1.05 THEN -1 WHEN dk > m * 1.05 THEN 1 ELSE 0 END AS outside FROM dk, med"))
def reference_measure_dk(spark, sf_dir):
    dk = graph.directed(Base(spark, sf_dir).edges(), "length").groupBy("vertex").agg(F.max("length").alias("dk"))
    return measures.distance_measure(spectral._checkpointed(dk), clamp=1.05).select("vertex", r6("w"), "outside")


@query(sql("SELECT event_id, round(CASE WHEN hi / lo > 20 THEN pow(value, ln(20) / ln(hi / lo)) ELSE value END, 6) AS w FROM positive, (SELECT min(value) AS lo, max(value) AS hi FROM positive)"))
def weight_compress(spark, sf_dir):
    return measures.compress(positive(spark, sf_dir).withColumnRenamed("value", "w"), "w", 20.0).select("event_id", r6("w"))


@query(sql("SELECT vertex, round(rho, 6) AS rho FROM rho0"))
def vertex_density(spark, sf_dir):
    return Base(spark, sf_dir).geometry()[2].select("vertex", r6("rho"))


@query(sql("SELECT i, j, isize, round(rho, 6) AS rho FROM rho1"))
def edge_density(spark, sf_dir):
    return Base(spark, sf_dir).geometry()[3].select("i", "j", "isize", r6("rho"))


from lumenfield.oracles import floored as _floored  # noqa: E402


@query(sql("SELECT i, j, round(rho, 6) AS rho FROM upd", mass2="SELECT e.i, e.j, coalesce(sum(r.rho), 0) AS mass FROM edges e LEFT JOIN common c ON c.i = e.i AND c.j = e.j LEFT JOIN rho0 r ON r.vertex = c.member GROUP BY ALL", **_floored("mass2", "upd")))
def edge_density_update(spark, sf_dir):
    edges, sets, rho0, _ = Base(spark, sf_dir).geometry()
    return measures.edge_density(edges, sets, rho0.select("vertex", F.col("rho").alias("w"))).select("i", "j", r6("rho"))


@query(sql("SELECT vertex, round(sum(rho), 6) AS effective_degree FROM dir1 GROUP BY vertex"))
def effective_degree(spark, sf_dir):
    return measures.effective_degree(Base(spark, sf_dir).geometry()[3]).select("vertex", r6("effective_degree"))


@query(sql("""SELECT i, j, i AS i2, j AS j2, round(greatest(rho, 1e-15), 6) AS val FROM rho1 UNION ALL SELECT x[1], x[2], y[1], y[2], round(val, 6) FROM tm,
    (SELECT unnest([0, 1, 2, 3, 4, 5]) AS c) cs, LATERAL (SELECT CASE WHEN c IN (0, 1) THEN [v0, v1] WHEN c IN (2, 3) THEN [v0, v2] ELSE [v1, v2] END AS x, CASE c WHEN 0 THEN [v0, v2] WHEN 1 THEN [v1, v2] WHEN 2 THEN [v0, v1] WHEN 3 THEN [v1, v2] WHEN 4 THEN [v0, v1] ELSE [v0, v2] END AS y)""",
    tm="SELECT t.v0, t.v1, t.v2, sum(r.rho) AS val FROM tri t JOIN sets a ON a.vertex = t.v0 JOIN sets b ON b.vertex = t.v1 AND b.member = a.member JOIN sets c ON c.vertex = t.v2 AND c.member = a.member JOIN rho0 r ON r.vertex = a.member GROUP BY ALL"))
def edge_mass(spark, sf_dir):
    edges, sets, rho0, rho1 = Base(spark, sf_dir).geometry()
    return measures.edge_mass(edges, graph.triangles(edges, sets, _weights(rho0)), rho1, rho0, sets, policy="always").select("i", "j", "i2", "j2", r6("val"))


@query(sql("SELECT CASE s WHEN -1 THEN i ELSE j END AS vertex, edge_id, s AS sign FROM (SELECT row_number() OVER (ORDER BY i, j) - 1 AS edge_id, i, j FROM edges), (SELECT unnest([-1, 1]) AS s)"))
def boundary(spark, sf_dir):
    return measures.boundary(graph.edge_list(Base(spark, sf_dir).edges()))


@query(sql("SELECT i, j, round(1 / greatest(rho, 1e-10) / 1000, 4) AS c FROM rho1"))
def conductance(spark, sf_dir):
    """In thousands."""
    return measures.conductance(Base(spark, sf_dir).geometry()[3]).select("i", "j", F.round(F.col("c") / 1000, 4).alias("c"))


_LAP = """SELECT vertex AS i, nbr AS j, -conductance / sqrt(greatest(a.rho, 1e-8) * greatest(b.rho, 1e-8)) AS val FROM weights w JOIN rho0 a USING (vertex) JOIN rho0 b ON b.vertex = w.nbr
    UNION ALL SELECT vertex, vertex, sum(conductance) / greatest(any_value(a.rho), 1e-8) FROM weights JOIN rho0 a USING (vertex) GROUP BY vertex"""


@query(sql("SELECT i, j, round(val / 1000, 4) AS val FROM lap", lap=_LAP))
def laplacian_mass_sym(spark, sf_dir):
    _, _, rho0, rho1 = Base(spark, sf_dir).geometry()
    return measures.laplacian(rho0, rho1).select("i", "j", F.round(F.col("val") / 1000, 4).alias("val"))


@query(sql("""SELECT vertex AS i, nbr AS j, round(-conductance / greatest(a.rho, 1e-8) / 1000, 4) AS val FROM weights JOIN rho0 a USING (vertex)
    UNION ALL SELECT vertex, vertex, round(sum(conductance) / greatest(any_value(a.rho), 1e-8) / 1000, 4) FROM weights JOIN rho0 a USING (vertex) GROUP BY vertex"""))  # fmt: skip
def hodge_l0(spark, sf_dir):
    _, _, rho0, rho1 = Base(spark, sf_dir).geometry()
    return measures.hodge_l0(rho0, rho1).select("i", "j", F.round(F.col("val") / 1000, 4).alias("val"))


@query(sql("SELECT vertex, nbr, round(conductance / 1000, 4) AS conductance, round(mass_sym / 1000, 4) AS mass_sym FROM weights"))
def neighbor_weights(spark, sf_dir):
    _, _, rho0, rho1 = Base(spark, sf_dir).geometry()
    return measures.neighbour_weights(rho0, rho1).select("vertex", "nbr", *[F.round(F.col(c) / 1000, 4).alias(c) for c in ("conductance", "mass_sym")])


@query(sql("""SELECT i, j, round(raw * (SELECT sum(rho) FROM m) / (SELECT sum(raw) FROM m), 6) AS rho FROM m""",
           dd="SELECT e.i, e.j, e.rho, abs(a.y - b.y) AS d FROM rho1 e JOIN points a ON a.vertex = e.i JOIN points b ON b.vertex = e.j",
           qq="SELECT max(d) FILTER (r = 3 * n // 4 + 1) - max(d) FILTER (r = n // 4 + 1) AS s FROM (SELECT d, row_number() OVER (ORDER BY d) AS r, count(*) OVER () AS n FROM dd)",
           m="SELECT i, j, rho, rho * pow(1 + pow(d / greatest(s, 1e-10), 2), -1.0) AS raw FROM dd, qq"))
def response_modulation(spark, sf_dir):
    b = Base(spark, sf_dir)
    return measures.response_modulation(b.geometry()[3], b.y, 1.0).select("i", "j", r6("rho"))


@query()
def density_diffusion(spark, sf_dir):
    _, _, rho0, rho1 = Base(spark, sf_dir).geometry()
    lap = spectral._checkpointed(measures.laplacian(rho0, rho1))
    t, beta = spectral.diffusion_parameters(float(spectral.spectrum(lap, 3).values[1]))
    return spectral.diffuse(lap, rho0, t, beta)


_WALK = {
    "middle": "SELECT length AS d0 FROM (SELECT length, row_number() OVER (ORDER BY length) - 1 AS r FROM edges) WHERE r = (SELECT count(*) // 2 FROM edges)",
    "chance": "SELECT vertex, nbr, exp(-length / d0) / sum(exp(-length / d0)) OVER (PARTITION BY vertex) AS p FROM adj, middle",
}


def _walk_step(before: str, to: str, source: str, rest: str) -> str:
    return f"""SELECT r.vertex, 0.3 * any_value(r.rho) + 0.7 * coalesce(sum(p.p * q.rho), {rest}) AS rho
        FROM {before} r LEFT JOIN chance p ON p.{to} = r.vertex LEFT JOIN {before} q ON q.vertex = p.{source} GROUP BY r.vertex"""


@query(sql("""SELECT 'push' AS kind, vertex, round(sqrt(rho) * (SELECT count(*) / sum(sqrt(rho)) FROM push2), 6) AS rho FROM push2
    UNION ALL SELECT 'average', vertex, round(sqrt(rho) * (SELECT count(*) / sum(sqrt(rho)) FROM average2), 6) FROM average2""", **_WALK,
    push1=_walk_step("rho0", "nbr", "vertex", "0"), push2=_walk_step("push1", "nbr", "vertex", "0"),
    average1=_walk_step("rho0", "vertex", "nbr", "any_value(r.rho)"), average2=_walk_step("average1", "vertex", "nbr", "any_value(r.rho)")))
def lazy_walk(spark, sf_dir):
    """Both preconditioners after two lazy steps."""
    edges, _, rho0, _ = Base(spark, sf_dir).geometry()
    kinds = [walks.lazy_walk(rho0, edges, 2, 0.7, 0.5, forward=f).select(F.lit(k).alias("kind"), "vertex", r6("rho")) for k, f in (("push", True), ("average", False))]
    return kinds[0].unionByName(kinds[1])


@query()
def tikhonov_solve(spark, sf_dir):
    b = Base(spark, sf_dir)
    _, _, rho0, rho1 = b.geometry()
    return walks.tikhonov(spectral._checkpointed(measures.laplacian(rho0, rho1)), b.y.withColumnRenamed("y", "x"), 0.5)


@query()
def heat_apply(spark, sf_dir):
    b = Base(spark, sf_dir)
    _, _, rho0, rho1 = b.geometry()
    return walks.heat(spectral._checkpointed(measures.laplacian(rho0, rho1)), b.y.withColumnRenamed("y", "x"), 0.5, 4)


@query()
def rho_basins(spark, sf_dir):
    """Basins of the local maxima of the fitted response."""
    model = Base(spark, sf_dir).fit(n_eigenpairs=30)
    y = model.fitted.select("vertex", F.col("y_hat").alias("y"))
    weighted = y.join(model.vertex_rho, "vertex").select("vertex", (F.col("y") * F.col("rho")).alias("y"))
    tops = extrema.local_extrema(weighted, model.edges).where("type = 'max'").select(F.col("vertex").alias("source"))
    return walks.basins(y, model.edges, model.vertex_rho, tops)


@query()
def smoothed_density(spark, sf_dir):
    return plans.smoothed_density(Base(spark, sf_dir).fit())


# -- spectra, filters, selection


@query()
def spectrum(spark, sf_dir):
    low = Base(spark, sf_dir).fit().spectrum
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(low.values)], "mode int, lambda double")


@query()
def spectral_gap(spark, sf_dir):
    return spark.createDataFrame([(float(Base(spark, sf_dir).fit(n_eigenpairs=3).spectrum.values[1]),)], "gap double")


_SPECTRA = "SELECT user_id, min(value) / 40 AS gap, max(value) / 40 AS top FROM positive GROUP BY user_id"


def _spectra(spark, sf_dir) -> DataFrame:
    """The least and largest value of each user stand for eigenvalues."""
    return positive(spark, sf_dir).groupBy("user_id").agg((F.min("value") / 40).alias("gap"), (F.max("value") / 40).alias("top"))


@query(sql("SELECT user_id, round(t, 6) AS t, round(greatest(1e-4, 0.1 / t), 6) AS beta FROM (SELECT user_id, least(20, 0.5 / greatest(gap, 0.01)) AS t FROM sp)", sp=_SPECTRA))
def diffusion_params(spark, sf_dir):
    t, beta = spectral.diffusion_columns(F.col("gap"))
    return _spectra(spark, sf_dir).select("user_id", r6(t, "t"), r6(beta, "beta"))


@query(sql("""SELECT event_id, round(exp(-2 * l), 6) AS heat_kernel, round(1 / (1 + 2 * l), 6) AS tikhonov, round(1 / (1 + 2 * l * l), 6) AS cubic_spline, round(exp(-2 * l * l), 6) AS gaussian,
    round(exp(-2 * sqrt(l)), 6) AS exponential, round(1 / (1 + pow(l / 2, 4)), 6) AS butterworth FROM (SELECT event_id, value / 40 AS l FROM vals)"""))  # fmt: skip
def filter_weights(spark, sf_dir):
    v = values(spark, sf_dir).select("event_id", (F.col("value") / 40).alias("l"))
    return v.select("event_id", *[r6(fx.spectral_filter(k, F.col("l"), F.lit(2.0)), k) for k in fx.FILTERS])


@query(sql("SELECT user_id, t AS pos, round(ln(1e-10) + (ln(-ln(1e-10) / top) - ln(1e-10)) * t / 40, 6) AS log_eta FROM sp, range(1, 41) r(t)", sp=_SPECTRA))
def eta_grid_fit(spark, sf_dir):
    grid = _spectra(spark, sf_dir).select("user_id", F.posexplode(fx.eta_grid_fit_of(F.col("top"))).alias("pos", "eta"))
    return grid.select("user_id", (F.col("pos") + 1).cast("long").alias("pos"), r6(F.log("eta"), "log_eta"))


@query(sql("""SELECT user_id, t AS pos, round(CASE WHEN top <= gap THEN ln(1e-3 + (1 - 1e-3) * t / 39) ELSE lo + (ln(1 / gap) - lo) * t / 39 END, 6) AS log_eta
    FROM (SELECT *, ln(greatest(1e-6, 1 / top)) AS lo FROM sp), range(0, 40) r(t)""", sp=_SPECTRA))  # fmt: skip
def eta_grid_refit(spark, sf_dir):
    grid = _spectra(spark, sf_dir).select("user_id", F.posexplode(fx.eta_grid_refit_of(F.col("gap"), F.col("top"))).alias("pos", "eta"))
    return grid.select("user_id", F.col("pos").cast("long").alias("pos"), r6(F.log("eta"), "log_eta"))


@query()
def gcv_curve(spark, sf_dir):
    return spark.createDataFrame(Base(spark, sf_dir).fit().gcv, "eta double, gcv double")


@query()
def spectral_smooth(spark, sf_dir):
    return Base(spark, sf_dir).fit(n_eigenpairs=30).fitted


@query()
def semi_smooth(spark, sf_dir):
    b = Base(spark, sf_dir)
    return b.fit(labeled=b.vertices.where("vertex % 3 != 0")).fitted


@query()
def distance_measure_fit(spark, sf_dir):
    """The iterated fit: densities diffuse until the fitted values settle."""
    return Base(spark, sf_dir).fit(measure="distance", max_iterations=3).fitted


@query()
def gamma_select(spark, sf_dir):
    return pipelines.gamma_select(Base(spark, sf_dir).fit())


@query()
def refit_columns(spark, sf_dir):
    """Every feature as a response through the cached spectrum, with its own filter."""
    b = Base(spark, sf_dir)
    responses = b.points.select("vertex", F.posexplode("x").alias("col", "y"))
    return plans.refit(b.fit(), responses)[0]


@query()
def gcv_spline(spark, sf_dir):
    by_user = values(spark, sf_dir).groupBy(F.col("user_id").cast("double").alias("x")).agg(F.avg("value").alias("y"))
    return splines.spline(by_user)


@query(sql("SELECT k, round(score, 6) AS score FROM (SELECT user_id::BIGINT AS k, avg(value) AS score FROM vals GROUP BY user_id) ORDER BY abs(k - 77), k LIMIT 1"))
def optimal_p(spark, sf_dir):
    """The grid value nearest to a wanted one."""
    v = values(spark, sf_dir).groupBy(F.col("user_id").cast("long").alias("k")).agg(F.avg("value").alias("score"))
    return pipelines.nearest(v, "k", 77).select("k", r6("score"))


_SWEEP = "SELECT user_id::BIGINT AS k, avg(value) AS gcv, stddev_samp(value) AS rmse_fit, min(value) AS cor_fit_truth FROM vals GROUP BY user_id"
_NORM = "SELECT k, gcv, rmse_fit, cor_fit_truth, gcv / (SELECT min(gcv) FROM sweep) AS min_norm_gcv, (gcv - (SELECT median(gcv) FROM sweep)) / (1.4826 * (SELECT mad(gcv) FROM sweep)) AS robust_norm_gcv FROM sweep"


def _sweep(spark, sf_dir) -> DataFrame:
    v = values(spark, sf_dir).groupBy(F.col("user_id").cast("long").alias("k"))
    return metrics.k_sweep_normalised(v.agg(F.avg("value").alias("gcv"), F.stddev_samp("value").alias("rmse_fit"), F.min("value").alias("cor_fit_truth")))


@query(sql("SELECT k, round(min_norm_gcv, 6) AS min_norm_gcv, round(robust_norm_gcv, 6) AS robust_norm_gcv FROM norm", sweep=_SWEEP, norm=_NORM))
def k_sweep_norm(spark, sf_dir):
    return _sweep(spark, sf_dir).select("k", r6("min_norm_gcv"), r6("robust_norm_gcv"))


@query(sql(" UNION ALL ".join(f"(SELECT '{c}' AS criterion, k AS k_selected, round({f}, 6) AS value FROM norm WHERE {f} IS NOT NULL ORDER BY {f} {d}, k LIMIT 1)" for c, f, d in (("min.rmse_fit", "rmse_fit", "ASC"), ("max.cor_fit_truth", "cor_fit_truth", "DESC"), ("min.gcv", "gcv", "ASC"), ("min.min_norm_gcv", "min_norm_gcv", "ASC"), ("min.robust_norm_gcv", "robust_norm_gcv", "ASC"))), sweep=_SWEEP, norm=_NORM))
def k_sweep_select(spark, sf_dir):
    return metrics.k_sweep_selection(_sweep(spark, sf_dir)).select("criterion", "k_selected", r6("value"))


# -- extrema and subjects


@query(sql("""SELECT 'M' || row_number() OVER (ORDER BY vertex) AS label, vertex, y AS value, 'max' AS type, CASE WHEN y = (SELECT max(y) FROM points) THEN 'Infinity'::DOUBLE ELSE 1 END AS hop_idx FROM ends WHERE hi IS NULL OR y >= hi
    UNION ALL SELECT 'm' || row_number() OVER (ORDER BY vertex), vertex, y, 'min', CASE WHEN y = (SELECT min(y) FROM points) THEN 'Infinity'::DOUBLE ELSE 1 END FROM ends WHERE lo IS NULL OR y <= lo""",
    ends="SELECT p.vertex, any_value(p.y) AS y, max(q.y) AS hi, min(q.y) AS lo FROM points p LEFT JOIN adj a ON a.vertex = p.vertex LEFT JOIN points q ON q.vertex = a.nbr GROUP BY p.vertex"))
def local_extrema(spark, sf_dir):
    b = Base(spark, sf_dir)
    return extrema.local_extrema(b.y, b.edges())


@query(sql("""SELECT p.vertex, round(sum(CASE WHEN p.y > q.y THEN r.rho ELSE 0 END) / sum(r.rho) + 3e-10, 6) AS maxp, round(sum(CASE WHEN p.y < q.y THEN r.rho ELSE 0 END) / sum(r.rho) + 3e-10, 6) AS minp
    FROM points p LEFT JOIN adj a ON a.vertex = p.vertex LEFT JOIN points q ON q.vertex = a.nbr LEFT JOIN rho0 r ON r.vertex = a.nbr GROUP BY p.vertex"""))  # fmt: skip
def extremp(spark, sf_dir):
    b = Base(spark, sf_dir)
    edges, _, rho0, _ = b.geometry()
    return extrema.extremp(b.y, edges, rho0).select("vertex", r6up("maxp"), r6up("minp"))


@query()
def hop_extremp_radius(spark, sf_dir):
    model = Base(spark, sf_dir).fit(n_eigenpairs=30)
    y = model.fitted.select("vertex", F.col("y_hat").alias("y"))
    return extrema.hop_radius(y, model.edges, model.vertex_rho, 0.9)


@query()
def pextrema(spark, sf_dir):
    return pipelines.pextrema(Base(spark, sf_dir).fit(n_eigenpairs=30))


@query(sql("SELECT i, j, round(delta / 1000, 4) AS delta FROM delta"))
def coboundary(spark, sf_dir):
    b = Base(spark, sf_dir)
    _, _, rho0, rho1 = b.geometry()
    return extrema.coboundary(b.y, rho0, rho1).select("i", "j", F.round(F.col("delta") / 1000, 4).alias("delta"))


@query(sql("""SELECT p.vertex, round(CASE WHEN sum(m * abs(s)) > 1e-15 THEN -sum(m * s) / sum(m * abs(s)) END, 6) AS score FROM points p LEFT JOIN
    (SELECT i AS vertex, greatest(rho, 1e-15) AS m, delta AS s FROM delta UNION ALL SELECT j, greatest(rho, 1e-15), -delta FROM delta) d ON d.vertex = p.vertex GROUP BY p.vertex"""))  # fmt: skip
def extremality(spark, sf_dir):
    b = Base(spark, sf_dir)
    _, _, rho0, rho1 = b.geometry()
    return extrema.extremality(b.y, rho0, rho1).select("vertex", r6("score"))


@query()
def hop_extremality(spark, sf_dir):
    return pipelines.hop_extremality(Base(spark, sf_dir).fit(n_eigenpairs=30))


@query()
def k_diagnostics(spark, sf_dir):
    b = Base(spark, sf_dir)
    return pipelines.k_diagnostics(b.points, b.y, [3, 4, 5])


@query(sql("""SELECT h.vertex, n_neighbors, n_hat, n_subjects_hat, round(n_hat / n_subjects_hat, 6) AS "R", n_subjects_conductance, round(p_max_conductance + 3e-10, 6) AS p_max_conductance, round(s_eff_conductance + 3e-10, 6) AS s_eff_conductance, round(p_max_operator + 3e-10, 6) AS p_max_operator, round(s_eff_operator + 3e-10, 6) AS s_eff_operator
    FROM (SELECT vertex, count(*) AS n_hat, count(DISTINCT subject) AS n_subjects_hat FROM (SELECT a.vertex, p.subject FROM adj a JOIN points p ON p.vertex = a.nbr UNION ALL SELECT vertex, subject FROM points) GROUP BY vertex) h
    JOIN (SELECT vertex, sum(n)::BIGINT AS n_neighbors, count(*) AS n_subjects_conductance, max(c) / sum(c) AS p_max_conductance, pow(sum(c), 2) / sum(c * c) AS s_eff_conductance, max(o) / sum(o) AS p_max_operator, pow(sum(o), 2) / sum(o * o) AS s_eff_operator
      FROM (SELECT w.vertex, p.subject, count(*) AS n, sum(conductance) AS c, sum(mass_sym) AS o FROM weights w JOIN points p ON p.vertex = w.nbr GROUP BY ALL) GROUP BY vertex) s USING (vertex)"""))  # fmt: skip
def subject_stats(spark, sf_dir):
    b = Base(spark, sf_dir)
    edges, _, rho0, rho1 = b.geometry()
    s = extrema.subject_stats(b.subjects, edges, measures.neighbour_weights(rho0, rho1))
    return s.select("vertex", "n_neighbors", "n_hat", "n_subjects_hat", r6("R"), "n_subjects_conductance", *[r6up(c) for c in ("p_max_conductance", "s_eff_conductance", "p_max_operator", "s_eff_operator")])


# -- resampling and tests


@query(sql("SELECT max(c) AS max_size, round(max(m), 6) AS max_mass FROM (SELECT component, count(*) AS c, sum(y) AS m FROM (SELECT vertex, min(seen) AS component FROM walk GROUP BY vertex) JOIN points USING (vertex) GROUP BY component)", recursive=True,
           hot="SELECT a.vertex, a.nbr FROM sadj a JOIN points p ON p.vertex = a.vertex AND p.y >= 4 JOIN points q ON q.vertex = a.nbr AND q.y >= 4",
           walk="SELECT vertex, vertex AS seen FROM points WHERE y >= 4 UNION SELECT w.vertex, h.nbr FROM walk w JOIN hot h ON h.vertex = w.seen").replace("walk AS MATERIALIZED", "walk AS"))
def cluster_max(spark, sf_dir):
    b = Base(spark, sf_dir)
    return resample.cluster_max(b.y.select("vertex", F.col("y").alias("stat")), b.sparse(), 4.0).select("max_size", r6("max_mass"))


@query(sql("""SELECT p.vertex, b AS col, u.y FROM points p JOIN (SELECT b, unit, row_number() OVER (PARTITION BY b ORDER BY ('0x' || substr(md5('1:' || b || ':' || unit), 1, 13))::BIGINT::DOUBLE / pow(2, 52), unit) AS r
    FROM (SELECT DISTINCT subject AS unit FROM points), range(1, 6) t(b)) d ON d.unit = p.subject JOIN (SELECT subject, any_value(y) AS y, row_number() OVER (ORDER BY subject) AS r FROM points GROUP BY subject) u USING (r)"""))  # fmt: skip
def perm_blocks(spark, sf_dir):
    b = Base(spark, sf_dir)
    return resample.permuted(b.y, 5, 1, b.subjects).select("vertex", F.col("col").cast("long").alias("col"), "y")


_P = "SELECT event_id, (((event_id * 7919) % 10007) + 1) / 10008.0::DOUBLE AS p_value FROM vals"


@query(sql("SELECT event_id, round(p_value, 6) AS p_value, round(least(1, min(q) OVER (ORDER BY p_value DESC)), 6) AS p_adjusted FROM (SELECT event_id, p_value, p_value * count(*) OVER () / rank AS q FROM (SELECT *, max(r) OVER (PARTITION BY p_value) AS rank FROM (SELECT *, row_number() OVER (ORDER BY p_value) AS r FROM pv)))", pv=_P))
def bh_adjust(spark, sf_dir):
    v = values(spark, sf_dir).select("event_id", ((((F.col("event_id") * 7919) % 10007) + 1) / 10008.0).alias("p_value"))
    return extrema.bh_adjust(v).select("event_id", r6("p_value"), r6("p_adjusted"))


@query(sql("SELECT event_id, round(p_value, 6) AS p_value FROM pv WHERE p_value < 0.05", pv=_P))
def significant_vertices(spark, sf_dir):
    v = values(spark, sf_dir).select("event_id", ((((F.col("event_id") * 7919) % 10007) + 1) / 10008.0).alias("p_value"))
    return extrema.significant(v, "p_value").select("event_id", r6("p_value"))


@query()
def perm_test(spark, sf_dir):
    b = Base(spark, sf_dir)
    return resample.permutation_test(b.fit(), b.y, b=49)[1]


@query()
def perm_audit(spark, sf_dir):
    b = Base(spark, sf_dir)
    return resample.permutation_test(b.fit(), b.y, b=49, subjects=b.subjects)[0]


@query()
def cluster_pvalue(spark, sf_dir):
    b = Base(spark, sf_dir)
    return pipelines.cluster_pvalues(b.fit(), b.y, 19)


@query()
def bayes_bootstrap(spark, sf_dir):
    b = Base(spark, sf_dir)
    return draws.bootstrap(b.fit(), b.y, b=49)


@query()
def bayes_bootstrap_global(spark, sf_dir):
    """The distance of the fitted values from the mean response over the draws, on three scales."""
    b = Base(spark, sf_dir)
    return draws.bootstrap_global(b.fit(binary=True), b.y.select("vertex", (F.col("y") < 5).cast("double").alias("y")), b=49)


@query()
def posterior(spark, sf_dir):
    b = Base(spark, sf_dir)
    return resample.posterior(b.fit(), b.y, b=100)


def _slope_test(spark, sf_dir, **options) -> DataFrame:
    b = Base(spark, sf_dir)
    return draws.slope_test(b.fit(), b.y, _first_feature(b), b=99, **options)


@query()
def lslope_test(spark, sf_dir):
    """Student's t on paired slopes, after a Box-Cox power where the differences are not normal."""
    return _slope_test(spark, sf_dir)


@query()
def lslope_wilcoxon(spark, sf_dir):
    return _slope_test(spark, sf_dir, test="wilcoxon", box_cox="never", slope="slope")


@query()
def lslope_weighted(spark, sf_dir):
    return _slope_test(spark, sf_dir, test="weighted.pvalue", box_cox="always", ascending=False)


_NEAR = "SELECT a.vertex, a.nbr, a.length, q.y - p.y AS dy, q.x[1] - p.x[1] AS dz FROM adj a JOIN points p ON p.vertex = a.vertex JOIN points q ON q.vertex = a.nbr"


def _first_feature(b: Base) -> DataFrame:
    return b.points.select("vertex", F.col("x")[0].alias("y"))


@query(sql("SELECT p.vertex, round(CASE WHEN e.dy > 0 THEN e.dz / e.dy ELSE 0 END, 6) AS slope FROM points p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vertex ORDER BY dy DESC, nbr) AS r FROM near) WHERE r = 1) e ON e.vertex = p.vertex", near=_NEAR))
def lslope(spark, sf_dir):
    b = Base(spark, sf_dir)
    return resample.local_slope(b.y, _first_feature(b), b.edges()).select("vertex", r6("slope"))


@query(sql("SELECT vertex, round(CASE WHEN sqrt(sum(w * dy * dy)) * sqrt(sum(w * dz * dz)) > 1e-10 THEN sum(w * dy * dz) / (sqrt(sum(w * dy * dy)) * sqrt(sum(w * dz * dz))) ELSE 0 END, 6) AS lcor FROM (SELECT *, 1 / (length * length) AS w FROM near) GROUP BY vertex", near=_NEAR))
def lcor(spark, sf_dir):
    b = Base(spark, sf_dir)
    return resample.local_correlation(b.y, _first_feature(b), b.edges(), "derivative").select("vertex", r6("lcor"))


@query(sql("SELECT event_id, round((value - m) / (1.4826 * d), 6) AS z FROM (SELECT *, median(abs(value - m)) OVER (PARTITION BY user_id) AS d FROM (SELECT *, median(value) OVER (PARTITION BY user_id) AS m, count(*) OVER (PARTITION BY user_id) AS c FROM vals)) WHERE d > 0 AND c >= 5"))
def robust_z(spark, sf_dir):
    return pipelines.robust_z(values(spark, sf_dir), "user_id", "value").select("event_id", r6("z"))


# -- mean shift and logistic fits


_MS = {
    "wt": "SELECT vertex, nbr, CASE WHEN t >= 1 THEN 0 ELSE 1 - t * t END AS w FROM (SELECT vertex, nbr, dist / (max(dist) OVER (PARTITION BY vertex) * 1.01) AS t FROM knn6 WHERE rank > 0)",
    "cells": "SELECT vertex, generate_subscripts(x, 1) AS c, unnest(x) AS v FROM points",
    "grad": "SELECT w.vertex, n.c, sum(w.w * n.v) / sum(w.w) - any_value(o.v) AS g FROM wt w JOIN cells n ON n.vertex = w.nbr JOIN cells o ON o.vertex = w.vertex AND o.c = n.c GROUP BY ALL",
    "unit": "SELECT vertex, c, g / sqrt(sum(g * g) OVER (PARTITION BY vertex)) AS g FROM grad",
    "proj": "SELECT w.vertex, w.nbr, any_value(w.w) AS w, abs(sum((n.v - o.v) * u.g)) AS a FROM wt w JOIN cells n ON n.vertex = w.nbr JOIN cells o ON o.vertex = w.vertex AND o.c = n.c JOIN unit u ON u.vertex = w.vertex AND u.c = n.c GROUP BY w.vertex, w.nbr",
    "mag": "SELECT vertex, sum(w * a) / sum(w) AS m FROM proj GROUP BY vertex",
}


@query(sql("SELECT o.vertex, round(sum(o.v + 0.1 * m.m * u.g), 5) AS total, round(max(CASE WHEN o.c = 1 THEN o.v + 0.1 * m.m * u.g END), 6) AS x0 FROM cells o JOIN unit u USING (vertex, c) JOIN mag m ON m.vertex = o.vertex GROUP BY o.vertex", **_MS))
def mean_shift_step(spark, sf_dir):
    b = Base(spark, sf_dir)
    x = meanshift.step(b.points, spectral._checkpointed(meanshift.neighbour_weights(b.knn())), 0.1)
    return x.select("vertex", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("total"), r6(F.col("x")[0], "x0"))


@query(sql("SELECT round(median(dist), 6) AS median_kdistance FROM knn WHERE rank = 5"))
def meanshift_kdist(spark, sf_dir):
    d = meanshift.median_kdistance(Base(spark, sf_dir).points, 6)
    return spark.createDataFrame([(round(d, 6),)], "median_kdistance double")


@query()
def mean_shift(spark, sf_dir):
    path, _ = meanshift.smooth(Base(spark, sf_dir).points, k=K, steps=2, method="adaptive")
    return path


def _logit_rows(spark, sf_dir) -> DataFrame:
    doc = tables.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("c"))
    rows = tables.table(spark, sf_dir, "labels").join(doc, "doc_id").select("doc_id", "c", F.col("quality").cast("double").alias("y"))
    m, s = rows.agg(F.avg("c"), F.stddev_samp("c")).first()
    return rows.select("doc_id", ((F.col("c") - m) / s).alias("x"), "y", F.lit(1.0).alias("w"), F.lit(1).alias("g"))


_LX = "SELECT doc_id, (c - avg(c) OVER ()) / stddev_samp(c) OVER () AS x, y FROM (SELECT l.doc_id, d.n_chars::DOUBLE AS c, l.quality::DOUBLE AS y FROM labels l JOIN documents d USING (doc_id))"


@query(sql("SELECT round(0.5 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), 6) AS b0, round(0.1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), 6) AS b1 FROM (SELECT sum(p - y) + 0.002 * 0.5 AS g0, sum((p - y) * x) + 0.002 * 0.1 AS g1, sum(p * (1 - p)) + 0.002 AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) + 0.002 AS h11 FROM (SELECT x - m AS x, y, 1 / (1 + exp(-(0.5 + 0.1 * (x - m)))) AS p FROM lx, (SELECT avg(x) AS m FROM lx)))", lx=_LX))
def ulogit_newton_step(spark, sf_dir):
    return logit.newton_step(_logit_rows(spark, sf_dir), 0.5, 0.1).select(r6("b0"), r6("b1"))


@query(sql("SELECT doc_id, round(1 / (1 + exp(-(0.7 - 0.3 * (x - 0.1)))), 6) AS prediction FROM lx", lx=_LX))
def ulogit_predict(spark, sf_dir):
    return _logit_rows(spark, sf_dir).select("doc_id", r6(logit.predict(F.col("x"), 0.7, -0.3, 0.1), "prediction"))


@query()
def ulogit(spark, sf_dir):
    """A fit for each half of the labelled documents, with left-out errors."""
    rows = _logit_rows(spark, sf_dir).withColumn("g", (F.col("doc_id") % 2).cast("int"))
    return logit.ulogit(rows, "g")


@query()
def eigen_ulogit(spark, sf_dir):
    """One fit over all rows, each of its steps an aggregation."""
    return logit.iwls_table(_logit_rows(spark, sf_dir), quadratic=True)[0].select("doc_id", "x", "y", "prediction", "loo_brier", "loo_deviance")


@query(sql("SELECT count(*) AS n, round(sum(y), 2) AS total, round(sum(y * x), 2) AS first, round(sum(y * x * x), 2) AS second FROM lx", lx=_LX))
def eigen_ulogit_moments(spark, sf_dir):
    """At the fit its curve has the moments of the response, which the SQL takes."""
    given = spectral._checkpointed(_logit_rows(spark, sf_dir))
    rows, b = logit.iwls_table(given, quadratic=True)
    curve = logit.predict_quadratic(F.col("x"), b.tolist(), given.agg(F.avg("x")).first()[0])
    m = lambda k: F.round(F.sum(curve * F.pow("x", F.lit(float(k)))), 2)
    return rows.agg(F.count("*").alias("n"), m(0).alias("total"), m(1).alias("first"), m(2).alias("second"))


@query(sql("SELECT doc_id, round(0.7 - 0.3 * (x - 0.1) + 0.05 * pow(x - 0.1, 2), 6) AS link, round(1 / (1 + exp(-(0.7 - 0.3 * (x - 0.1) + 0.05 * pow(x - 0.1, 2)))), 6) AS response FROM lx", lx=_LX))
def eigen_ulogit_predict(spark, sf_dir):
    at = lambda link: logit.predict_quadratic(F.col("x"), [0.7, -0.3, 0.05], 0.1, link)
    return _logit_rows(spark, sf_dir).select("doc_id", r6(at(True), "link"), r6(at(False), "response"))


# -- evaluation


_REC = "SELECT value AS y, value * 0.9 + 1 AS y_true, value * 0.8 + user_id / 100.0 AS y_hat FROM vals"


@query(sql("""SELECT count(*) AS n, round(sqrt(avg(pow(y - y_true, 2))), 6) AS rmse_raw, round(sqrt(avg(pow(y_hat - y_true, 2))), 6) AS rmse_fit, round(corr(y_hat, y_true), 6) AS cor_fit_truth, round(var_samp(y_hat) / var_samp(y_true), 6) AS var_ratio_fit_truth,
    round(avg(y_hat - y_true), 6) AS residual_mean, round(stddev_samp(y_hat - y_true), 6) AS residual_sd, round(max(abs(y_hat - y_true)), 6) AS residual_max_abs FROM rec""", rec=_REC))  # fmt: skip
def recovery_metrics(spark, sf_dir):
    v = values(spark, sf_dir).select(F.col("value").alias("y"), (F.col("value") * 0.9 + 1).alias("y_true"), (F.col("value") * 0.8 + F.col("user_id") / 100.0).alias("y_hat"))
    m = metrics.recovery(v)
    return m.select("n", *[r6(c) for c in ("rmse_raw", "rmse_fit", "cor_fit_truth", "var_ratio_fit_truth", "residual_mean", "residual_sd", "residual_max_abs")])


@query(sql("SELECT user_id, round(CASE WHEN d > 1.4901161193847656e-08 THEN d WHEN sd > 1.4901161193847656e-08 THEN sd ELSE 1 END, 6) AS scale FROM (SELECT user_id, 1.4826 * mad(value) AS d, stddev_samp(value) AS sd FROM vals GROUP BY user_id)"))
def col_scales(spark, sf_dir):
    return metrics.column_scales(values(spark, sf_dir), "user_id", "value").select("user_id", r6("scale"))


@query(sql("SELECT k.vertex, round(avg(p.y), 6) AS y_hat FROM knn6 k JOIN points p ON p.vertex = k.nbr WHERE rank > 0 GROUP BY k.vertex"))
def knn_mean(spark, sf_dir):
    b = Base(spark, sf_dir)
    return metrics.knn_mean(b.knn(), b.y).select("vertex", r6("y_hat"))


@query(sql("SELECT k.vertex, round(sum(exp(-dist * dist / 2) * p.y) / sum(exp(-dist * dist / 2)), 6) AS y_hat FROM knn6 k JOIN points p ON p.vertex = k.nbr WHERE rank > 0 GROUP BY k.vertex"))
def gaussian_kernel_smooth(spark, sf_dir):
    b = Base(spark, sf_dir)
    return metrics.gaussian_smooth(b.knn(), b.y, 1.0).select("vertex", r6("y_hat"))


_WS = "SELECT user_id, mu, CASE WHEN ess <= 1 THEN 0 ELSE sqrt(v / ess) END AS se FROM (SELECT user_id, any_value(mu) AS mu, sum(w * pow(value - mu, 2)) / sum(w) AS v, pow(sum(w), 2) / sum(w * w) AS ess FROM (SELECT *, sum(w * value) OVER (PARTITION BY user_id) / sum(w) OVER (PARTITION BY user_id) AS mu FROM (SELECT user_id, value, (1 + event_id % 3)::DOUBLE AS w FROM vals)) GROUP BY user_id)"


def _weighted(spark, sf_dir) -> DataFrame:
    v = values(spark, sf_dir).withColumn("w", (1 + F.col("event_id") % 3).cast("double"))
    return metrics.weighted_summary(v, "user_id", "value", "w")


@query(sql("SELECT user_id, round(mu, 6) AS mean, round(se, 6) AS se FROM ws", ws=_WS))
def weighted_se(spark, sf_dir):
    return _weighted(spark, sf_dir).select("user_id", r6("mean"), r6("se"))


@query(sql("SELECT k, n_eigenpairs, round(mean, 6) AS mean FROM m WHERE mean <= (SELECT arg_min(mean + se, mean) FROM m) ORDER BY n_eigenpairs, k DESC LIMIT 1", ws=_WS, m="SELECT user_id AS k, user_id % 4 AS n_eigenpairs, mu AS mean, se FROM ws"))
def one_se_select(spark, sf_dir):
    m = _weighted(spark, sf_dir).select(F.col("user_id").alias("k"), (F.col("user_id") % 4).alias("n_eigenpairs"), F.lit(0.0).alias("eta"), "mean", "se")
    return metrics.one_se_rule(m).select("k", "n_eigenpairs", r6("mean"))


@query(sql("SELECT r2 AS r_squared, round(1 - (1 - raw) * (n - 1) / (n - 6), 6) AS adj_r_squared, rmse, mae, n, sigma FROM (SELECT 1 - sum(pow(y - y_hat, 2)) / (var_pop(y) * count(*)) AS raw, round(raw, 6) AS r2, round(sqrt(avg(pow(y - y_hat, 2))), 6) AS rmse, round(avg(abs(y - y_hat)), 6) AS mae, count(*) AS n, round(stddev_samp(y - y_hat), 6) AS sigma FROM rec)", rec=_REC))
def fit_summary(spark, sf_dir):
    v = values(spark, sf_dir).select(F.col("value").alias("y"), (F.col("value") * 0.8 + F.col("user_id") / 100.0).alias("y_hat"))
    return plans.summary(v, 5).select(r6("r_squared"), r6("adj_r_squared"), r6("rmse"), r6("mae"), "n", r6("sigma"))


@query(sql("SELECT user_id AS col, count(*) AS n, round(sqrt(avg(r * r)), 6) AS rmse, round(avg(abs(r)), 6) AS mae, round(max(abs(r)), 6) AS max_abs FROM (SELECT user_id, value - 50 AS r FROM vals WHERE event_id % 7 <> 0) GROUP BY user_id"))
def refit_summary(spark, sf_dir):
    v = values(spark, sf_dir).select(F.col("user_id").alias("col"), F.when(F.col("event_id") % 7 != 0, F.col("value") - 50).alias("residual"))
    return plans.refit_summary(v).select("col", "n", r6("rmse"), r6("mae"), r6("max_abs"))


_LS = "SELECT p_value, least(1, 2 * p_value) AS p_adjusted, p_value - 0.5 AS effect FROM pv"


@query(sql("SELECT count(*) AS n_tested, count_if(p_adjusted < 0.05) AS n_05, count_if(p_adjusted < 0.01) AS n_01, count_if(p_adjusted < 0.001) AS n_001, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_q{int(100 * q)}" for c in ("p_value", "p_adjusted", "effect") for q in (0.25, 0.5, 0.75)) + " FROM ls", pv=_P, ls=_LS))
def lslope_summary(spark, sf_dir):
    v = values(spark, sf_dir).select(((((F.col("event_id") * 7919) % 10007) + 1) / 10008.0).alias("p_value"))
    out = pipelines.lslope_summary(v.select("p_value", F.least(F.lit(1.0), 2 * F.col("p_value")).alias("p_adjusted"), (F.col("p_value") - 0.5).alias("effect")))
    return out.select(*[c if c.startswith("n_") else r6(c) for c in out.columns])


@query()
def fit_report(spark, sf_dir):
    return plans.report(Base(spark, sf_dir).fit())


# -- compound plans


@query()
def componentwise_fit(spark, sf_dir):
    b = Base(spark, sf_dir)
    return pipelines.componentwise_fit(b.points, b.y, k=2)


@query()
def data_smoother(spark, sf_dir):
    return pipelines.data_smoother(Base(spark, sf_dir).points, 3, 5)[0]


@query()
def lp_graphs(spark, sf_dir):
    f = features(spark, sf_dir)
    y = f.select("vertex", F.log1p(F.col("x")[1]).alias("y"))
    return pipelines.lp_graphs(f, y, [0.25, 0.5, 1.0], [6, 8])


@query(sql("SELECT vertex, p, round(list_sum(list_transform(x, lambda v: pow(v, p))), 6) AS total FROM feat, (SELECT unnest([0.25, 1.0]::DOUBLE[]) AS p)"))
def lp_load(spark, sf_dir):
    """Writes results by p, then reads two of the partitions."""
    return pipelines.lp_round_trip(features(spark, sf_dir), [0.25, 0.5, 1.0], [0.25, 1.0]).select("vertex", "p", r6("total"))


@query()
def iknn_response_pipeline(spark, sf_dir):
    b = Base(spark, sf_dir)
    return pipelines.iknn_response(b.points, b.y, [3, 5])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral_smooth(spark, sf_dir)



# -- sources and sinks


@query(sql("SELECT vertex, rank::BIGINT AS rank, nbr, round(dist, 6) AS dist FROM knn6"))
def knn_cache(spark, sf_dir):
    """Neighbours by way of the cache: written once, read the second time."""
    path = f"{tables.shared_folder(spark)}/knn-{uuid.uuid4().hex}"
    points = Base(spark, sf_dir).points
    make = lambda: graph.knn(points, K + 1)
    tables.cached(spark, path, "readwrite", make, points)
    return tables.cached(spark, path, "read", make, points).select("vertex", F.col("rank").cast("long").alias("rank"), "nbr", r6("dist"))


@query(sql("SELECT event_id, user_id, value FROM vals"))
def csv_append(spark, sf_dir):
    """Two appends to one CSV folder, read back."""
    path = f"{tables.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    v = values(spark, sf_dir)
    for part in (0, 1):
        tables.csv_append(v.where(F.col("event_id") % 2 == part), path)
    return tables.csv_read(spark, path, "event_id long, user_id long, value double")


@query(sql("SELECT vertex, round(y, 6) AS y FROM points"))
def save_object(spark, sf_dir):
    """An artifact under a path of its own, read back."""
    return spark.read.parquet(tables.save_object(Base(spark, sf_dir).y, tables.shared_folder(spark), "response"))


@query(sql("SELECT unnest([0.5, 2.0]::DOUBLE[]) AS p"))
def lp_missing(spark, sf_dir):
    """Of four wanted p two are written already and can be skipped."""
    path = f"{tables.shared_folder(spark)}/lp-{uuid.uuid4().hex}"
    tables.lp_save(features(spark, sf_dir).select("vertex").crossJoin(spark.createDataFrame([(0.25,), (1.0,)], "p double")), path)
    return spark.createDataFrame([(p,) for p in tables.lp_missing(spark, path, [0.25, 0.5, 1.0, 2.0])], "p double")


_CIRCLE = f"""SELECT vertex, theta, exp(-0.5 * pow((theta - 1.5) / 0.5, 2)) - exp(-0.5 * pow((theta - 4.0) / 0.7, 2)) AS y_true,
    sqrt(-2 * ln(1 - {_U.format("'7:' || vertex || ':x0r'")})) * cos(2 * pi() * {_U.format("'7:' || vertex || ':x0a'")}) AS z0, sqrt(-2 * ln(1 - {_U.format("'7:' || vertex || ':yr'")})) * cos(2 * pi() * {_U.format("'7:' || vertex || ':ya'")}) AS zy
    FROM (SELECT vertex, 2 * pi() * 0.8 * {_U.format("'7:' || vertex || ':theta'")} AS theta FROM points)"""


@query(sql("SELECT vertex, round(cos(theta) + 0.05 * z0, 6) AS x0, round(y_true, 6) AS y_true, round(y_true + 0.1 * zy, 6) AS y FROM cir", cir=_CIRCLE))
def synthetic_circle(spark, sf_dir):
    c = synthetic.circle(Base(spark, sf_dir).vertices, gap=0.2, seed=7)
    return c.select("vertex", r6(F.col("x")[0], "x0"), r6("y_true"), r6("y"))


@query(sql("SELECT vertex, round(t, 6) AS x0, round(exp(-0.5 * pow((t - 0.2) / 0.06, 2)) - 0.8 * exp(-0.5 * pow((t - 0.5) / 0.08, 2)) + 1.2 * exp(-0.5 * pow((t - 0.8) / 0.05, 2)), 6) AS y_true FROM (SELECT vertex, vertex / (SELECT max(vertex)::DOUBLE FROM points) AS t FROM points)"))
def synthetic_mixture(spark, sf_dir):
    return synthetic.mixture(Base(spark, sf_dir).vertices).select("vertex", r6(F.col("x")[0], "x0"), r6("y_true"))


@query(sql(f"SELECT vertex, vertex % 3 AS arm, round(CASE vertex % 3 WHEN 1 THEN t WHEN 2 THEN -t ELSE 0 END, 6) AS y_true FROM (SELECT vertex, {_U.format("'1:' || vertex || ':t'")} AS t FROM points)"))
def synthetic_branches(spark, sf_dir):
    return synthetic.branches(Base(spark, sf_dir).vertices).select("vertex", (F.col("vertex") % 3).alias("arm"), r6("y_true"))


# -- further graphs, operators and pieces of the tests


@query(sql("SELECT least(vertex, w) AS i, greatest(vertex, w) AS j, 1.0::DOUBLE AS length FROM (SELECT vertex, lead(vertex) OVER (ORDER BY vertex) AS w FROM points) WHERE w IS NOT NULL"))
def path_graph(spark, sf_dir):
    return graph.path(Base(spark, sf_dir).vertices)


@query(sql("SELECT i, j, round(min(length), 6) AS length FROM (SELECT i, j, length FROM edges UNION ALL SELECT vertex, w, 0.5 FROM (SELECT vertex, lead(vertex) OVER (ORDER BY vertex) AS w FROM points) WHERE w IS NOT NULL) GROUP BY i, j"))
def planted_edges(spark, sf_dir):
    """A path of short edges planted in the neighbour graph."""
    b = Base(spark, sf_dir)
    return graph.planted(b.edges(), graph.path(b.vertices).withColumn("length", F.lit(0.5))).select("i", "j", r6("length"))


_B2 = "SELECT v0 AS i, v1 AS j, v0, v1, v2, 1 AS sign FROM tri UNION ALL SELECT v0, v2, v0, v1, v2, -1 FROM tri UNION ALL SELECT v1, v2, v0, v1, v2, 1 FROM tri"


@query(sql("SELECT i, j, v0, v1, v2, sign FROM b2", b2=_B2))
def boundary2(spark, sf_dir):
    edges, sets, _, _ = Base(spark, sf_dir).geometry()
    return measures.boundary2(graph.triangles(edges, sets))


@query(sql("""SELECT i, j, i2, j2, round(sum(val) / 1000, 3) AS val FROM (
    SELECT a.i, a.j, b.i AS i2, b.j AS j2, a.s * b.s * greatest(r.rho, 1e-8) / greatest(m.rho, 1e-15) AS val FROM inc a JOIN inc b USING (vertex) JOIN rho0 r USING (vertex) JOIN rho1 m ON m.i = a.i AND m.j = a.j
    UNION ALL SELECT a.i, a.j, b.i, b.j, a.sign * b.sign / greatest(tm.val, 1e-15) * greatest(m.rho, 1e-15) FROM b2 a JOIN b2 b USING (v0, v1, v2) JOIN tm USING (v0, v1, v2) JOIN rho1 m ON m.i = b.i AND m.j = b.j) GROUP BY i, j, i2, j2""",
    b2=_B2, inc="SELECT i, j, i AS vertex, -1 AS s FROM edges UNION ALL SELECT i, j, j, 1 FROM edges",
    tm="SELECT t.v0, t.v1, t.v2, sum(r.rho) AS val FROM tri t JOIN sets a ON a.vertex = t.v0 JOIN sets b ON b.vertex = t.v1 AND b.member = a.member JOIN sets c ON c.vertex = t.v2 AND c.member = a.member JOIN rho0 r ON r.vertex = a.member GROUP BY ALL"))
def hodge_l1(spark, sf_dir):
    """Down and up terms, in thousands."""
    edges, sets, rho0, rho1 = Base(spark, sf_dir).geometry()
    mass = spectral._checkpointed(measures.triangle_mass(graph.triangles(edges, sets, _weights(rho0)), sets, rho0))
    return measures.hodge_l1(rho0, rho1, mass).select("i", "j", "i2", "j2", F.round(F.col("val") / 1000, 3).alias("val"))


@query(sql("SELECT user_id, round(coalesce(list_sum(list_transform(list_filter(x, lambda t: t / 40 < 1), lambda t: 1 - pow(t / 40, 2))), 0), 6) AS total, len(list_filter(x, lambda t: t / 40 < 1)) - 1 AS stop FROM (SELECT user_id, list_sort(list(value)) AS x FROM positive GROUP BY user_id)"))
def kernel_stop(spark, sf_dir):
    """Epanechnikov weights of ascending distances, up to where they vanish."""
    x = positive(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("x"))
    k = x.select("user_id", fx.kernel_with_stop("epanechnikov", F.col("x"), 40.0).alias("k"))
    total = F.aggregate(F.slice("k.w", 1, F.col("k.stop") + 1), F.lit(0.0), lambda a, w: a + w)
    return k.select("user_id", r6(total, "total"), F.col("k.stop").cast("long").alias("stop"))


@query(sql("SELECT p, arg_min(k, struct_pack(a := gcv, b := k)) AS opt_k, round(min(gcv), 6) AS gcv, count(*) AS n_connected_k FROM (SELECT (user_id % 7) / 10.0::DOUBLE AS p, event_id AS k, value AS gcv FROM vals WHERE event_id % 3 <> 0) GROUP BY p"))
def lp_summary(spark, sf_dir):
    rows = values(spark, sf_dir).select((F.col("user_id") % 7 / 10.0).alias("p"), F.col("event_id").alias("k"), F.when(F.col("event_id") % 3 != 0, "success").otherwise("skipped").alias("status"), F.col("value").alias("gcv"))
    return pipelines.lp_summary(rows).select("p", "opt_k", r6("gcv"), "n_connected_k")


@query(sql(f"SELECT vertex, floor(5 * {_U.format("'1:' || vertex")})::INT AS fold FROM points"))
def cv_folds(spark, sf_dir):
    return pipelines.dealt_folds(Base(spark, sf_dir).vertices, 5)


@query()
def cross_validate(spark, sf_dir):
    """Masked refits of the first four features."""
    b = Base(spark, sf_dir)
    return pipelines.cross_validate(b.fit(), b.points.select("vertex", F.posexplode(F.slice("x", 1, 4)).alias("col", "y")))


_DRAW = f"SELECT b, vertex, row_number() OVER (PARTITION BY b ORDER BY {_U.format("'1:' || b || ':' || vertex")}, vertex) AS r FROM points, range(1, 20) t(b)"


@query(sql("SELECT p.vertex, round((1 + count_if(abs(q.y - m) >= abs(p.y - m))) / 20.0, 6) AS p_value FROM points p JOIN dr ON dr.vertex = p.vertex JOIN (SELECT y, row_number() OVER (ORDER BY vertex) AS r FROM points) q ON q.r = dr.r, (SELECT avg(y) AS m FROM points) GROUP BY p.vertex", dr=_DRAW))
def perm_p_values(spark, sf_dir):
    """p values of the response itself among its permutations."""
    y = Base(spark, sf_dir).y
    own = y.select("vertex", F.col("y").alias("y_hat"))
    drawn = resample.permuted(y, 19, 1).select("vertex", "col", F.col("y").alias("y_hat"))
    return resample.p_values(own, drawn, y.agg(F.avg("y")).first()[0], 19).select("vertex", r6("p_value"))


@query(sql("""SELECT vertex, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper, round(stddev_samp(v), 6) AS sd, round(avg((v > m)::INT), 6) AS p_above, round(least(1, 2 * least(avg((v > m)::INT), 1 - avg((v > m)::INT))), 6) AS pseudo_p
    FROM (SELECT vertex, b, count(*) OVER (PARTITION BY b) * e / sum(e) OVER (PARTITION BY b) * y AS v FROM ex), (SELECT avg(y) AS m FROM points) GROUP BY vertex""",
    ex=f"SELECT b, vertex, y, -ln(1 - {_U.format("'1:' || b || ':' || vertex")}) AS e FROM points, range(1, 20) t(b)"))
def dirichlet_intervals(spark, sf_dir):
    """Intervals of the response itself under Dirichlet weights."""
    y = Base(spark, sf_dir).y
    drawn = resample.dirichlet(y, 19, 1).select("vertex", "col", F.col("y").alias("y_hat"))
    return resample.intervals(drawn, y.agg(F.avg("y")).first()[0]).select("vertex", *[r6(c) for c in ("lower", "upper", "sd", "p_above", "pseudo_p")])


@query(sql("SELECT user_id AS vertex, round(s[floor(0.025 * (len(s) - 1))::INT + 1], 6) AS lower, round(s[floor(0.975 * (len(s) - 1))::INT + 1], 6) AS upper, round(sd, 6) AS sd FROM (SELECT user_id, list_sort(list(value)) AS s, stddev_samp(value) AS sd FROM vals GROUP BY user_id HAVING count(*) > 1)"))
def credible_intervals(spark, sf_dir):
    """Order statistics and deviations of arrays of draws: here a user's values."""
    s = values(spark, sf_dir).groupBy(F.col("user_id").alias("vertex"), F.lit(0).alias("col")).agg(F.collect_list("value").alias("s")).where(F.size("s") > 1)
    return plans.credible(s, 0.95).select("vertex", r6("lower"), r6("upper"), r6("sd"))


@query(sql("SELECT user_id AS col, arg_min(eta, struct_pack(a := g, b := eta)) AS eta, round(min(g), 6) AS gcv FROM (SELECT user_id, eta, greatest(yy - list_sum(list_transform(range(1, 6), lambda k: (2 / (1 + eta * (k - 1)) - pow(1 / (1 + eta * (k - 1)), 2)) * pow(a[k], 2))), 0) / pow(n - list_sum(list_transform(range(0, 5), lambda k: 1 / (1 + eta * k))), 2) AS g FROM ua, (SELECT unnest([0.1, 1.0, 10.0]::DOUBLE[]) AS eta)) GROUP BY user_id",
           ua="SELECT user_id, list(value ORDER BY event_id)[1:5] AS a, sum(value * value) AS yy, count(*) AS n FROM vals GROUP BY user_id HAVING count(*) > 5"))
def gcv_score(spark, sf_dir):
    """The score itself: a user's first five values stand for coefficients of five modes."""
    rows = values(spark, sf_dir).groupBy(F.col("user_id").alias("col")).agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("v"), F.sum(F.col("value") * F.col("value")).alias("yy"), F.count("*").alias("n")).where("n > 5")
    coef = rows.select("col", F.expr("transform(slice(v, 1, 5), e -> e.value)").alias("a"), "yy", "n")
    return spectral.gcv_by_column(coef, np.arange(5.0), "tikhonov", [0.1, 1.0, 10.0], ["col"]).select("col", "eta", r6("gcv"))


@query(sql("SELECT count(DISTINCT component) AS zero_modes FROM comp"))
def zero_modes(spark, sf_dir):
    """A graph has as many modes of eigenvalue zero as components."""
    b = Base(spark, sf_dir)
    edges = b.sparse()
    _, rho0, rho1 = plans.geometry(b.vertices, edges, K)
    lap = spectral._checkpointed(measures.laplacian(rho0, rho1))
    return spark.createDataFrame([(spectral.zero_modes(lap, rho0.select("vertex", F.sqrt("rho").alias("x"))),)], "zero_modes long")


@query(sql("SELECT vertex, y AS b, 0.0::DOUBLE AS residual FROM points"))
def tikhonov_residual(spark, sf_dir):
    """What (I + eta L) x leaves of the right side, by a product that takes no part in the solution."""
    b = Base(spark, sf_dir)
    _, _, rho0, rho1 = b.geometry()
    lap = spectral._checkpointed(measures.laplacian(rho0, rho1))
    x = spectral._checkpointed(walks.tikhonov(lap, b.y.withColumnRenamed("y", "x"), 0.5))
    product = spectral.multiply(lap, x).withColumnRenamed("x", "lx")
    r = F.col("x") + 0.5 * F.coalesce("lx", F.lit(0.0)) - F.col("y")
    return b.y.join(x, "vertex").join(product, "vertex", "left").select("vertex", F.col("y").alias("b"), F.abs(F.round(r, 3)).alias("residual"))


@query(sql("SELECT k AS mode, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS norm FROM range(10) t(k)"))
def spectrum_residual(spark, sf_dir):
    """Residuals of the fit's eigenpairs relative to the operator's largest entry, and their norms."""
    model = Base(spark, sf_dir).fit()
    size = model.laplacian.agg(F.max(F.abs("val"))).first()[0]
    off = spectral.residuals(model.laplacian, model.spectrum.vectors, model.spectrum.values) / size
    norms = model.spectrum.vectors.agg(*[F.sqrt(F.sum(F.col("v")[k] * F.col("v")[k])) for k in range(len(off))]).first()
    return spark.createDataFrame([(k, abs(round(float(r), 6)), round(n, 6)) for k, (r, n) in enumerate(zip(off, norms))], "mode long, residual double, norm double")


@query(sql("SELECT round(sum(c * c) / pow(sum(c) FILTER (i = j), 2), 6) AS share_squares FROM (SELECT a.c AS i, b.c AS j, covar_samp(a.v, b.v) AS c FROM cells a JOIN cells b USING (vertex) GROUP BY ALL)", cells=_MS["cells"]))
def pca_spread(spark, sf_dir):
    """The sum of squared variance shares is the covariance's squared norm over its squared trace."""
    _, share = metrics.pca(Base(spark, sf_dir).points)
    parts = np.diff(np.concatenate([[0.0], share]))
    return spark.createDataFrame([(round(float((parts**2).sum()), 6),)], "share_squares double")


@query(sql("""SELECT p.vertex, CASE WHEN p.y = (SELECT max(y) FROM points) THEN -1 WHEN s.source IS NULL THEN 0 ELSE coalesce(r.radius, 0) END::INT AS radius FROM points p LEFT JOIN src s ON s.source = p.vertex LEFT JOIN rad r ON r.source = p.vertex""", recursive=True,
    src="SELECT p.vertex AS source, any_value(p.y) AS fs FROM points p LEFT JOIN adj a ON a.vertex = p.vertex LEFT JOIN points q ON q.vertex = a.nbr GROUP BY p.vertex HAVING (max(q.y) IS NULL OR any_value(p.y) > max(q.y)) AND any_value(p.y) < (SELECT max(y) FROM points)",
    bfs="SELECT source, source AS vertex, 0 AS hop FROM src UNION SELECT b.source, a.nbr, b.hop + 1 FROM bfs b JOIN adj a ON a.vertex = b.vertex WHERE b.hop < 12",
    first="SELECT source, vertex, min(hop) AS hop FROM bfs GROUP BY ALL HAVING min(hop) > 0",
    ring="SELECT source, hop, sum(rho) AS t, sum(CASE WHEN fs > p.y THEN rho ELSE 0 END) AS g FROM first JOIN src USING (source) JOIN points p USING (vertex) JOIN rho0 USING (vertex) GROUP BY source, hop",
    cum="SELECT source, hop, sum(t) OVER (PARTITION BY source ORDER BY hop) AS t, sum(g) OVER (PARTITION BY source ORDER BY hop) AS g, max(hop) OVER (PARTITION BY source) AS far FROM ring",
    rad="SELECT source, CASE WHEN min(hop) FILTER (g / t < 0.87) IS NULL THEN least(12, any_value(far) + 1) ELSE min(hop) FILTER (g / t < 0.87) - 1 END AS radius FROM cum GROUP BY source").replace("bfs AS MATERIALIZED", "bfs AS"))
def hop_radius_of_labels(spark, sf_dir):
    """Hops up to which the strict maxima of the response itself stay above at least 87 % of the density."""
    b = Base(spark, sf_dir)
    edges, _, rho0, _ = b.geometry()
    return extrema.hop_radius(b.y, edges, rho0, 0.87, max_hop=12)


# -- further ways to fit


@query()
def pca_fit(spark, sf_dir):
    """Features projected to at most ten components before the graph is built."""
    return Base(spark, sf_dir).fit(pca_dim=10, variance_explained=0.8).fitted


@query()
def coherence_fit(spark, sf_dir):
    """Edge masses lowered where the fitted response changes."""
    return Base(spark, sf_dir).fit(gamma=0.5, max_iterations=2).fitted


@query()
def refit_labeled(spark, sf_dir):
    """The first four features, taught by two thirds of the vertices."""
    b = Base(spark, sf_dir)
    responses = b.points.select("vertex", F.posexplode(F.slice("x", 1, 4)).alias("col", "y"))
    return plans.refit(b.fit(), responses, labeled=b.vertices.where("vertex % 3 != 0"))[0]


@query()
def refit_posterior(spark, sf_dir):
    b = Base(spark, sf_dir)
    responses = b.points.select("vertex", F.posexplode(F.slice("x", 1, 4)).alias("col", "y"))
    return plans.credible(plans.refit_samples(b.fit(), responses, 50))


@query()
def lcor_posterior(spark, sf_dir):
    b = Base(spark, sf_dir)
    return resample.lcor_posterior(b.fit(), b.points.select("vertex", F.posexplode(F.slice("x", 1, 2)).alias("col", "y")), 20)


def _full(spark, sf_dir) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The full coboundary, and the product of the edge masses with edges' values (i, j, x)."""
    b = Base(spark, sf_dir)
    edges, sets, rho0, rho1 = b.geometry()
    common = members.edge_members(rho1, rho0, sets)
    if common is not None:
        common = spectral._checkpointed(common)
        diagonal = rho1.select("i", "j", F.greatest("rho", F.lit(1e-15)).alias("d"))
        return extrema.coboundary_by_members(b.y, rho0, rho1, common), lambda x: members.times(diagonal, common, x)
    mass = spectral._checkpointed(measures.edge_mass(edges, graph.triangles(edges, sets, _weights(rho0)), rho1, rho0, sets))
    product = lambda x: mass.join(x.select(F.col("i").alias("i2"), F.col("j").alias("j2"), "x"), ["i2", "j2"]).groupBy("i", "j").agg(F.sum(F.col("val") * F.col("x")).alias("x"))
    return extrema.coboundary_full(b.y, rho0, mass), product


@query()
def coboundary_full(spark, sf_dir):
    """With edge masses off the diagonal too."""
    return _full(spark, sf_dir)[0].select("i", "j", "delta")


@query(sql("SELECT e.i, e.j, round(greatest(b.rho, 1e-15) * pb.y - greatest(a.rho, 1e-15) * pa.y, 3) AS product FROM rho1 e JOIN rho0 a ON a.vertex = e.i JOIN rho0 b ON b.vertex = e.j JOIN points pa ON pa.vertex = e.i JOIN points pb ON pb.vertex = e.j"))
def coboundary_product(spark, sf_dir):
    """The edge masses times the full coboundary give back the equation's right side, which the SQL takes from the vertices."""
    found, product = _full(spark, sf_dir)
    given = product(spectral._checkpointed(found).select("i", "j", F.col("delta").alias("x")))
    # a hair above zero, so that no product of rounding rounds to -0
    return given.select("i", "j", (F.round("x", 3) + 0.0).alias("product"))


# -- modulation of triangles, one-sided tests and choices

_TM = "SELECT t.v0, t.v1, t.v2, sum(r.rho) AS val FROM tri t JOIN sets a ON a.vertex = t.v0 JOIN sets b ON b.vertex = t.v1 AND b.member = a.member JOIN sets c ON c.vertex = t.v2 AND c.member = a.member JOIN rho0 r ON r.vertex = a.member GROUP BY ALL"
_QUARTILES = "SELECT greatest(max(d) FILTER (r = 3 * n // 4 + 1) - max(d) FILTER (r = n // 4 + 1), 1e-10) AS s FROM (SELECT d, row_number() OVER (ORDER BY d) AS r, count(*) OVER () AS n FROM {})"


@query(sql("SELECT i, j, i2, j2, round(val * (SELECT sum(old) FROM lowered) / (SELECT sum(val) FROM lowered), 6) AS val FROM lowered",
           tm=_TM, ed="SELECT e.i, e.j, greatest(e.rho, 1e-15) AS old, abs(a.y - b.y) AS d FROM rho1 e JOIN points a ON a.vertex = e.i JOIN points b ON b.vertex = e.j",
           td="SELECT tm.*, greatest(a.y, b.y, c.y) - least(a.y, b.y, c.y) AS d FROM tm JOIN points a ON a.vertex = v0 JOIN points b ON b.vertex = v1 JOIN points c ON c.vertex = v2",
           s1=_QUARTILES.format("ed"), s2=_QUARTILES.format("td"),
           sides="SELECT v0, v1, v2, val, d, unnest([[v0, v1], [v0, v2], [v1, v2]]) AS x FROM td",
           pairs="SELECT a.x AS x, b.x AS y, a.val, a.d FROM sides a JOIN sides b USING (v0, v1, v2) WHERE a.x <> b.x",
           most="SELECT x, y, max(d) AS d FROM pairs GROUP BY ALL",
           lowered="""SELECT i, j, i AS i2, j AS j2, old, old * pow(1 + pow(d / (SELECT s FROM s1), 2), -0.5) AS val FROM ed
             UNION ALL SELECT p.x[1], p.x[2], p.y[1], p.y[2], p.val, p.val * pow(1 + pow(m.d / (SELECT s FROM s2), 2), -0.5) FROM pairs p JOIN most m USING (x, y)"""))  # fmt: skip
def triangle_modulation(spark, sf_dir):
    """Edge masses lowered where the response changes, between the edges of a triangle too."""
    b = Base(spark, sf_dir)
    edges, sets, rho0, rho1 = b.geometry()
    tri = spectral._checkpointed(graph.triangles(edges, sets, _weights(rho0)))
    mass = spectral._checkpointed(measures.edge_mass(edges, tri, rho1, rho0, sets))
    return measures.triangle_modulation(mass, tri, b.y, 0.5).select("i", "j", "i2", "j2", r6("val"))


@query(sql("SELECT p.vertex, round((1 + count_if(q.y >= p.y)) / 20.0, 6) AS p_value FROM points p JOIN dr ON dr.vertex = p.vertex JOIN (SELECT y, row_number() OVER (ORDER BY vertex) AS r FROM points) q ON q.r = dr.r GROUP BY p.vertex", dr=_DRAW))
def perm_p_values_upper(spark, sf_dir):
    """One-sided p values of the response itself among its permutations."""
    y = Base(spark, sf_dir).y
    own = y.select("vertex", F.col("y").alias("y_hat"))
    drawn = resample.permuted(y, 19, 1).select("vertex", "col", F.col("y").alias("y_hat"))
    return resample.p_values(own, drawn, y.agg(F.avg("y")).first()[0], 19, two_sided=False).select("vertex", r6("p_value"))


@query(sql("""SELECT b AS col, round(sum(pow(d, 2)), 5) AS l2, round(sum(d), 5) AS l1, round(sum(pow(d, 3)), 4) AS lp, round(max(d), 6) AS max FROM
    (SELECT b, abs(q.y * exp(-dr.r / 500.0) - m) AS d FROM dr JOIN (SELECT y, row_number() OVER (ORDER BY vertex) AS r FROM points) q ON q.r = dr.r, (SELECT avg(y) AS m FROM points)) GROUP BY b""",
    dr=_DRAW))
def perm_statistics(spark, sf_dir):
    """Global statistics of permuted responses that are damped by rank."""
    y = Base(spark, sf_dir).y
    n, mean = y.agg(F.count("*"), F.avg("y")).first()
    rank = graph.numbered(y, ["vertex"], "r").select(F.col("vertex").alias("home"), "r", "y")
    drawn = resample.permuted(rank.select(F.col("home").alias("vertex"), F.col("r").cast("double").alias("y")), 19, 1)
    rows = drawn.join(rank.select(F.col("r").cast("double").alias("r"), F.col("y").alias("v")), drawn.y == F.col("r")).select("col", (F.col("v") * F.exp(-F.col("r") / 500.0)).alias("y_hat"))
    out = resample.global_statistics(rows, mean, n, ["col"], 3.0)
    return out.select(F.col("col").cast("long").alias("col"), F.round("l2", 5).alias("l2"), F.round("l1", 5).alias("l1"), F.round("lp", 4).alias("lp"), r6("max"))


@query()
def mean_shift_denoised(spark, sf_dir):
    """Points at the step whose median k-distance is least."""
    out, step = meanshift.denoised(Base(spark, sf_dir).points, k=K, steps=3)
    return out.withColumn("step", F.lit(step))


@query(sql("SELECT (SELECT x FROM curve ORDER BY fit, x LIMIT 1) AS best, min(x) AS low, max(x) AS high FROM curve WHERE lower <= (SELECT upper FROM curve ORDER BY fit, x LIMIT 1)",
           curve="SELECT user_id::DOUBLE AS x, avg(value) AS fit, avg(value) - stddev_samp(value) / sqrt(count(*)) AS lower, avg(value) + stddev_samp(value) / sqrt(count(*)) AS upper FROM vals GROUP BY user_id HAVING count(*) > 1"))
def equivalence_range(spark, sf_dir):
    """Users whose mean value, less its error, does not exceed the least mean with its error."""
    error = F.stddev_samp("value") / F.sqrt(F.count("*"))
    curve = values(spark, sf_dir).groupBy(F.col("user_id").cast("double").alias("x")).agg(F.avg("value").alias("fit"), (F.avg("value") - error).alias("lower"), (F.avg("value") + error).alias("upper"), F.count("*").alias("n"))
    return pipelines.equivalent_range(spectral._checkpointed(curve.where("n > 1")))


def _lcor_sql(dy: str, dz: str) -> str:
    return sql(f"SELECT vertex, round(CASE WHEN sqrt(sum(pow({dy}, 2))) * sqrt(sum(pow({dz}, 2))) > 1e-10 THEN sum({dy} * {dz}) / (sqrt(sum(pow({dy}, 2))) * sqrt(sum(pow({dz}, 2)))) ELSE 0 END, 6) AS lcor FROM near GROUP BY vertex", near=_NEAR)


@query(_lcor_sql("dy", "dz"))
def lcor_unit(spark, sf_dir):
    b = Base(spark, sf_dir)
    return resample.local_correlation(b.y, _first_feature(b), b.edges(), "unit").select("vertex", r6("lcor"))


@query(_lcor_sql("sign(dy)", "sign(dz)"))
def lcor_sign(spark, sf_dir):
    b = Base(spark, sf_dir)
    return resample.local_correlation(b.y, _first_feature(b), b.edges(), "sign").select("vertex", r6("lcor"))


@query(sql("SELECT event_id, round(tanh(value / 40 - 1), 6) AS tanh, round(2 / pi() * atan(value / 40 - 1), 6) AS arctan, round((value / 40 - 1) / sqrt(1 + pow(value / 40 - 1, 2)), 6) AS algebraic FROM vals"))
def sigmoids(spark, sf_dir):
    """Bounded slopes onto (-1, 1)."""
    x = F.col("value") / 40 - 1
    return values(spark, sf_dir).select("event_id", *[r6(fx.bounded_slope(k, x), k) for k in ("tanh", "arctan", "algebraic")])


@query(sql("SELECT p.vertex, round(CASE WHEN coalesce(sum(e.dy * e.dy), 0) > 1e-15 THEN sum(e.dy * e.dz) / sum(e.dy * e.dy) ELSE 0 END, 6) AS slope FROM points p LEFT JOIN near e ON e.vertex = p.vertex GROUP BY p.vertex", near=_NEAR))
def lslope_neighborhood(spark, sf_dir):
    """Changes of the first feature regressed on those of the response around each vertex."""
    b = Base(spark, sf_dir)
    return resample.local_slope(b.y, _first_feature(b), b.edges(), "neighborhood").select("vertex", r6("slope"))


@query(sql("SELECT round(sqrt(avg(pow(0.1 * zy, 2))), 6) AS boundary_rmse FROM cir WHERE theta <= 0.25 OR theta >= 2 * pi() - 0.25", cir=_CIRCLE))
def boundary_rmse(spark, sf_dir):
    """The error of the noisy response of a circle with a gap, near the gap."""
    vertices = Base(spark, sf_dir).vertices
    theta = 2 * math.pi * 0.8 * fx.uniform(F.lit(7), F.col("vertex"), F.lit("theta"))
    rows = synthetic.circle(vertices, gap=0.2, seed=7).withColumn("theta", theta).withColumnRenamed("y", "y_hat")
    return metrics.boundary_rmse(rows, "circle", "theta").select(r6("boundary_rmse"))


@query()
def fit_with_posterior(spark, sf_dir):
    """Fitted values with their intervals, extremality and hop radii from one fit."""
    model = Base(spark, sf_dir).fit(n_eigenpairs=30, with_posterior=100, compute_extremality=True, max_hop=5)
    return model.fitted.join(model.posterior, "vertex").join(model.extremality, "vertex")
