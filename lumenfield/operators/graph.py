"""Neighbourhood graphs as tables: ``knn(vertex, rank, nbr, dist)``, ``edges(i, j, isize, length)``."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenfield.functions import orders
from lumenfield.sources.tables import checkpointed

#: Rows of a block: a task compares two blocks and keeps k rows for each vertex of the first.
BLOCK = 2048
#: Pairs whose differences a task holds at once.
PAIRS = 1 << 16
#: Groups of blocks that meet in pairs, each pair in a task; the numbers that a group may hold, and the rows that a block is not cut below.
GROUPS = 12
VALUES = 1 << 22
LEAST = 256
#: Rows that a block is compared with at once.
TARGETS = 8192
#: Most pivots; they are shipped to every task.
PIVOTS = 1024
#: Rows of a list that meet in one task; a vertex near more others than that deals them to blocks.
LIST = 1024


def _vectors(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, to within rounding."""
    square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _marked(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix of booleans, few of which are set: eight at a time."""
    flat = np.ascontiguousarray(hit).reshape(-1)
    whole = len(flat) // 8 * 8
    eight = np.flatnonzero(flat[:whole].view(np.uint64))
    at, byte = np.nonzero(flat[:whole].reshape(-1, 8)[eight])
    return np.divmod(np.concatenate([eight[at] * 8 + byte, whole + np.flatnonzero(flat[whole:])]), hit.shape[1])


def _near(ids: np.ndarray, x: np.ndarray, q: np.ndarray, t: np.ndarray, k: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vertex, nbr, dist): for each row of ``q`` its k nearest among the rows ``t``, at most ``reach`` away, ties by vertex."""
    t = t[np.argsort(ids[t], kind="stable")]
    out_v, out_n, out_d = [], [], []
    if len(q) and len(t):
        square = (x[t] ** 2).sum(1)
        take = min(k, len(t))
        theirs, most = x[t], square.max()
        halves = theirs.astype(np.float32) if reach is not None and most < 1e30 else None
        for a in range(0, len(q), 512):
            some = q[a : a + 512]
            mine = x[some]
            own = (mine**2).sum(1)
            # no rounding of rough differs by more from the exact square; single precision serves where that is little beside the reach
            far = np.full(len(some), np.inf) if reach is None else reach[a : a + 512] ** 2
            loose = 4 * (x.shape[1] + 8) * float(np.finfo(np.float32).eps)
            single = halves is not None and (far > 1e-20).all() and bool((loose * (own + most) <= far / 16).all())
            if single:
                slack = loose
                rough = (-2 * mine).astype(np.float32) @ halves.T
                rough += square.astype(np.float32)
            else:
                slack = 16 * (x.shape[1] + 8) * np.finfo(np.float64).eps
                rough = square - 2 * mine @ theirs.T
            bound = far * (1 + slack) - own + slack * (own + most)
            within = lambda at: np.less_equal(rough[at], bound[at].astype(rough.dtype)[:, None]) if single else ~(rough[at] > bound[at][:, None])  # noqa: B023, E731
            row, col = _marked(within(slice(None))) if reach is not None else (None, None)
            crowded = np.arange(len(some)) if reach is None else np.flatnonzero(np.bincount(row, minlength=len(some)) > 8 * k)
            if len(crowded):
                # any k points bound the k-th distance; all points within the bound stay, so no tie is lost
                close = np.argpartition(rough[crowded], take - 1, axis=1)[:, :take]
                kth = ((mine[crowded][:, None] - theirs[close]) ** 2).sum(2).max(1) - own[crowded] + slack * (own[crowded] + most)
                bound[crowded] = np.minimum(bound[crowded], kth)
                r, col2 = _marked(within(crowded))
                if reach is None:
                    row, col = r, col2
                else:
                    kept = ~np.isin(row, crowded)
                    row, col = np.concatenate([row[kept], crowded[r]]), np.concatenate([col[kept], col2])
            if not len(row):
                continue
            d = np.concatenate([np.sqrt(((mine[row[c : c + PAIRS]] - theirs[col[c : c + PAIRS]]) ** 2).sum(1)) for c in range(0, len(row), PAIRS)])
            order = np.lexsort((col, d, row))
            first = np.searchsorted(row[order], np.arange(len(some)))
            keep = np.arange(len(row)) - first[row[order]] < k
            if reach is not None:
                keep &= d[order] <= reach[a : a + 512][row[order]]
            order = order[keep]
            out_v.append(ids[some[row[order]]])
            out_n.append(ids[t[col[order]]])
            out_d.append(d[order])
    cat = lambda v, kind: np.concatenate(v) if v else np.zeros(0, kind)
    return cat(out_v, np.int64), cat(out_n, np.int64), cat(out_d, np.float64)


def _ranked(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("vertex").orderBy("dist", "nbr")
    return near.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("vertex", "rank", "nbr", "dist")


def knn(points: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The k nearest points by Euclidean distance, ties by vertex; itself at rank 0 unless an equal point has a smaller vertex.

    Exact, with metric pruning. Points go to the nearest of some pivots, and each pivot's points are cut into blocks by
    their distance from it. A first pass bounds every point's k-th distance within its own block; by the triangle inequality two
    blocks meet only if some point of the first may reach into the second's shell, and in a task only the rows that may.
    Blocks travel in groups, whose number does not grow with the points until a group is full, so each point travels as often as
    there are groups and leaves each task with k neighbours at most. Partial neighbours beyond a point's bound never leave a task. All points as near as the k-th within rounding are
    compared by sums of squared differences in double precision, however many are equal.
    """
    held, shells, pivots = _shells(points.select("vertex", "x"), block)
    if shells == 1:

        def alone(table: pa.Table) -> pa.Table:
            ids = table.column("vertex").to_numpy()
            every = np.arange(len(ids))
            return pa.table(dict(zip(("vertex", "nbr", "dist"), _near(ids, _vectors(table.column("x"), len(ids)), every, every, k))))

        return _ranked(held.groupBy("b").applyInArrow(alone, "vertex long, nbr long, dist double"), k)

    def bound(table: pa.Table) -> pa.Table:
        """A block as one row: its points, and for each the k-th distance within it, infinite where it holds fewer."""
        ids = table.column("vertex").to_numpy()
        x, every = _vectors(table.column("x"), len(ids)), np.arange(len(ids))
        v, _, d = _near(ids, x, every, every, k)
        order = np.lexsort((d, v))
        sizes = np.unique(v, return_counts=True)[1]
        last = d[order][np.cumsum(sizes) - 1] if len(ids) >= k else np.full(len(ids), np.inf)
        reach, off = last[np.searchsorted(np.sort(ids), ids)], table.column("off").to_numpy()
        one = {"b": table.column("b")[0].as_py(), "g": table.column("g")[0].as_py(), "cell": table.column("cell")[0].as_py(), "lo": off.min(), "hi": off.max(), "far": reach.max()}
        lists = {c: pa.ListArray.from_arrays(pa.array([0, len(w)], pa.int32()), pa.array(w)) for c, w in (("ids", ids), ("x", x.ravel()), ("reach", reach))}
        return pa.table({c: pa.array([w], t) for (c, w), t in zip(one.items(), (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()))} | lists)

    held = checkpointed(held.groupBy("b").applyInArrow(bound, "b long, g int, cell int, lo double, hi double, far double, ids array<long>, x array<double>, reach array<double>"))
    meta = held.select("b", "g", "cell", "lo", "hi", F.col("far").alias("reach"))
    between = _distances(pivots, pivots)
    scale = float(np.abs(pivots).max()) * math.sqrt(pivots.shape[1]) + float(meta.agg(F.max("hi")).first()[0]) if len(pivots) else 0.0
    slack = 1e-7 * scale
    cells = meta.groupBy("cell").agg(F.max("hi").alias("hi"), F.max("reach").alias("reach")).collect()  # at most PIVOTS rows
    meet = [(c.cell, e.cell, float(between[c.cell, e.cell])) for c in cells for e in cells if between[c.cell, e.cell] - c.hi - e.hi <= c.reach + slack]
    pairs = meta.sparkSession.createDataFrame(meet, "cell int, other int, d double")
    theirs = meta.select(F.col("cell").alias("other"), F.col("g").alias("h"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = meta.join(pairs, "cell").join(theirs, "other")
    # a point of the first block lies between d - hi and d + hi from the second's pivot, and the other way round
    least = F.greatest(F.col("d") - F.col("hi") - F.col("hi2"), F.col("lo2") - F.col("d") - F.col("hi"), F.col("lo") - F.col("d") - F.col("hi2"))
    pairs = pairs.where(least <= F.col("reach") + slack).select(F.least("g", "h").alias("p"), F.greatest("g", "h").alias("q")).distinct()
    pairs = checkpointed(pairs)
    # each group of blocks travels once to each pair of groups
    place = pairs.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("g"))
    both = held.join(F.broadcast(place), "g").repartition(max(1, pairs.count()), "p", "q")

    def compare(table: pa.Table) -> pa.Table:
        """Every block of either group with the blocks of the other that it may meet, the likeliest first; bounds shrink on the way."""
        group, cell = table.column("g").to_numpy(), table.column("cell").to_numpy()
        lo, hi, most = (table.column(c).to_numpy() for c in ("lo", "hi", "far"))
        ids = table.column("ids").combine_chunks().flatten().to_numpy()
        x = _vectors(table.column("x"), len(ids))
        reaches = table.column("reach").combine_chunks().flatten().to_numpy()
        ends = np.cumsum([0, *(len(i) for i in table.column("ids"))])
        one, out = len(np.unique(group)) == 1, []
        for a in range(len(group)):
            d = between[cell[a], cell]
            away = np.max([d - hi[a] - hi, lo - d - hi[a], lo[a] - d - hi], axis=0)
            may = np.flatnonzero((away <= most[a] + slack) & (one | (group != group[a])))
            may = may[np.argsort(away[may], kind="stable")]
            q, reach = np.arange(ends[a], ends[a + 1]), reaches[ends[a] : ends[a + 1]].copy()
            far = _distances(x[q], pivots)
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            # as many blocks at a time as make a fair product, so that what they bound spares work on the next
            cuts = np.flatnonzero(np.diff((np.cumsum(ends[may + 1] - ends[may]) - 1) // TARGETS)) + 1
            for run in np.split(may, cuts):
                if not len(run):
                    continue
                off = far[:, cell[run]]
                some = (np.maximum(off - hi[run], lo[run] - off) <= reach[:, None] + slack).any(1)
                t = np.concatenate([np.arange(ends[c], ends[c + 1]) for c in run])
                v, nbr, dist = (np.concatenate(w) for w in zip(found, _near(ids, x, q[some], t, k, reach[some])))
                order = np.lexsort((nbr, dist, v))
                starts = np.flatnonzero(np.diff(v[order], prepend=v[order][:1] - 1)) if len(v) else np.zeros(0, int)
                nth = np.arange(len(v)) - np.repeat(starts, np.diff([*starts, len(v)]))
                last = order[nth == k - 1]
                found = tuple(w[order[nth < k]] for w in (v, nbr, dist))
                by = np.argsort(ids[q])
                at = by[np.searchsorted(ids[q][by], v[last])]
                reach[at] = np.minimum(reach[at], dist[last])
            out.append(found)
        return pa.table(dict(zip(("vertex", "nbr", "dist"), (np.concatenate(w) for w in zip(*out)))))

    near = both.groupBy("p", "q").applyInArrow(compare, "vertex long, nbr long, dist double")
    return _ranked(near, k)


def _shells(points: DataFrame, block: int) -> tuple[DataFrame, int, np.ndarray]:
    """(points with cell, off, b and g; number of blocks; pivots): blocks of at most ``block`` points between two distances from a pivot,
    and groups of blocks; there are about GROUPS of them, more only where one would hold more than VALUES numbers."""
    n = points.count()
    if n <= block:
        return points.select("vertex", "x", F.lit(0).cast("long").alias("b")), 1, np.zeros((0, 0))
    groups = max(GROUPS, -(-n * len(points.first().x) // VALUES))
    block = min(block, max(-(-n // groups), LEAST))
    chosen = points.orderBy(F.xxhash64("vertex", F.lit("pivot")), "vertex").limit(min(PIVOTS, -(-n // block))).select("x").collect()
    pivots = np.unique(np.array([r.x for r in chosen], np.float64), axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_vectors(batch.column("x"), batch.num_rows), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], ["vertex", "x", "cell", "off"])

    placed = checkpointed(points.mapInArrow(assign, "vertex long, x array<double>, cell int, off double"))
    order = numbered(placed.select("vertex", "cell", "off"), ["cell", "off", "vertex"], "r")
    order = checkpointed(order)
    cells = order.groupBy("cell").agg(F.min("r").alias("first"), F.count("*").alias("m"))  # at most PIVOTS rows
    # shells of equal numbers of points, so that none is too small to bound a distance
    shells = F.ceil(F.col("m") / block)
    shell = F.floor((F.col("r") - F.col("first")) * shells / F.col("m")).cast("long")
    b = order.join(F.broadcast(cells), "cell").select("vertex", (F.col("cell") * F.lit(1 << 40) + shell).alias("b"), shell.alias("shell"), "first", "m", shells.alias("shells"))
    # a block belongs where its first row would
    g = F.floor((F.col("first") - 1 + F.col("shell") * F.col("m") / F.col("shells")) * F.lit(groups) / n).cast("int")
    b = b.select("vertex", "b", g.alias("g"))
    out = checkpointed(placed.join(b, "vertex"))
    return out, 2, pivots


def iknn(neighbours: DataFrame, size: int = LIST) -> DataFrame:
    """Shared-neighbour graph: isize common neighbours, length of the shortest way through one."""
    return shared(neighbours.select("vertex", "nbr", "dist"), [], size)


def shared(rows: DataFrame, by: list[str], size: int = LIST) -> DataFrame:
    """(by..., i, j, isize, length) of vertices that have neighbours in common, for rows (by..., vertex, nbr, dist).

    The list of those that a vertex is near to meets itself. A longer list than ``size`` is dealt to blocks, and any two of its
    blocks meet in a task of their own, so no task holds more than two blocks however near a vertex is to all.
    """
    key = [*by, "nbr"]
    long = rows.groupBy(*key).agg(F.count("*").alias("m")).where(F.col("m") > size).select(*key, F.ceil(F.col("m") / size).cast("int").alias("blocks"))
    dealt = rows.join(long, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = [F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")]
    a = dealt.select(*key, *place, F.col("vertex").alias("i"), F.col("dist").alias("di"), F.col("own").alias("oi"))
    b = dealt.select(*key, *place, F.col("vertex").alias("j"), F.col("dist").alias("dj"), F.col("own").alias("oj"))
    # rows of one block meet where it meets itself, rows of two where these meet
    pairs = a.join(b, [*key, "p", "q"]).where("i < j and (oi != oj or p = q)")
    return pairs.groupBy(*by, "i", "j").agg(F.count("*").alias("isize"), F.min(F.col("di") + F.col("dj")).alias("length"))


def directed(edges: DataFrame, *columns) -> DataFrame:
    """Both directions (vertex, nbr, ...) of an undirected edge table."""
    ahead = edges.select(F.col("i").alias("vertex"), F.col("j").alias("nbr"), *columns)
    return ahead.unionByName(edges.select(F.col("j").alias("vertex"), F.col("i").alias("nbr"), *columns))


def neighbour_sets(vertices: DataFrame, edges: DataFrame, k_plus: int) -> DataFrame:
    """(vertex, member): the vertex and its closest neighbours, k_plus in all; ties by vertex."""
    own = vertices.select("vertex", F.col("vertex").alias("nbr"), F.lit(0.0).alias("length"))
    w = Window.partitionBy("vertex").orderBy("length", "nbr")
    rows = directed(edges, "length").unionByName(own).withColumn("r", F.row_number().over(w))
    return rows.where(F.col("r") <= k_plus).select("vertex", F.col("nbr").alias("member"))


def intersection(edges: DataFrame, sets: DataFrame, measure: DataFrame | None = None) -> DataFrame:
    """(i, j, isize, mass): size and measure of the common part of both ends' sets; 0 where it is empty."""
    a = sets.select(F.col("vertex").alias("i"), "member")
    b = sets.select(F.col("vertex").alias("j"), "member")
    both = edges.select("i", "j").join(a, "i").join(b, ["j", "member"])
    if measure is not None:
        both = both.join(measure.select(F.col("vertex").alias("member"), "w"), "member")
    else:
        both = both.withColumn("w", F.lit(1.0))
    found = both.groupBy("i", "j").agg(F.count("*").alias("isize"), F.sum("w").alias("mass"))
    return edges.select("i", "j").join(found, ["i", "j"], "left").fillna(0, ["isize"]).fillna(0.0, ["mass"])


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, component): smallest vertex of each connected component, by repeated min labels with shortcuts.

    Each round is an aggregation over edges; rounds are cut by checkpoint() in the shared folder.
    """
    both = checkpointed(directed(edges))
    labels = checkpointed(vertices.select("vertex", F.col("vertex").alias("component")))
    while True:
        seen = both.join(labels.select(F.col("vertex").alias("nbr"), "component"), "nbr").groupBy("vertex").agg(F.min("component").alias("m"))
        hooked = labels.join(seen, "vertex", "left").select("vertex", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component"))
        # shortcut: a component takes the smallest label that any of its members saw
        roots = hooked.groupBy("old").agg(F.min("component").alias("root"))
        later = hooked.join(roots, "old").select("vertex", F.least("component", "root").alias("component"), (F.least("component", "root") != F.col("old")).alias("moved"))
        later = checkpointed(later)
        if later.where("moved").isEmpty():
            return later.select("vertex", "component")
        labels = later.select("vertex", "component")


def largest_component(labels: DataFrame) -> DataFrame:
    """Vertices of the largest component; ties go to the smallest label."""
    sizes = labels.groupBy("component").count()
    best = sizes.agg(F.max_by("component", F.struct("count", -F.col("component"))).alias("component"))
    return labels.join(F.broadcast(best), "component", "left_semi").select("vertex")


def induced(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the vertices, ends renumbered from 1 in order."""
    ids = numbered(vertices.select("vertex").distinct(), ["vertex"], "id")
    a = ids.select(F.col("vertex").alias("i"), F.col("id").alias("new_i"))
    b = ids.select(F.col("vertex").alias("j"), F.col("id").alias("new_j"))
    good = F.when(F.col("length") > 0, F.col("length"))
    kept = edges.join(a, "i").join(b, "j")
    least = F.coalesce(kept.agg(F.min(good)).scalar(), F.lit(1.0))
    return kept.select("i", "j", "new_i", "new_j", F.coalesce(good, least).alias("length"))


def ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, dealt by ranges of their keys into partitions named ``_p`` in the order of the keys.

    Range bounds come from a sample that differs with every evaluation, so the dealt rows are written once
    with the number of their partition, and everything after reads what was written.
    """
    return checkpointed(df.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()))


def carried(spread: DataFrame, parts: list[tuple[int, float]], name: str, kind: str) -> DataFrame:
    """``spread`` with a value of its partition beside each row; one small row for each partition of ``ranged``."""
    return spread.join(F.broadcast(spread.sparkSession.createDataFrame(parts, f"_p int, {name} {kind}")), "_p")


def running(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Rows with the sum of ``value``, a long, over themselves and all rows before them in the order of their keys.

    No partition holds all rows: sums of the range partitions before give each its first total. Keys should be unique.
    """
    spread = ranged(df.withColumn("_v", value.cast("long")), keys)
    total, before = 0, []
    for r in spread.groupBy("_p").agg(F.sum("_v").alias("s")).orderBy("_p").collect():
        before.append((r[0], total))
        total += r[1]
    if not before:
        return df.withColumn(name, F.lit(0).cast("long"))
    w = Window.partitionBy("_p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return carried(spread, before, "_b", "long").withColumn(name, F.sum("_v").over(w) + F.col("_b")).drop("_p", "_b", "_v")


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows numbered from 1 in the order of their keys."""
    return running(df, keys, F.lit(1), name)


def edge_list(edges: DataFrame) -> DataFrame:
    """edge_id from 0 in the order of (i, j)."""
    return numbered(edges.select("i", "j", "length"), ["i", "j"], "edge_id").withColumn("edge_id", F.col("edge_id") - 1)


def triangles(edges: DataFrame, sets: DataFrame, measure: DataFrame | None = None) -> DataFrame:
    """(v0, v1, v2, isize): mutually adjacent vertices whose neighbour sets have a common member; with a measure (vertex, w) also its mass.

    Edges carry the members that both ends have in common, and only those with any make triangles. They point from the end of
    smaller degree to the other, so that a vertex has at most as many ways out as the square root of twice the edges; pairs
    of ways out of one vertex that still have a member in common are closed by a third edge.
    """
    member = sets.select("vertex", "member", F.lit(1.0).alias("w")) if measure is None else sets.join(measure.select(F.col("vertex").alias("member"), "w"), "member")
    held = member.groupBy("vertex").agg(F.array_sort(F.collect_list(F.struct("member", "w"))).alias("s"))
    end = lambda v, name: held.select(F.col("vertex").alias(v), F.col("s").alias(name))
    near = edges.select("i", "j").join(end("i", "si"), "i").join(end("j", "sj"), "j").select("i", "j", F.array_intersect("si", "sj").alias("s"))
    near = checkpointed(near.where(F.size("s") > 0))
    degree = directed(near).groupBy("vertex").agg(F.count("*").alias("d"))
    ends = near.join(degree.select(F.col("vertex").alias("i"), F.col("d").alias("di")), "i").join(degree.select(F.col("vertex").alias("j"), F.col("d").alias("dj")), "j")
    ahead = (F.col("di") < F.col("dj")) | ((F.col("di") == F.col("dj")) & (F.col("i") < F.col("j")))
    out = ends.select(F.when(ahead, F.col("i")).otherwise(F.col("j")).alias("a"), F.when(ahead, F.col("j")).otherwise(F.col("i")).alias("b"), "s")
    wedges = out.join(out.select("a", F.col("b").alias("c"), F.col("s").alias("s2")), "a").where("b < c").select("a", "b", "c", F.array_intersect("s", "s2").alias("s"))
    three = wedges.where(F.size("s") > 0).select("a", "b", "c", F.size("s").cast("long").alias("isize"), F.aggregate("s", F.lit(0.0), lambda t, x: t + x["w"]).alias("mass"))
    three = three.join(near.select(F.col("i").alias("b"), F.col("j").alias("c")), ["b", "c"]).select(F.array_sort(F.array("a", "b", "c")).alias("v"), "isize", "mass")
    return three.select(*[F.col("v")[k].alias(f"v{k}") for k in range(3)], "isize", *(["mass"] if measure is not None else []))


def circle(angles: DataFrame) -> DataFrame:
    """Cycle over vertices (vertex, theta) in the order of their angles; lengths are the gaps.

    The order is taken by a global sort number, so neighbours meet in an equi-join.
    """
    n = numbered(angles, ["theta", "vertex"], "r")
    total = angles.count()
    a = n.select(F.col("vertex").alias("a"), F.col("theta").alias("ta"), F.when(F.col("r") == total, 1).otherwise(F.col("r") + 1).alias("r"))
    pairs = a.join(n, "r")
    gap = F.col("theta") - F.col("ta")
    gap = F.when(gap < 0, gap + 2 * np.pi).otherwise(gap)
    return pairs.select(F.least("a", "vertex").alias("i"), F.greatest("a", "vertex").alias("j"), gap.alias("length"))


def summary(vertices: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: edge and component counts, largest and second components, degrees."""
    degree = vertices.select("vertex").join(directed(edges).groupBy("vertex").count(), "vertex", "left").fillna(0, ["count"])
    d = degree.agg(F.avg("count").alias("degree_mean"), F.min("count").alias("degree_min"), F.max("count").alias("degree_max"), F.count("*").alias("n"))
    sizes = labels.groupBy("component").count()
    # two sizes suffice: the largest, and the largest of the others
    top = sizes.orderBy(F.desc("count"), "component").limit(2).agg(F.max("count").alias("lcc_size"), F.sum("count").alias("two"))
    c = sizes.agg(F.count("*").alias("component_count")).crossJoin(top).crossJoin(edges.agg(F.count("*").alias("edge_count"))).crossJoin(d)
    return c.select("edge_count", "component_count", "lcc_size", (F.col("lcc_size") / F.col("n")).alias("lcc_fraction"), (F.col("two") - F.col("lcc_size")).alias("second_lcc"), "degree_mean", "degree_min", "degree_max")


def degree_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Jensen-Shannon divergence (natural log) of two graphs' degree shares, and edge edit distance."""

    def shares(edges: DataFrame, name: str) -> DataFrame:
        h = directed(edges).groupBy("vertex").count().groupBy(F.col("count").alias("degree")).agg(F.count("*").alias("m"))
        return h.select("degree", (F.col("m") / h.agg(F.sum("m")).scalar()).alias(name))

    h = shares(a, "p").join(shares(b, "q"), "degree", "full_outer").fillna(0.0, ["p", "q"])
    mid = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / mid)).otherwise(0.0)
    js = h.agg((F.sum(part("p")) / 2 + F.sum(part("q")) / 2).alias("degree_js"))
    left, right = a.select("i", "j"), b.select("i", "j")
    only = left.join(right, ["i", "j"], "left_anti").unionByName(right.join(left, ["i", "j"], "left_anti"))
    return js.crossJoin(only.agg(F.count("*").alias("edit_distance")))


#: Shortest edges of a vertex that stand for all of them where ways of two edges are looked for first.
SHORTEST = 8


def _told_early(long: DataFrame, ways: DataFrame, delta: float) -> DataFrame:
    """(i, j, length, short, last) of edges that other ways may replace: short where two of their ends' SHORTEST edges make a way under
    the bound; ``last`` is the least step by which a way can reach j. Edges whose first and last steps alone are too long are left out."""
    w = Window.partitionBy("vertex").orderBy("step", "nbr")
    few = ways.where("vertex != nbr").withColumn("r", F.row_number().over(w)).where(F.col("r") <= SHORTEST)
    few = few.groupBy("vertex", "nbr").agg(F.min("step").alias("step"))
    few = checkpointed(few.groupBy("vertex").agg(F.map_from_entries(F.collect_list(F.struct("nbr", "step"))).alias("m")))
    end = lambda v, name: few.select(F.col("vertex").alias(v), F.col("m").alias(name))
    both = long.select("i", "j", "length").join(end("i", "mi"), "i").join(end("j", "mj"), "j")
    # sums in the order of a way from i
    via = F.transform(F.array_intersect(F.map_keys("mi"), F.map_keys("mj")), lambda v: F.col("mi")[v] + F.col("mj")[v])
    least = lambda m, other: F.array_min(F.map_values(F.map_filter(m, lambda v, _: v != F.col(other))))
    short = F.coalesce(F.exists(via, lambda way: F.try_divide(way, "length") - 1 < delta), F.lit(False))
    both = both.select("i", "j", "length", short.alias("short"), least("mi", "j").alias("first"), least("mj", "i").alias("last"))
    return both.where(F.col("short") | (F.col("first") + F.col("last") < _bound(delta))).drop("first")


def _bound(delta: float) -> Column:
    """A hair above the longest way that replaces an edge."""
    return F.col("length") * ((1 + delta) * (1 + 1e-9))


def prune_long_ways(edges: DataFrame, delta: float = 0.1, percentile: float = 0.0) -> DataFrame:
    """Drops an edge when some other way between its ends is less than (1 + delta) times as long.

    Only edges longer than the quantile are considered; delta 0 drops none. Ways of any number of edges count:
    from one end of each edge a frontier of shortest distances grows, an edge a round and never
    beyond the bound (an edge without length stays), until it reaches the other end or has nowhere to go. Edges with a way of two edges that are among the
    shortest of their ends are told first, by one row of few numbers for each end, and so are those whose first and last step alone
    would be too long; only the others need a frontier, which ends where the last step would be too long.
    """
    if delta <= 0:
        return edges
    long = edges
    if percentile > 0:
        long = edges.where(F.col("length") > orders.quantiles(edges, "length", [percentile])[0])
    ways = directed(edges, F.col("length").alias("step"))
    told = checkpointed(_told_early(long, ways, delta))
    gone, long = told.where("short").select("i", "j"), told.where("not short").drop("short")
    # no step of a way is as long as the longest way that counts
    most = long.agg(F.max(_bound(delta))).first()[0] or 0.0
    d = checkpointed(ways.where(F.col("step") <= most).withColumnRenamed("vertex", "at"))
    best = checkpointed(long.select("i", "j", "length", "last", F.col("i").alias("at"), F.lit(0.0).alias("way")))
    frontier = best
    while not frontier.isEmpty():
        moved = frontier.join(d, "at").where("nbr != i and not (at = i and nbr = j)").select("i", "j", "length", "last", F.col("nbr").alias("at"), (F.col("way") + F.col("step")).alias("way"))
        moved = moved.where((F.try_divide("way", "length") - 1 < delta) & ((F.col("at") == F.col("j")) | (F.col("way") + F.col("last") < _bound(delta))))
        moved = checkpointed(moved.groupBy("i", "j", "length", "last", "at").agg(F.min("way").alias("way")))
        reached = moved.where("at = j").select("i", "j")
        gone = checkpointed(gone.unionByName(reached))
        before = best.select("i", "j", "at", F.col("way").alias("old"))
        frontier = moved.join(gone, ["i", "j"], "left_anti").join(before, ["i", "j", "at"], "left").where("old is null or way < old").drop("old")
        frontier = checkpointed(frontier.select("i", "j", "length", "last", "at", "way"))
        best = checkpointed(best.unionByName(frontier).groupBy("i", "j", "length", "last", "at").agg(F.min("way").alias("way")))
    return edges.join(gone, ["i", "j"], "left_anti")


def prune_longest(vertices: DataFrame, edges: DataFrame, share: float) -> DataFrame:
    """Removes the longest ``share`` of the edges where that leaves the graph's components as they are.

    Of the long edges those stay that a smallest spanning forest over the short graph's components needs.
    It grows as Boruvka's: in each round every component takes its shortest edge to another one, ties by
    (i, j), and what these join becomes one component.
    """
    if not 0 <= share <= 0.5:
        raise ValueError("share must lie in [0, 0.5]")
    cut = F.lit(orders.quantiles(edges, "length", [1 - share])[0]).cast("double")
    short, long = edges.where(F.col("length") <= cut), edges.where(F.col("length") > cut)
    labels = components(vertices, short)
    place = lambda of, end, name: of.select(F.col("vertex").alias(end), F.col("component").alias(name))
    across = long.join(place(labels, "i", "ci"), "i").join(place(labels, "j", "cj"), "j").where("ci != cj")
    pair = [F.least("ci", "cj").alias("ci"), F.greatest("ci", "cj").alias("cj")]
    shortest = lambda rows: rows.groupBy(*pair).agg(F.min(F.struct("length", "i", "j")).alias("e"))
    bridges, kept = checkpointed(shortest(across)), []
    while not bridges.isEmpty():
        both = bridges.select(F.col("ci").alias("c"), "ci", "cj", "e").unionByName(bridges.select(F.col("cj").alias("c"), "ci", "cj", "e"))
        taken = both.groupBy("c").agg(F.min_by(F.struct("ci", "cj", "e"), "e").alias("b")).select("b.ci", "b.cj", "b.e").distinct()
        taken = checkpointed(taken)
        kept.append(taken.select("e.i", "e.j"))
        joined = components(both.select(F.col("c").alias("vertex")).distinct(), taken.select(F.col("ci").alias("i"), F.col("cj").alias("j")))
        moved = bridges.join(place(joined, "ci", "a"), "ci").join(place(joined, "cj", "b"), "cj").where("a != b")
        bridges = checkpointed(moved.groupBy(F.least("a", "b").alias("ci"), F.greatest("a", "b").alias("cj")).agg(F.min("e").alias("e")))
    if not kept:
        return short
    needed = kept[0]
    for more in kept[1:]:
        needed = needed.unionByName(more)
    return short.unionByName(long.join(needed, ["i", "j"], "left_semi"))


def path(vertices: DataFrame, key: str = "vertex") -> DataFrame:
    """Edges (i, j, length) of unit length between vertices that follow each other in the order of ``key``."""
    n = numbered(vertices.select("vertex", *([key] if key != "vertex" else [])), [key] if key == "vertex" else [key, "vertex"], "r").select("vertex", "r")
    pairs = n.join(n.select(F.col("vertex").alias("w"), (F.col("r") - 1).alias("r")), "r")
    return pairs.select(F.least("vertex", "w").alias("i"), F.greatest("vertex", "w").alias("j"), F.lit(1.0).alias("length"))


def planted(edges: DataFrame, more: DataFrame) -> DataFrame:
    """edges (i, j, length) with those of ``more`` added; of an edge that comes more than once the shortest stays."""
    both = edges.select("i", "j", "length").unionByName(more.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "length"))
    return both.where("i != j").groupBy("i", "j").agg(F.min("length").alias("length"))
