"""Near duplicates of embedding vectors by product quantisation.

1. Equal vectors collapse into one class; copies are counted, never paired.
2. On a bounded sample, k-means gives coarse centres and, for the residuals, ``SUBSPACES`` codebooks
   of ``CODES`` entries; vectors of each length have their own. Every class is indexed: its nearest
   centre, its codes, its quantisation error.
3. A vector probes every list whose centre is nearly as close as its own. For a link of length
   r = sqrt(2 - 2 * threshold) the other end's centre c satisfies
   g(c) <= g(own) + 2 r |c - own| cos(a), with g(c) = |c|^2 - 2 x.c; cos(a) is the share of a
   random direction, taken as ``SIGMAS`` / sqrt(dimension) and at most 1, where it is exact. Of two lists
   only the first one's vectors probe the other, and a link counts for both ends.
4. Asymmetric table distances to a list's codes minus the stored errors are lower bounds; only pairs
   within r remain, and their cosine is computed in double precision.
5. A task hands on each vector's number of links and a spanning forest, not the pairs themselves.

Lists are worked off in blocks of members and of probing vectors, so a list that holds much of the
table is many tasks. The sample (``SAMPLE`` vectors by a hash of the id) only fits the codebooks; vectors
of a length that it lacks are all compared, in blocks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of different lengths do not link. Rows with a null vec_id are returned with no links, a
null component and ``kept`` true. Rows that repeat a vec_id link like other copies if their vectors
agree, but are one component. A cosine of exactly the threshold links; of equally near centres the first one's list is taken.
An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components, forest
from .workspace import Workspace, ship

SAMPLE, SUBSPACES, CODES, CENTRES = 16_384, 16, 256, 4096
SIGMAS = 3.0
MEMBERS, PROBES = 512, 1024


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(half - x[a : a + 4096] @ centres.T).argmin(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(count)
        centres[full] = np.add.reduceat(x[order], (np.cumsum(count) - count)[full], axis=0) / count[full, None]
    return centres


class Quantiser:
    """Coarse centres and residual codebooks for unit vectors."""

    def __init__(self, sample: np.ndarray, centres: int, subspaces: int = SUBSPACES, seed: int = 5):
        dim = sample.shape[1]
        while dim % subspaces:
            subspaces -= 1
        self.centres = _kmeans(sample, centres, 8, seed)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.parts = subspaces
        width = dim // subspaces
        self.books = [_kmeans(np.ascontiguousarray(rest[:, p * width : (p + 1) * width]), CODES, 5, seed + p) for p in range(subspaces)]
        self.width = width

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and quantisation error of each vector."""
        own = _nearest(x, self.centres)
        rest = x - self.centres[own]
        codes, error = np.empty((len(x), self.parts), np.uint8), np.zeros(len(x))
        for p, book in enumerate(self.books):
            piece = rest[:, p * self.width : (p + 1) * self.width]
            codes[:, p] = _nearest(piece, book)
            error += ((piece - book[codes[:, p]]) ** 2).sum(1)
        return own, codes, np.sqrt(error)

    def probes(self, x: np.ndarray, reach: float, sigmas: float) -> list[np.ndarray]:
        """Lists to look into for partners within distance ``reach``."""
        square = (self.centres**2).sum(1)
        g = square - 2 * x @ self.centres.T
        own = g.argmin(1)
        apart = np.sqrt(np.maximum(0, square[own][:, None] + square - 2 * self.centres[own] @ self.centres.T))
        room = 2 * reach * min(1.0, sigmas / np.sqrt(x.shape[1])) * apart
        return [np.flatnonzero(row) for row in g - g[np.arange(len(x)), own][:, None] <= room]

    def distances(self, x: np.ndarray, list_id: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances (vectors, members) by table lookup."""
        rest = x - self.centres[list_id]
        total = np.zeros((len(x), len(codes)), np.float32)
        for p, book in enumerate(self.books):
            piece = rest[:, p * self.width : (p + 1) * self.width]
            table = ((piece**2).sum(1)[:, None] - 2 * piece @ book.T + (book**2).sum(1)).astype(np.float32)
            total += table[:, codes[:, p]]
        return np.sqrt(np.maximum(total, 0))


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _raw(column: pa.Array) -> list[bytes]:
    return [np.asarray(v.values, np.float64).tobytes() for v in column]


def fitted(classes: DataFrame, sample: int) -> dict[int, Quantiser]:
    """A quantiser for each vector length of the sample."""
    n = classes.count()
    picked = classes.orderBy(F.xxhash64("rep", F.lit("pq-sample")), "rep").limit(sample).select("v").toArrow()
    by_length: dict[int, list[bytes]] = {}
    for raw in _raw(picked.column("v").combine_chunks()):
        by_length.setdefault(len(raw) // 8, []).append(raw)
    out = {}
    for dim, raws in by_length.items():
        lists = 2 * np.sqrt(n * len(raws) / picked.num_rows)  # in step with the vectors of this length
        out[dim] = Quantiser(_unit(raws), int(np.clip(lists, 1, min(CENTRES, len(raws) // 4 or 1))))
    return out


def _placed(shared, reach: float, sigmas: float):
    """mapInArrow: list, codes and error of each class, and the lists that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantisers = shared()
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                raw = _raw(part.column("v"))
                dims = np.array([len(r) // 8 for r in raw])
                lists, error = np.zeros(len(raw), np.int32), np.zeros(len(raw))
                codes, probes = [b""] * len(raw), [[0]] * len(raw)
                for dim in np.unique(dims).tolist():
                    if dim in quantisers:
                        at = np.flatnonzero(dims == dim)
                        x = _unit([raw[i] for i in at])
                        lists[at], own, error[at] = quantisers[dim].encode(x)
                        for i, c, p in zip(at.tolist(), own, quantisers[dim].probes(x, reach, sigmas)):
                            codes[i], probes[i] = c.tobytes(), p[p >= lists[i]].tolist()
                columns = [part.column("rep"), part.column("copies"), pa.array(raw, pa.binary()), pa.array(dims.astype(np.int32)), pa.array(lists), pa.array(codes, pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "copies", "raw", "dim", "list", "codes", "error", "probes"])

    return run


def _compared(shared, reach: float, threshold: float):
    """applyInArrow over a block of a list's members and one of the vectors that probe it: (rep, links, other)."""

    def run(key, table):
        quantiser = shared().get(key[0].as_py())
        codes = table.column("codes").combine_chunks()
        is_member = ~np.asarray(codes.is_null())
        rep, copies, own = (table.column(c).to_numpy() for c in ("rep", "copies", "own"))
        raw = table.column("raw").to_pylist()
        m, s = np.flatnonzero(is_member), np.flatnonzero(~is_member)
        none = pa.array([], pa.int64())
        if not len(m) or not len(s):
            return pa.table({"rep": none, "links": none, "other": none})
        xm, xs = _unit([raw[i] for i in m]), _unit([raw[i] for i in s])
        lower = np.zeros((len(s), len(m)), np.float32)
        if quantiser is not None:
            table_codes = np.frombuffer(b"".join(codes[int(i)].as_py() for i in m), np.uint8).reshape(len(m), -1)
            lower = quantiser.distances(xs, int(key[1].as_py()), table_codes) - table.column("error").to_numpy()[m]
        i, j = np.nonzero(lower <= reach + 1e-3)
        i, j = i[rep[s[i]] != rep[m[j]]], j[rep[s[i]] != rep[m[j]]]
        near = [np.einsum("ij,ij->i", xs[i[a : a + 65536]], xm[j[a : a + 65536]]) >= threshold for a in range(0, len(i), 65536)]
        near = np.concatenate(near) if near else np.zeros(0, bool)
        i, j = i[near], j[near]
        # vectors of the list itself come as both members and probing ones
        outer = own[s[i]] != key[1].as_py()
        links = np.bincount(i, copies[m[j]], minlength=len(s)), np.bincount(j[outer], copies[s[i[outer]]], minlength=len(m))
        found = [(rep[at[n > 0]], n[n > 0].astype(np.int64)) for at, n in zip((s, m), links)]
        node, root = forest(rep[s[i]], rep[m[j]])
        columns = {"rep": [*(r for r, _ in found), node], "links": [*(n for _, n in found), np.zeros(len(node), np.int64)]}
        out = {k: pa.array(np.concatenate(v)) for k, v in columns.items()}
        return pa.table(out | {"other": pa.concat_arrays([pa.nulls(sum(len(r) for r, _ in found), pa.int64()), pa.array(root, pa.int64())])})

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, sigmas: float = SIGMAS, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``embeddings``."""
    spark = embeddings.sparkSession
    ws = Workspace(spark, "embeddings")
    reach = float(np.sqrt(2 - 2 * threshold))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fit = F.coalesce(F.expr("not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(v, x -> x != 0)"), F.lit(False))
    # -0.0 and 0.0 are one value
    plain = F.transform("v", lambda x: x + F.lit(0.0))
    rows = ws.save(rows.select("vec_id", F.when(fit, plain).alias("v")), "rows")
    named = rows.where("vec_id is not null and v is not null").withColumns({"k1": F.xxhash64("v"), "k2": F.hash("v")})
    classes = ws.save(named.groupBy("k1", "k2", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    shared = ship(spark, fitted(classes, sample))
    placed = classes.mapInArrow(_placed(shared, reach, sigmas), "rep long, copies long, raw binary, dim int, list int, codes binary, error double, probes array<int>")
    placed = ws.save(placed, "placed")
    at = ["dim", "list"]
    looks = placed.select("rep", "copies", "raw", "dim", F.col("list").alias("own"), F.explode("probes").alias("list"))
    members = placed.groupBy(*at).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("m"))
    seekers = placed.select("dim", F.explode("probes").alias("list")).groupBy(*at).agg(F.ceil(F.count("*") / PROBES).cast("int").alias("s"))
    shape = members.join(seekers, at)
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    salt = lambda c: F.pmod(F.xxhash64("rep", F.lit(c)), F.col(c)).cast("int")
    left = placed.join(shape, at).select(*at, salt("m").alias("mb"), spread("s").alias("sb"), F.col("list").alias("own"), "rep", "copies", "raw", "codes", "error")
    right = looks.join(shape, at).select(*at, spread("m").alias("mb"), salt("s").alias("sb"), "own", "rep", "copies", "raw", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"))
    found = left.unionByName(right).groupBy(*at, "mb", "sb").applyInArrow(_compared(shared, reach, threshold), "rep long, links long, other long")
    found = ws.save(found, "links")
    degrees = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("rep").alias("src"), F.col("other").alias("dst"))
    linked = connected_components(ws, edges).withColumnRenamed("node", "rep")
    by_class = classes.join(linked, "rep", "left").join(degrees, "rep", "left")
    by_class = by_class.select("k1", "k2", "v", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    keyed = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.hash("v")})
    out = keyed.join(by_class, ["k1", "k2", "v"], "left")
    linkable = F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    component = F.when(linkable, F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(linkable, F.col("links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
