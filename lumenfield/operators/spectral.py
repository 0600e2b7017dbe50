"""Low eigenpairs of a graph operator, spectral filters and their selection."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumenfield.functions.columns import FILTERS, uniform
from lumenfield.sources.tables import checkpointed as _checkpointed

#: Up to so many vertices the operator is a dense matrix in one numpy kernel; beyond, products are joins. Results agree.
DENSE = 5000
#: Between the two, an operator of at most so many entries is a sparse matrix in one kernel, with a basis of at most DENSE**2 numbers,
#: so that it takes no more memory than the largest dense one.
ENTRIES = 1 << 23
#: Products that a sparse kernel makes for one system before the joins take over.
SPARSE_PRODUCTS = 6000
#: Products of a chain of the operator itself before a chain of its inverse is tried, and the entries that all its products meet before the joins take over.
CHAIN_PRODUCTS = 3072
SOLVE_ENTRIES = 1 << 35


@dataclass
class Spectrum:
    """Ascending eigenvalues and (vertex, v): the components of each vertex in the eigenvectors."""

    values: np.ndarray
    vectors: DataFrame


def dense(lap: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(vertices ascending, matrix); only for operators of at most DENSE vertices."""
    rows = lap.toArrow()
    i, j, v = (rows.column(c).to_numpy() for c in ("i", "j", "val"))
    ids = np.unique(i)
    a = np.zeros((len(ids), len(ids)))
    a[np.searchsorted(ids, i), np.searchsorted(ids, j)] = v
    return ids, a


def spectrum(lap: DataFrame, m: int, dense_limit: int = DENSE) -> Spectrum:
    """The m smallest eigenpairs of a symmetric operator (i, j, val), repeated ones included, or RuntimeError."""
    n, entries = lap.agg(F.count_distinct("i"), F.count("*")).first()
    m = min(m, n)
    if n > dense_limit:
        room = dense_limit**2 // n
        found = None
        if entries <= ENTRIES and room >= 4 * (m + 16):
            kernel = sparse(lap)
            found = kernel.lowest(m, room) or kernel.lowest(m, room, shift=kernel.shift())
        if found is not None:
            ids, values, vectors = found
            table = pa.table({"vertex": pa.array(ids, pa.int64()), "v": _lists(vectors)})
            return Spectrum(values, _checkpointed(lap.sparkSession.createDataFrame(table)))
        return lowest(lap, m) if n > 5 * (m + 4) else lanczos(lap, m)
    ids, a = dense(lap)
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    table = lap.sparkSession.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors[:, :m])], "vertex long, v array<double>")
    return Spectrum(values[:m], table)


@dataclass
class Sparse:
    """A symmetric operator of at most ENTRIES entries by rows; row r is that of vertex ids[r]."""

    ids: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    cols: np.ndarray
    vals: np.ndarray

    def times(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ids))
        if len(self.vals):
            out[self.rows] = np.add.reduceat(self.vals * x[self.cols], self.starts)
        return out

    def norm(self) -> float:
        return float(np.add.reduceat(np.abs(self.vals), self.starts).max()) if len(self.vals) else 0.0

    def diagonal(self) -> np.ndarray:
        own = np.repeat(self.rows, np.diff([*self.starts, len(self.vals)])) == self.cols
        out = np.zeros(len(self.ids))
        np.add.at(out, self.cols[own], self.vals[own])
        return out

    def shift(self) -> float:
        """A small part of the least positive diagonal element, which is no less than a positive low eigenvalue's size."""
        d = self.diagonal()
        return 0.1 * float(d[d > 0].min()) if (d > 0).any() else 1.0

    def lowest(self, m: int, room: int, tolerance: float = 1e-6, shift: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids, values, vectors) of the m smallest eigenpairs, or None where CHAIN_PRODUCTS products, or with a shift SOLVE_ENTRIES entries, do not tell them.

        Lanczos with full reorthogonalisation that restarts from its lowest vectors; it holds ``room`` of them at most. Once the m pairs have residuals of at most the
        tolerance (or rounding at the operator's norm), a fresh vector orthogonal to them starts another chain; only
        if the next pair converges too and none of the m values has changed are they final, so that no repeated one is missed.

        With a shift the chain is of -(L + shift I)^-1, each step a solve by conjugate gradients: where strong edges make the operator's norm
        many times its low eigenvalues, few steps tell them. A last solve takes from the vectors what rounding the norm would enlarge.
        """
        n = len(self.ids)
        width = min(n, room - 1)
        allowed = max(tolerance, 64 * np.finfo(float).eps * self.norm())
        rng = np.random.default_rng(1)
        q, t, settled = np.zeros((width + 1, n)), np.zeros((width, width)), None
        scale, every = self.diagonal() + shift if shift else None, 8 if shift else 32

        def fresh(at: int) -> None:
            x = rng.standard_normal(n)
            for _ in range(3):
                x -= (q[:at] @ x) @ q[:at]
                x /= np.linalg.norm(x)
            q[at] = x

        fresh(0)
        k, made = 0, 0
        while made < (SOLVE_ENTRIES // max(len(self.vals), 1) if shift else CHAIN_PRODUCTS):
            if shift:
                w, products = self.inverse(q[k], shift, scale)
                if w is None:
                    return None
                w = -w
            else:
                w, products = self.times(q[k]), 1
            made += products
            h = np.zeros(k + 1)
            for _ in range(2):
                part = q[: k + 1] @ w
                w -= part @ q[: k + 1]
                h += part
            t[k, : k + 1] = t[: k + 1, k] = h
            size = float(np.linalg.norm(w))
            k += 1
            if size > 1e-10 * max(0.0 if shift else allowed, abs(h).max()):
                q[k] = w / size
            elif k < n:  # a chain has come to its end: what it holds is exact, and another one begins
                size = 0.0
                fresh(k)
            if k % every and k < width:
                continue
            wanted = min(m + (settled is not None), n)
            of, y = np.linalg.eigh(t[:k, :k])
            left = size * np.abs(y[-1, :wanted]) if k < n else np.zeros(wanted)
            values = of
            if shift:  # residuals of the operator after the last solve
                values = -1 / np.minimum(of, -np.finfo(float).tiny) - shift
                left = left * (values[:wanted] + shift) ** 2
            if k >= wanted and left.max() <= allowed:
                if settled is not None and np.allclose(values[:m], settled, rtol=1e-8, atol=allowed) or k >= n:
                    vectors = y[:, :m].T @ q[:k]
                    if shift:
                        solved = [self.inverse(v, shift, scale)[0] for v in vectors]
                        if any(v is None for v in solved):
                            return None
                        basis = np.linalg.qr(np.transpose(solved))[0].T
                        inner = basis @ np.transpose([self.times(v) for v in basis])
                        lam, mix = np.linalg.eigh((inner + inner.T) / 2)
                        vectors, values = mix.T @ basis, lam
                    worst = max(float(np.linalg.norm(self.times(v) - lam * v)) for lam, v in zip(values, vectors))
                    return (self.ids, values[:m], np.ascontiguousarray(vectors.T)) if worst <= 10 * allowed else None
                settled, kept = values[:m].copy(), m
            elif k >= width:
                kept = wanted + (width - wanted) // 3
            else:
                continue
            last = q[k].copy()
            q[:kept] = y[:, :kept].T @ q[:k]
            t[:] = 0
            t[np.arange(kept), np.arange(kept)] = of[:kept]
            if kept == m and k >= wanted and left.max() <= allowed:
                fresh(kept)
            else:
                q[kept] = last
            k = kept
        return None

    def inverse(self, b: np.ndarray, shift: float, diagonal: np.ndarray) -> tuple[np.ndarray | None, int]:
        """(x, products) with (shift I + L) x = b by conjugate gradients, scaled by the whole ``diagonal``; its residual is measured in that scale."""
        x, r = np.zeros(len(b)), b.copy()
        z = r / diagonal
        p, rz = z.copy(), float(r @ z)
        least = 1e-24 * rz
        for made in range(SPARSE_PRODUCTS):
            if rz <= least:
                return x, made
            ap = shift * p + self.times(p)
            step = rz / float(p @ ap)
            x += step * p
            r -= step * ap
            z = r / diagonal
            rz, before = float(r @ z), rz
            p = z + rz / before * p
        return None, SPARSE_PRODUCTS

    def solve(self, b: np.ndarray, a: float, t: float, tolerance: float) -> np.ndarray | None:
        """x with (a I + t L) x = b by conjugate gradients, scaled to a unit diagonal; None where SPARSE_PRODUCTS products are too few."""
        diagonal = float(a) + t * self.diagonal()
        d = np.where(diagonal > 0, diagonal, 1.0)
        x, r = np.zeros(len(b)), b.copy()
        z = r / d
        p, rz, size = z.copy(), float(r @ z), float(np.linalg.norm(b))
        for made in range(SPARSE_PRODUCTS):
            if np.linalg.norm(r) <= tolerance * size / 2:
                r = b - a * x - t * self.times(x)
                if np.linalg.norm(r) <= tolerance * size:
                    return x
                z = r / d
                p, rz = z.copy(), float(r @ z)
            ap = a * p + t * self.times(p)
            step = rz / float(p @ ap)
            x += step * p
            r -= step * ap
            z = r / d
            rz, before = float(r @ z), rz
            p = z + rz / before * p
        return None


def sparse(lap: DataFrame, ids: np.ndarray | None = None) -> Sparse:
    """The operator (i, j, val) in one kernel, over its own vertices or over ``ids``, ascending; entries of one place add."""
    got = lap.select("i", "j", "val").toArrow()
    i, j, v = (got.column(c).to_numpy() for c in ("i", "j", "val"))
    ids = np.unique(i) if ids is None else ids
    rows, cols = np.searchsorted(ids, i).astype(np.int32), np.searchsorted(ids, j).astype(np.int32)
    order = np.lexsort((cols, rows))
    rows, cols, v = rows[order], cols[order], v[order]
    own, starts = np.unique(rows, return_index=True)
    return Sparse(ids, own, starts, cols, v)


def multiply(lap: DataFrame, x: DataFrame) -> DataFrame:
    """(vertex, x) of the operator times a vector (vertex, x): one join and one aggregation."""
    return lap.join(x.select(F.col("vertex").alias("j"), "x"), "j").groupBy(F.col("i").alias("vertex")).agg(F.sum(F.col("val") * F.col("x")).alias("x"))


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _grams(both: DataFrame, minus: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Q'X, X'X) of X = (W - Q minus) times for rows (q, w); each partition hands on one row of partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            q = _rows(batch.column("q"))
            x = (_rows(batch.column("w")) - q @ minus) @ times
            part = np.concatenate([(q.T @ x).ravel(), (x.T @ x).ravel()])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["s"])

    total = np.sum([r.s for r in both.select("q", "w").mapInArrow(run, "s array<double>").collect()], axis=0)
    width = times.shape[1]
    cut = len(minus) * width
    return total[:cut].reshape(-1, width), total[cut:].reshape(width, width)


def _orthonormal(both: DataFrame) -> tuple[DataFrame | None, np.ndarray, np.ndarray]:
    """(basis, H, R): W = Q H + X R with X orthonormal and orthogonal to Q, appended to the basis; None if W lies in Q."""
    cols, width = both.select(F.size("q"), F.size("w")).first()
    minus, times, first, scale, factor = np.zeros((cols, width)), np.eye(width), None, 0.0, None
    for turn in range(3):  # rounding leaves some of Q in X twice at most
        h, g = _grams(both, minus, times)
        if first is None:
            first, scale = h, float(np.sqrt(max(np.trace(g), 0)))
            minus = minus + h
            continue
        g = g - h.T @ h
        values, u = np.linalg.eigh((g + g.T) / 2)
        keep = values > ((1e-10 * scale) ** 2 if turn == 1 else 0.25)
        if not keep.any():
            return None, first, np.zeros((0, width))
        if turn == 1:
            factor = np.sqrt(values[keep])[:, None] * u[:, keep].T
            minus, times = minus + h, u[:, keep] / np.sqrt(values[keep])
        else:
            # X times - Q h, made orthonormal
            last = u[:, keep] / np.sqrt(values[keep])
            add, factor, times_last = h @ last, np.linalg.pinv(last) @ factor, last
    project, finish = minus, times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _rows(batch.column("q"))
            x = (_rows(batch.column("w")) - q @ project) @ finish @ times_last - q @ add
            out = np.hstack([q, x])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vertex"), flat], ["vertex", "q"])

    return _checkpointed(both.select("vertex", "q", "w").mapInArrow(run, "vertex long, q array<double>")), first, factor


def lanczos(lap: DataFrame, m: int, block: int = 4, tolerance: float = 1e-6, limit: int = 800) -> Spectrum:
    """Block Lanczos with full reorthogonalisation; the basis is a table, products are joins.

    It ends when all m pairs have residuals of at most ``tolerance`` (or of rounding at the operator's
    norm), measured by a product. Then a fresh block, orthogonal to all before, grows as many
    steps; only if it changes none of the m values are they final, so that eigenvalues repeated more often than
    ``block`` are not missed. RuntimeError after ``limit`` columns. The driver holds the projected matrix only.
    """
    ids = _checkpointed(lap.select(F.col("i").alias("vertex")).distinct())
    n = ids.count()
    m, fresh = min(m, n), 0

    def random(basis: DataFrame) -> DataFrame:
        nonlocal fresh
        fresh += 1
        return basis.withColumn("w", F.array(*[uniform(F.lit(f"start{fresh}"), F.lit(k), F.col("vertex")) - 0.5 for k in range(min(block, n))]))

    basis, _, _ = _orthonormal(random(ids.withColumn("q", F.array().cast("array<double>"))))
    t = np.zeros((0, 0))
    loose: list[tuple[slice, np.ndarray]] = []  # residuals of chains that were left
    done, steps, settled, rest = 0, 0, None, None
    while True:
        cols = basis.select(F.size("q")).first()[0]
        new, width = slice(done, cols), cols - done
        product = lap.join(basis.select(F.col("vertex").alias("j"), F.slice("q", done + 1, width).alias("x")), "j").groupBy(F.col("i").alias("vertex"))
        product = product.agg(F.array(*[F.sum(F.col("val") * F.col("x")[k]) for k in range(width)]).alias("w"))
        both = _checkpointed(basis.join(product, "vertex"))
        later, h, r = _orthonormal(both)
        grown = np.zeros((cols, cols))
        grown[:done, :done] = t
        grown[:, new], grown[new, :] = h, h.T
        grown[new, new] = (h[new] + h[new].T) / 2
        t, done, steps = grown, cols, steps + 1
        values, y = np.linalg.eigh(t)
        allowed = max(tolerance, 64 * np.finfo(float).eps * abs(values).max())
        guess = np.sqrt(np.atleast_1d(np.sum([((parts @ y[at, :m]) ** 2).sum(0) for at, parts in [*loose, (new, r)]], axis=0))) if done >= m else np.array([np.inf])
        full = done >= n
        if full or guess.max() <= allowed:
            if settled is None and not full:
                settled, rest = values[:m].copy(), steps
            elif not full and rest > 0:
                rest -= 1
            else:
                same = full or np.allclose(values[:m], settled, rtol=1e-8, atol=allowed)
                if same:
                    out = _checkpointed(_mixed(basis, y[:, :m]))
                    worst = residuals(lap, out, values[:m]).max()
                    if worst <= 10 * allowed:
                        return Spectrum(values[:m], out)
                    if full:
                        raise RuntimeError(f"eigenpairs have residuals up to {worst:.3g}")
                settled, rest = values[:m].copy(), steps
            if not full and rest == steps:  # a chain begins anew beside those before
                loose.append((new, r))
                later = None
        if done >= limit:
            raise RuntimeError(f"{m} eigenpairs have residuals up to {guess.max():.3g} after {done} columns")
        while later is None and not full:
            later, _, _ = _orthonormal(random(basis))
        basis = later


def _blocks(matrix: DataFrame, state: DataFrame, carried: list[str], x: str, name: str, width: int) -> DataFrame:
    """The product of the matrix with the array column ``x``; its diagonal, which must be whole, carries other array columns."""
    rows = matrix.join(state.withColumnRenamed("vertex", "j"), "j")
    own = [F.array(*[F.sum(F.when(F.col("i") == F.col("j"), F.col(c)[k])) for k in range(width)]).alias(c) for c in carried]
    return rows.groupBy(F.col("i").alias("vertex")).agg(*own, F.array(*[F.sum(F.col("val") * F.col(x)[k]) for k in range(width)]).alias(name))


def _each(f, *columns: str) -> Column:
    """A function of the elements of two array columns."""
    return F.zip_with(*columns, f)


def _pairs_of(bases: list[str], lam: np.ndarray):
    """A kernel for mapInArrow: B'B, B'AB and the squared norms of A X - X lam, one row of partial sums a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            b = np.hstack([_rows(batch.column(c)) for c in bases])
            ab = np.hstack([_rows(batch.column("a" + c)) for c in bases])
            rest = ab[:, : len(lam)] - b[:, : len(lam)] * lam
            part = np.concatenate([(b.T @ b).ravel(), (b.T @ ab).ravel(), (rest * rest).sum(0)])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["s"])

    return run


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def _turned(bases: list[str], mix: np.ndarray, lam: np.ndarray):
    """A kernel for mapInArrow: the block X of the mixed bases, the direction P that it moved by, their products, and what is left of A X."""
    width = len(lam)
    way = mix.copy()
    way[:width] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b = np.hstack([_rows(batch.column(c)) for c in bases])
            ab = np.hstack([_rows(batch.column("a" + c)) for c in bases])
            x, ax, d = b @ mix, ab @ mix, batch.column("d").to_numpy()
            out = [_lists(v) for v in (x, ax, b @ way, ab @ way, (ax - x * lam) / d[:, None])]
            yield pa.RecordBatch.from_arrays([batch.column("vertex"), batch.column("d"), *out], ["vertex", "d", "x", "ax", "p", "ap", "r"])

    return run


def lowest(lap: DataFrame, m: int, tolerance: float = 1e-6, rounds: int = 100, guard: int = 4) -> Spectrum:
    """The m smallest eigenpairs of a positive semidefinite operator, by locally optimal blocks with a preconditioner.

    A block of m + guard vectors moves to the best of what it, its preconditioned residuals and its last step span. The
    preconditioner is the polynomial of ``solve`` on the operator scaled to a unit diagonal, so that densities at their floor do no
    harm. A round is PRODUCTS products in one job, one table and one aggregation; the driver holds matrices of three
    times the block's width. It ends when m residuals are at most ``tolerance`` (or rounding at the operator's
    norm), measured by a product; RuntimeError after ``rounds``.
    """
    ids = lap.select(F.col("i").alias("vertex")).distinct()
    matrix, size, top = scaled(lap, ids, 0.0)
    norm = lap.groupBy("i").agg(F.sum(F.abs("val")).alias("s")).agg(F.max("s")).first()[0]
    allowed, width = max(tolerance, 64 * np.finfo(float).eps * norm), m + guard
    factors = _factors(top)

    def with_product(block: DataFrame) -> DataFrame:
        """(vertex, d, x, ax) for (vertex, d, x)."""
        u = block.select("vertex", F.transform("x", lambda v: v * F.col("d")).alias("u"))
        got = _blocks(matrix, u, [], "u", "ax", width)
        return _checkpointed(block.join(got, "vertex").select("vertex", "d", "x", F.transform("ax", lambda v: v * F.col("d")).alias("ax")))

    start = size.withColumn("x", F.array(*[uniform(F.lit("block"), F.lit(k), F.col("vertex")) - 0.5 for k in range(width)]))
    state, bases, lam, worst = with_product(start), ["x"], np.zeros(width), np.inf
    for _ in range(rounds):
        kernel = _pairs_of(bases, lam)
        n = width * len(bases)
        sums = np.sum([r.s for r in state.select(*bases, *["a" + b for b in bases]).mapInArrow(kernel, "s array<double>").collect()], axis=0)
        g, h, left = sums[: n * n].reshape(n, n), sums[n * n : 2 * n * n].reshape(n, n), np.sqrt(sums[2 * n * n :])
        if len(bases) > 1 and left[:m].max() <= allowed:
            out = _checkpointed(state.select("vertex", F.slice("x", 1, m).alias("v")))
            worst = residuals(lap, out, lam[:m]).max()
            if worst <= 10 * allowed:
                return Spectrum(lam[:m], out)
            state, bases = with_product(state.select("vertex", "d", "x")), ["x"]  # products drifted: begin anew from here
            continue
        worst = left[:m].max()
        scale = 1 / np.sqrt(np.maximum(np.diag(g), np.finfo(float).tiny))
        values, u = np.linalg.eigh(g * np.outer(scale, scale))
        keep = values > 1e-12 * values.max()
        z = scale[:, None] * u[:, keep] / np.sqrt(values[keep])
        lam, y = np.linalg.eigh(z.T @ (h + h.T) @ z / 2)
        lam, mix = lam[:width], z @ y[:, :width]
        moved = state.mapInArrow(_turned(bases, mix, lam), "vertex long, d double, x array<double>, ax array<double>, p array<double>, ap array<double>, r array<double>")
        first = len(bases) == 1
        # by Horner's rule, so that only the residuals travel beside what is multiplied
        now, top_factor = moved.select("vertex", "r", F.col("r").alias("u")), float(factors[-1])
        for factor in map(float, factors[-2::-1]):
            now = _blocks(matrix, now, ["r"], "u", "au", width).select("vertex", "r", _each(lambda a, b: factor * a + top_factor * b, "r", "au").alias("u"))  # noqa: B023
            top_factor = 1.0
        now = _blocks(matrix, now, ["u"], "u", "au", width)
        kept = ["x", "ax"] if first else ["x", "ax", "p", "ap"]
        both = moved.select("vertex", "d", *kept).join(now, "vertex")
        state = _checkpointed(both.select("vertex", "d", *kept, F.transform("u", lambda v: v / F.col("d")).alias("w"), F.transform("au", lambda v: v * F.col("d")).alias("aw")))
        bases = ["x", "w"] if first else ["x", "w", "p"]
    raise RuntimeError(f"{m} eigenpairs have residuals up to {worst:.3g} after {rounds} rounds")


def _mixed(basis: DataFrame, y: np.ndarray) -> DataFrame:
    """(vertex, v): combinations of the basis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _rows(batch.column("q")) @ y
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vertex"), flat], ["vertex", "v"])

    return basis.select("vertex", "q").mapInArrow(run, "vertex long, v array<double>")


def residuals(lap: DataFrame, vectors: DataFrame, values: np.ndarray) -> np.ndarray:
    """The norm of L v - lambda v for each eigenpair."""
    m = len(values)
    product = lap.join(vectors.withColumnRenamed("vertex", "j"), "j").groupBy(F.col("i").alias("vertex")).agg(*[F.sum(F.col("val") * F.col("v")[k]).alias(f"p{k}") for k in range(m)])
    both = vectors.join(product, "vertex")
    return np.sqrt([float(x or 0.0) for x in both.agg(*[F.sum(F.pow(F.col(f"p{k}") - float(values[k]) * F.col("v")[k], 2)) for k in range(m)]).first()])


def coefficients(vectors: DataFrame, responses: DataFrame, m: int, by: list[str] | None = None) -> DataFrame:
    """Inner products of each response with each mode: (by..., a array, yy, n). responses: (vertex, by..., y)."""
    rows = responses.join(vectors, "vertex")
    sums = [F.sum(F.col("v")[k] * F.col("y")).alias(f"_a{k}") for k in range(m)]
    out = rows.groupBy(*(by or [])).agg(*sums, F.sum(F.col("y") * F.col("y")).alias("yy"), F.count("*").alias("n"))
    return out.select(*(by or []), F.array(*[f"_a{k}" for k in range(m)]).alias("a"), "yy", "n")


def combine(weights: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(v, weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def filter_matrix(name: str, values: np.ndarray, etas: list[float]) -> np.ndarray:
    """(etas, modes) of filter weights."""
    lam, eta = np.maximum(values, 0)[None, :], np.array(etas)[:, None]
    return {
        "heat_kernel": lambda: np.exp(-eta * lam), "tikhonov": lambda: 1 / (1 + eta * lam), "cubic_spline": lambda: 1 / (1 + eta * lam**2),
        "gaussian": lambda: np.exp(-eta * lam**2), "exponential": lambda: np.exp(-eta * np.sqrt(lam)), "butterworth": lambda: 1 / (1 + (lam / eta) ** 4),
    }[name]()


assert set(FILTERS) == {"heat_kernel", "tikhonov", "cubic_spline", "gaussian", "exponential", "butterworth"}


def gcv_scores(weights: np.ndarray, a: np.ndarray, yy: float, n: int) -> np.ndarray:
    """GCV for each row of filter weights; the residual sum follows from orthonormality of the modes."""
    rss = np.maximum(yy - ((2 * weights - weights**2) * a**2).sum(1), 0)
    return rss / np.maximum(n - weights.sum(1), 1e-10) ** 2


def gcv_by_column(coef: DataFrame, values: np.ndarray, name: str, etas: list[float], by: list[str]) -> DataFrame:
    """(by..., eta, gcv, f array): the best eta of each response, the first on ties; all in one projection."""
    grid = filter_matrix(name, values, etas)
    score = lambda f: F.array(*[
        F.greatest(F.col("yy") - F.aggregate(F.zip_with("a", F.array(*map(F.lit, (2 * w - w**2).tolist())), lambda x, c: x * x * c), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
        / F.pow(F.greatest(F.col("n") - float(w.sum()), F.lit(1e-10)), 2)
        for w in grid
    ])
    rows = coef.withColumn("_s", score(grid)).withColumn("gcv", F.array_min("_s")).withColumn("_at", F.array_position("_s", F.col("gcv")).cast("int"))
    table = F.array(*[F.array(*map(F.lit, w.tolist())) for w in grid])
    return rows.select(*by, "a", "yy", "n", F.element_at(F.array(*map(F.lit, etas)), F.col("_at")).alias("eta"), "gcv", F.element_at(table, F.col("_at")).alias("f"))


def diffusion_parameters(gap: float, t_scale: float = 0.5, beta_scale: float = 0.1) -> tuple[float, float]:
    """(t, beta) from the spectral gap."""
    t = min(20.0, t_scale / max(gap, 0.01))
    return t, max(1e-4, beta_scale / t)


def diffusion_columns(gap: Column, t_scale: float = 0.5, beta_scale: float = 0.1) -> tuple[Column, Column]:
    """(t, beta) of a column of spectral gaps."""
    t = F.least(F.lit(20.0), t_scale / F.greatest(gap, F.lit(0.01)))
    return t, F.greatest(F.lit(1e-4), beta_scale / t)


def zero_modes(lap: DataFrame, root: DataFrame, tolerance: float = 1e-10) -> int:
    """How often zero is an eigenvalue of a mass-symmetrised Laplacian, for the square roots (vertex, x) of its masses.

    The root of the masses, on one connected component and zero elsewhere, is a null vector; components are found by their
    labels, and a product says for each whether the operator really takes it to zero. Others add no null vector.
    """
    from .graph import components

    vertices = lap.select(F.col("i").alias("vertex")).distinct()
    labels = _checkpointed(components(vertices, lap.where("i < j and val != 0").select("i", "j")))
    size = lap.agg(F.max(F.abs("val"))).first()[0] or 0.0
    off = multiply(lap, root).join(labels, "vertex").join(root.withColumnRenamed("x", "own"), "vertex")
    per = off.groupBy("component").agg(F.sqrt(F.sum(F.col("x") * F.col("x")) / F.sum(F.col("own") * F.col("own"))).alias("r"))
    return per.where(F.col("r") <= tolerance * max(size, 1.0)).count()


#: Products that one round of conjugate gradients makes before anything is written.
PRODUCTS = 4


def scaled(lap: DataFrame, vertices: DataFrame, a: float) -> tuple[DataFrame, DataFrame, float]:
    """(D^-1/2 (a I + L) D^-1/2 with a whole diagonal, (vertex, d) with the roots of its diagonal D, a bound of its eigenvalues).

    A vertex whose diagonal is zero keeps d = 1. Badly scaled operators, as of densities at their floor, become tame by it.
    """
    unit = vertices.select(F.col("vertex").alias("i"), F.col("vertex").alias("j"), F.lit(float(a)).alias("val"))
    rows = _checkpointed(lap.select("i", "j", "val").unionByName(unit).groupBy("i", "j").agg(F.sum("val").alias("val")))
    size = rows.where("i = j").select(F.col("i").alias("vertex"), F.sqrt(F.when(F.col("val") > 0, F.col("val")).otherwise(1.0)).alias("d"))
    ends = rows.join(size.select(F.col("vertex").alias("i"), F.col("d").alias("di")), "i").join(size.select(F.col("vertex").alias("j"), F.col("d").alias("dj")), "j")
    matrix = _checkpointed(ends.select("i", "j", (F.col("val") / F.col("di") / F.col("dj")).alias("val")))
    return matrix, size, matrix.groupBy("i").agg(F.sum(F.abs("val")).alias("s")).agg(F.max("s")).first()[0]


def _span(top: float) -> tuple[float, float]:
    """Middle and half width of the part of (0, top] on which the polynomials are small."""
    return top * (1 + 1 / 30) / 2, top * (1 - 1 / 30) / 2


def _factors(top: float) -> np.ndarray:
    """The factors, constant first, of the polynomial that ``solve`` takes as a preconditioner in PRODUCTS - 1 products."""
    middle, half = _span(top)
    u = c = np.r_[1 / middle, np.zeros(PRODUCTS - 1)]
    turn, one = half / middle, np.r_[1.0, np.zeros(PRODUCTS - 1)]
    for _ in range(PRODUCTS - 1):
        after = 1 / (2 * middle / half - turn)
        c = after * turn * c + 2 * after / half * (one - np.r_[0.0, u[:-1]])
        u, turn = u + c, after
    return u


def _beside(matrix: DataFrame, state: DataFrame, x: str, name: str) -> DataFrame:
    """``state`` with the product of the matrix and its column ``x``; the diagonal, which must be whole, carries the other columns,
    so that a product stays one join and one aggregation however many follow each other."""
    rows = matrix.join(state.withColumnRenamed("vertex", "j"), "j")
    own = [F.max(F.when(F.col("i") == F.col("j"), F.col(c))).alias(c) for c in state.columns if c != "vertex"]
    return rows.groupBy(F.col("i").alias("vertex")).agg(*own, F.sum(F.col("val") * F.col(x)).alias(name))


def solve(lap: DataFrame, b: DataFrame, a: float, t: float, tolerance: float = 1e-8, rounds: int = 500) -> DataFrame:
    """(vertex, x) with (a I + t L) x = b for b (vertex, x), a > 0 and L positive semidefinite.

    A dense solve up to DENSE vertices, and one sparse kernel up to ENTRIES entries. Beyond, conjugate gradients on the system scaled to a unit diagonal, preconditioned by
    a Chebyshev polynomial below the bound that row sums give: a round is PRODUCTS products in one job, one table and
    one aggregation. What the recurrence calls solved is measured by a product, and taken up again from there if it is not.
    RuntimeError if the residual does not fall below ``tolerance`` of the right side.
    """
    n = b.count()
    if n <= DENSE:
        got = b.toArrow()
        at, right = (got.column(c).to_numpy() for c in ("vertex", "x"))
        order = np.argsort(at)
        ids, matrix = dense(lap)
        full = a * np.eye(len(at))
        spot = np.searchsorted(at[order], ids)
        full[np.ix_(spot, spot)] += t * matrix
        x = np.linalg.solve(full, right[order])
        return b.sparkSession.createDataFrame([(int(i), float(v)) for i, v in zip(at[order], x)], "vertex long, x double")
    if n <= DENSE**2 // 16 and lap.count() <= ENTRIES:
        got = b.select("vertex", "x").toArrow()
        at, right = (got.column(c).to_numpy() for c in ("vertex", "x"))
        order = np.argsort(at)
        x = sparse(lap, at[order]).solve(right[order].astype(np.float64), a, t, min(tolerance, 1e-12))
        if x is not None:
            return _checkpointed(b.sparkSession.createDataFrame(pa.table({"vertex": pa.array(at[order], pa.int64()), "x": x})))
    matrix, size, top = scaled(lap.select("i", "j", (t * F.col("val")).alias("val")), b.select("vertex"), a)
    nought = F.lit(0.0)
    state = _checkpointed(b.join(size, "vertex").select("vertex", "d", (F.col("x") / F.col("d")).alias("y"), nought.alias("x")))
    first = state.agg(F.sum(F.pow(F.col("y") * F.col("d"), 2))).first()[0] or 0.0
    middle, half = _span(top)
    left, done, starts = first, 0, 0
    while True:
        # from the residual as a product tells it
        state = _beside(matrix, state.select("vertex", "d", "y", "x"), "x", "ax").withColumn("r", F.col("y") - F.col("ax")).drop("ax")
        state = _checkpointed(state.withColumns({"p": nought, "s": nought}))
        before, left = left, state.agg(F.sum(F.pow(F.col("r") * F.col("d"), 2))).first()[0] or 0.0
        if left <= tolerance**2 * first:
            return state.select("vertex", (F.col("x") / F.col("d")).alias("x"))
        if done >= rounds or starts and left > before / 4:
            raise RuntimeError(f"the residual is still {math.sqrt(left / first):.3g} of the right side after {done} rounds")
        starts += 1
        target, rho, step = max(left * 1e-12, tolerance**2 * first / 4), 0.0, 0.0
        while done < rounds:
            done += 1
            turn, now = half / middle, state.withColumns({"u": F.col("r") / middle, "c": F.col("r") / middle})
            for _ in range(PRODUCTS - 1):
                after = 1 / (2 * middle / half - turn)
                now = _beside(matrix, now, "u", "au").withColumn("c", after * turn * F.col("c") + 2 * after / half * (F.col("r") - F.col("au"))).drop("au")
                now, turn = now.withColumn("u", F.col("u") + F.col("c")), after
            now = _checkpointed(_beside(matrix, now.drop("c"), "u", "w"))
            ru, uw, rr = now.agg(F.sum(F.col("r") * F.col("u")), F.sum(F.col("u") * F.col("w")), F.sum(F.pow(F.col("r") * F.col("d"), 2))).first()
            if rr <= target or not ru:
                state = now
                break
            keep = ru / rho if rho else 0.0
            step = ru / (uw - keep * ru / step) if rho else ru / uw
            rho = ru
            now = now.withColumns({"p": F.col("u") + keep * F.col("p"), "s": F.col("w") + keep * F.col("s")})
            state = now.select("vertex", "d", "y", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("s")).alias("r"), "p", "s")


#: Up to so many unknowns a symmetric system that need not be definite is solved by elimination.
ELIMINATED = 8192


def least_residual(lap: DataFrame | None, b: DataFrame, a: float, tolerance: float = 1e-8, rounds: int | None = None, product: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, float]:
    """((vertex, x), relative residual) for (a I + L) x = b with L symmetric, definite or not.

    Elimination up to ELIMINATED unknowns. Beyond, or where L is only known by its ``product``, Lanczos steps keep the x of least residual among all that
    they reach, until it is at most the tolerance; indefinite systems may need more steps than unknowns, and RuntimeError tells where four times as many are
    too few. With ``rounds`` they end there at the latest, and the residual tells how far that is.
    """
    if product is None and b.count() <= ELIMINATED:
        got = b.toArrow()
        at, right = (got.column(c).to_numpy() for c in ("vertex", "x"))
        order = np.argsort(at)
        ids, matrix = dense(lap)
        full = a * np.eye(len(at))
        spot = np.searchsorted(at[order], ids)
        full[np.ix_(spot, spot)] += matrix
        x = np.linalg.solve(full, right[order])
        size = float(np.linalg.norm(right)) or 1.0
        return b.sparkSession.createDataFrame([(int(i), float(v)) for i, v in zip(at[order], x)], "vertex long, x double"), float(np.linalg.norm(full @ x - right[order])) / size
    size = math.sqrt(b.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0)
    nought = F.lit(0.0)
    state = _checkpointed(b.select("vertex", (F.col("x") / (size or 1.0)).alias("v"), nought.alias("v0"), nought.alias("w"), nought.alias("w0"), nought.alias("z")))
    if not size:
        return state.select("vertex", F.col("z").alias("x")), 0.0
    eta, beta, c, c0, s, s0 = size, 0.0, 1.0, 1.0, 0.0, 0.0
    for _ in range(4 * b.count() + 60 if rounds is None else rounds):
        v = state.select("vertex", F.col("v").alias("x"))
        both = _checkpointed(state.join(product(v) if product else multiply(lap, v), "vertex", "left").withColumn("p", a * F.col("v") + F.coalesce("x", nought) - beta * F.col("v0")).drop("x"))
        alpha, pp = both.agg(F.sum(F.col("p") * F.col("v")), F.sum(F.col("p") * F.col("p"))).first()
        after = math.sqrt(max(pp - alpha * alpha, 0.0))
        # rotations make the projected matrix triangular
        d = c * alpha - c0 * s * beta
        r1, r2, r3 = math.hypot(d, after), s * alpha + c0 * c * beta, s0 * beta
        c0, s0, c, s = c, s, d / r1, after / r1
        w = (F.col("v") - r3 * F.col("w0") - r2 * F.col("w")) / r1
        moved = both.withColumn("now", w)
        state = moved.select("vertex", ((F.col("p") - alpha * F.col("v")) / (after or 1.0)).alias("v"), F.col("v").alias("v0"), F.col("now").alias("w"), F.col("w").alias("w0"), (F.col("z") + c * eta * F.col("now")).alias("z"))
        eta, beta = -s * eta, after
        if abs(eta) <= tolerance * size or not after:
            break
    if rounds is None and abs(eta) > max(1e-6, tolerance) * size:
        raise RuntimeError(f"the residual is still {abs(eta) / size:.3g} of the right side")
    return _checkpointed(state.select("vertex", F.col("z").alias("x"))), abs(eta) / size


def diffuse(lap: DataFrame, rho: DataFrame, t: float, beta: float) -> DataFrame:
    """(vertex, rho) with ((1 + t beta) I + t L) rho' = rho + t beta, clipped, scaled to n and floored."""
    from .measures import normalised

    x = solve(lap, rho.select("vertex", (F.col("rho") + t * beta).alias("x")), 1 + t * beta, t)
    return normalised(x.select("vertex", F.greatest("x", F.lit(0.0)).alias("raw")), "raw").select("vertex", "rho")
