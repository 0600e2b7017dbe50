"""Smoothing splines of long curves: the cubic spline as the mean of a chain of states, reduced in a tree."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenfield.sources.tables import checkpointed

from .graph import numbered

#: Knots that one task takes at a time; a block hands on one row for each penalty.
BLOCK = 1 << 16
#: Penalties tried, as multiples of the third power of the range of x.
PENALTIES = np.geomspace(1e-8, 1e4, 49)


class Piece(NamedTuple):
    """Knots in a row, for states (value, slope): the last one given the first is normal with mean ``a`` first + ``b`` and
    covariance ``c``; what they say of the first is information ``j`` and its vector ``e``. Leading axes are free."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    e: np.ndarray
    j: np.ndarray

    def at(self, k) -> "Piece":
        return Piece(*(x[:, k] for x in self))

    def flat(self) -> np.ndarray:
        """One row of sixteen numbers for each piece."""
        return np.concatenate([self.a.reshape(*self.b.shape[:-1], 4), self.b, self.c.reshape(*self.b.shape[:-1], 4), self.e, self.j.reshape(*self.b.shape[:-1], 4)], -1)


def _piece(rows: np.ndarray) -> Piece:
    """The inverse of ``flat``, for (..., 16)."""
    square = lambda lo: rows[..., lo : lo + 4].reshape(*rows.shape[:-1], 2, 2)
    return Piece(square(0), rows[..., 4:6], square(6), rows[..., 10:12], square(12))


def _identity(*lead: int) -> Piece:
    zero = np.zeros((*lead, 2, 2))
    return Piece(np.broadcast_to(np.eye(2), zero.shape).copy(), zero[..., 0], zero, zero[..., 0], zero)


def _inverse(m: np.ndarray) -> np.ndarray:
    det = m[..., 0, 0] * m[..., 1, 1] - m[..., 0, 1] * m[..., 1, 0]
    turned = np.stack([np.stack([m[..., 1, 1], -m[..., 0, 1]], -1), np.stack([-m[..., 1, 0], m[..., 0, 0]], -1)], -2)
    return turned / det[..., None, None]


def _times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (m @ v[..., None])[..., 0]


def joined(left: Piece, right: Piece) -> Piece:
    """One piece of two that meet; associative."""
    inner = _inverse(np.eye(2) + left.c @ right.j)
    forth, back = right.a @ inner, np.swapaxes(inner @ left.a, -1, -2)
    return Piece(
        forth @ left.a, _times(forth, left.b + _times(left.c, right.e)) + right.b, forth @ left.c @ np.swapaxes(right.a, -1, -2) + right.c,
        _times(back, right.e - _times(right.j, left.b)) + left.e, back @ right.j @ left.a + left.j,
    )


def scanned(pieces: Piece, join: Callable[[Piece, Piece], Piece] = joined) -> Piece:
    """Every piece joined with all before it (second axis), by neighbours first, so that all steps are whole arrays."""
    n = pieces.b.shape[1]
    if n == 1:
        return pieces
    every = scanned(join(pieces.at(slice(0, n - 1, 2)), pieces.at(slice(1, n, 2))), join)
    out = Piece(*(np.empty_like(x) for x in pieces))
    later = join(every.at(slice(0, (n - 1) // 2)), pieces.at(slice(2, n, 2))) if n > 2 else None
    for k, x in enumerate(out):
        x[:, 0], x[:, 1::2] = pieces[k][:, 0], every[k]
        if later is not None:
            x[:, 2::2] = later[k]
    return out


def whole(pieces: Piece) -> Piece:
    """All pieces of the second axis as one."""
    while (n := pieces.b.shape[1]) > 1:
        pairs = joined(pieces.at(slice(0, n - 1, 2)), pieces.at(slice(1, n, 2)))
        pieces = Piece(*(np.concatenate([p, x[:, -1:]], 1) for p, x in zip(pairs, pieces))) if n % 2 else pairs
    return pieces.at(0)


def _back(pieces: Piece) -> Piece:
    """Every piece joined with all after it."""
    return scanned(pieces.at(slice(None, None, -1)), lambda a, b: joined(b, a)).at(slice(None, None, -1))


def knots(u: np.ndarray, y: np.ndarray, w: np.ndarray, before: float | None, penalties: np.ndarray) -> Piece:
    """A piece for each penalty and knot: the way from the knot before, ``before`` for the first (None: there is none)."""
    h = np.diff(u, prepend=u[0] if before is None else before)
    noise = np.array([[h**3 / 3, h**2 / 2], [h**2 / 2, h]]).transpose(2, 0, 1) / penalties[:, None, None, None]
    move = np.broadcast_to(np.eye(2), (len(h), 2, 2)).copy()
    move[:, 0, 1] = h
    spread = noise[..., 0, 0] + 1 / w
    gain = noise[..., :, 0] / spread[..., None]
    keep = np.broadcast_to(np.eye(2), noise.shape).copy()
    keep[..., 0] -= gain
    seen = move[:, 0, :] / spread[..., None]
    return Piece(keep @ move, gain * y[:, None], keep @ noise, seen * y[:, None], seen[..., :, None] * move[:, None, 0, :])


def states(pieces: Piece, prefix: Piece, suffix: Piece, first: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(means, variances of the value) of all knots of a block, given what lies outside it and (mean, covariance) of the first knot of all."""
    whole = Piece(*(np.concatenate([p[:, None], x, s[:, None]], 1) for p, x, s in zip(prefix, pieces, suffix)))
    until, after = scanned(whole.at(slice(0, -1))).at(slice(1, None)), _back(whole.at(slice(1, None))).at(slice(1, None))
    mean, cov = first[0][:, None], first[1][:, None]
    given = _inverse(np.eye(2) + until.c @ after.j)
    at = _times(given, _times(until.a, mean) + until.b + _times(until.c, after.e))
    ahead = given @ until.a
    return at, (given @ until.c)[..., 0, 0] + (ahead @ cov @ np.swapaxes(ahead, -1, -2))[..., 0, 0]


def shares(n: int, penalties: int) -> list[slice]:
    """Runs of penalties whose pieces for n knots stay of bounded size."""
    many = max(1, BLOCK // n)
    return [slice(k, k + many) for k in range(0, penalties, many)]


class Chain:
    """The distinct x of a table (x, y) with mean y and count, numbered and cut into blocks.

    Rows whose x or y is null or not finite are left out. The driver holds sixteen numbers for each block and penalty,
    tasks one block. At least four distinct x are needed, else ValueError.
    """

    def __init__(self, rows: DataFrame, block: int = BLOCK):
        ok = rows.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("abs(x) < double('infinity') and abs(y) < double('infinity')")
        means = ok.groupBy("x").agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("w"))
        number = numbered(means, ["x"], "r").withColumn("block", F.floor((F.col("r") - 1) / block))
        self.table = checkpointed(number.select("block", "x", "y", "w"))
        ends = self.table.groupBy("block").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).orderBy("block").collect()
        self.n = sum(r.n for r in ends)
        if self.n < 4:
            raise ValueError("at least four distinct x are needed")
        self.lo, self.width = ends[0].lo, ends[-1].hi - ends[0].lo
        self.last = [(r.hi - self.lo) / self.width for r in ends]

    def mapped(self, run: Callable[..., list[np.ndarray]], schema: str) -> DataFrame:
        """The columns that ``run(block, u, y, w, before)`` makes of each block; u are the x on (0, 1), before the last of the block before."""
        lo, width, last, names = self.lo, self.width, self.last, [c.split()[0] for c in schema.split(", ")]

        def block(table: pa.Table) -> pa.Table:
            table = table.sort_by("x")
            x, y, w = (table.column(c).to_numpy() for c in ("x", "y", "w"))
            at = table.column("block")[0].as_py()
            got = run(at, (x - lo) / width, y, w, last[at - 1] if at else None)
            return pa.table([pa.array(c.tolist() if c.ndim > 1 else c) for c in got], names=names)

        return self.table.groupBy("block").applyInArrow(block, schema)

    def outer(self, penalties: np.ndarray) -> tuple[Piece, Piece, Piece, tuple[np.ndarray, np.ndarray]]:
        """(before, own, after, first): what all blocks before each block come to, the block, all after it, by penalty and
        block; and by penalty the mean and covariance of the first knot of all."""

        def run(at, u, y, w, before):
            rows = np.concatenate([whole(knots(u, y, w, before, penalties[s])).flat() for s in shares(len(u), len(penalties))])
            return [np.full(len(penalties), at), np.arange(len(penalties)), rows]

        flat = np.zeros((len(penalties), len(self.last), 16))
        for r in self.mapped(run, "block long, k long, p array<double>").toLocalIterator():
            flat[r.k, r.block] = r.p
        own, one = _piece(flat), _identity(len(penalties), 1)
        until, after = scanned(own), _back(own)
        cov = _inverse(until.at(-1).j)
        before = Piece(*(np.concatenate([o, x[:, :-1]], 1) for o, x in zip(one, until)))
        return before, own, Piece(*(np.concatenate([x[:, 1:], o], 1) for o, x in zip(one, after))), (_times(cov, until.at(-1).e), cov)

    def scores(self, penalties: np.ndarray) -> list[tuple[float, float]]:
        """(generalised cross-validation score, root of the mean squared rest) for each penalty."""
        before, _, after, (mean, cov) = self.outer(penalties)

        def run(at, u, y, w, edge):
            sums = []
            for s in shares(len(u), len(penalties)):
                lead, tail = (Piece(*(x[s, at] for x in p)) for p in (before, after))
                got, spread = states(knots(u, y, w, edge, penalties[s]), lead, tail, (mean[s], cov[s]))
                off = (y - got[..., 0]) ** 2
                sums.append(np.stack([(w * off).sum(1), (w * spread).sum(1), off.sum(1)]))
            return [np.arange(len(penalties)), *np.concatenate(sums, 1)]

        rows = self.mapped(run, "k long, rss double, trace double, off double").groupBy("k").agg(*[F.sum(c).alias(c) for c in ("rss", "trace", "off")])
        return [(r.rss / max(self.n - r.trace, 1e-10) ** 2, float(np.sqrt(r.off / self.n))) for r in rows.orderBy("k").collect()]

    def curve(self, penalty: float, points: int, band: float) -> DataFrame:
        """(x, fit, lower, upper) on ``points`` evenly spread x; each block fills the gaps that end at its knots."""
        one = np.array([penalty])
        before, own, after, (mean, cov) = self.outer(one)
        # the last knot of each block, for the block after it
        until = joined(before, own)
        edges = _times(_inverse(np.eye(2) + until.c @ after.j), _times(until.a, mean[:, None]) + until.b + _times(until.c, after.e))[0]
        lo, width, step = self.lo, self.width, 1 / (points - 1)

        def run(at, u, y, w, edge):
            lead, tail = (Piece(*(x[:, at] for x in p)) for p in (before, after))
            knot = states(knots(u, y, w, edge, one), lead, tail, (mean, cov))[0][0]
            # what lies before the first knot of all is a straight line
            last = edges[at - 1] if edge is not None else knot[0] - [step * knot[0, 1], 0]
            u, knot = np.append(-step if edge is None else edge, u), np.vstack([last, knot])
            upto = np.where(u == 1.0, points, np.floor(u / step).astype(np.int64) + 1)  # grid points up to each knot
            g = np.arange(upto[0], upto[-1])
            k = np.searchsorted(upto, g, "right") - 1
            h, t = u[k + 1] - u[k], g * step - u[k]
            (v, d), (v1, d1) = knot[k].T, knot[k + 1].T
            rise = (v1 - v) / h
            fit = v + t * (d + t / h * (3 * rise - 2 * d - d1 + t / h * (d + d1 - 2 * rise)))
            return [np.where(g == points - 1, lo + width, lo + g * step * width), fit, fit - band, fit + band]

        return self.mapped(run, "x double, fit double, lower double, upper double")


def spline(rows: DataFrame, penalty: float | None = None, block: int = BLOCK) -> DataFrame:
    """(x, fit, lower, upper) on a grid of max(200, five times the distinct x) for a table (x, y) of any length.

    The penalised natural cubic spline of the mean y by distinct x, weighted by how many rows there are; its penalty by
    generalised cross-validation, the first of PENALTIES on ties, unless given. The band is 1.96 times the root of the mean
    squared rest. Values and slopes at the knots are a chain of states whose steps are associative, so blocks of knots
    are reduced in tasks, meet on the driver as one row each, and are filled in a second pass.
    """
    chain = Chain(rows, block)
    tried = PENALTIES if penalty is None else np.array([penalty / chain.width**3])
    scores = chain.scores(tried)
    best = min(range(len(tried)), key=lambda k: scores[k][0])
    return chain.curve(float(tried[best]), max(200, 5 * chain.n), 1.96 * scores[best][1])
