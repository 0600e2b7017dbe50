"""Exact order statistics and robust clamps over whole columns, by radix selection.

A wanted rank lies in an interval of values, at first the whole line. Each pass counts, in one aggregation for all
wanted ranks, the rows of its interval by digits of an order-preserving key: first sign and binary exponent, then
``DIGITS`` equal steps between the least and the greatest value that the interval really holds. The digit that holds the rank
is the next interval. Buffers have a fixed number of cells, whatever the column; rows are never sorted or gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenfield.sources.tables import checkpointed

#: Cells of a pass for each wanted rank, and distinct values that are fetched at once to end it.
DIGITS = 4096
#: The same for each of many groups.
GROUP_DIGITS = 256


def _exponent(x: Column) -> Column:
    """Sign and binary exponent as an int that grows with x; infinities are cells of their own."""
    size = F.abs(x)
    e = F.when(size == float("inf"), 1100).otherwise(F.greatest(F.floor(F.log2(size)), F.lit(-1080))).cast("int") + 1100
    return F.when(x == 0, 0).when(x > 0, 1 + e).otherwise(-1 - e)


def at_ranks(df: DataFrame, value: str, ranks: list[int] | Callable[[int], list[int]]) -> list[float | None]:
    """Values at zero-based ranks of the sorted column (or at ranks that follow from its length); null and NaN do not count.

    Ranks beyond the ends are the ends; without values every result is None.
    """
    column = checkpointed(df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)"))
    x, bounds = F.col("x"), [F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")]

    def inside(cells: list, left: int) -> tuple[int, float, float]:
        """(rank within, least, greatest) of the cell that holds a rank; cells (digit, n, lo, hi)."""
        for _, m, lo, hi in sorted(cells):
            if left < m:
                return left, lo, hi
            left -= m
        raise AssertionError

    first = [tuple(r) for r in column.groupBy(_exponent(x).alias("d")).agg(*bounds).collect()]  # one row an exponent
    n = sum(c[1] for c in first)
    wanted = [min(max(int(r), 0), n - 1) for r in (ranks(n) if callable(ranks) else ranks)]
    if not n:
        return [None] * len(wanted)
    state = {r: inside(first, r) for r in set(wanted)}
    found = {r: lo for r, (_, lo, hi) in state.items() if lo == hi}
    state = {r: v for r, v in state.items() if r not in found}
    while state:
        cells = []
        for r, (_, lo, hi) in state.items():
            # halves, as the difference of two doubles may overflow
            place = F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * DIGITS)
            cells.append(F.when((x >= lo) & (x <= hi), F.struct(F.lit(r).cast("long").alias("r"), F.least(place, F.lit(DIGITS - 1)).cast("int").alias("d"))))
        rows = column.select("x", F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.r", "c.d")
        counts: dict[int, list] = {}
        for row in rows.agg(*bounds).collect():  # DIGITS rows a rank
            counts.setdefault(row.r, []).append((row.d, row.n, row.lo, row.hi))
        state = {r: inside(held, state[r][0]) for r, held in counts.items()}
        found |= {r: lo for r, (_, lo, hi) in state.items() if lo == hi}
        state = {r: v for r, v in state.items() if r not in found}
    return [found[r] for r in wanted]


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbouring ranks (type 7)."""
    places: list[float] = []

    def ranks(n: int) -> list[int]:
        places.extend(q * max(n - 1, 0) for q in shares)
        return [int(h) + k for h in places for k in (0, 1)]

    got = at_ranks(df, value, ranks)
    out: list[float | None] = []
    for k, h in enumerate(places):
        low, high, part = got[2 * k], got[2 * k + 1], h - int(h)
        out.append(low if low is None or not part or low == high else (1 - part) * low + part * high)
    return out


def median(df: DataFrame, value: str) -> float | None:
    return quantiles(df, value, [0.5])[0]


def by_group(df: DataFrame, by: str, value: str, share: float, name: str) -> DataFrame:
    """(by, name): a quantile of each group (type 7), by the same selection with the groups' states as a table.

    Each pass deals a group's interval to GROUP_DIGITS steps; groups are never gathered, however large one is.
    Null and NaN values and null groups do not count.
    """
    x = F.col("x")
    rows = checkpointed(df.select(by, F.col(value).cast("double").alias("x")).where(F.col(by).isNotNull() & x.isNotNull() & ~F.isnan(x)))
    place = share * (F.col("n") - 1)
    start = rows.groupBy(by).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    low = F.floor(place)
    both = F.explode(F.array(F.struct(F.lit(0).alias("k"), low.alias("rank")), F.struct(F.lit(1).alias("k"), F.least(low + 1, F.col("n") - 1).alias("rank")))).alias("e")
    state = checkpointed(start.select(by, "lo", "hi", both, (place - low).alias("part")).select(by, "e.k", "e.rank", "part", "lo", "hi"))
    done, state = state.where("lo = hi"), state.where("lo != hi")
    found = done.select(by, "k", "part", F.col("lo").alias("v"))
    before = Window.partitionBy(by, "k").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    while not state.isEmpty():
        step = F.floor((x / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * GROUP_DIGITS)
        inside = rows.join(state, by).where((x >= F.col("lo")) & (x <= F.col("hi"))).withColumn("digit", F.least(step, F.lit(GROUP_DIGITS - 1)))
        cells = inside.groupBy(by, "k", "rank", "part", "digit").agg(F.count("*").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        cells = cells.withColumn("below", F.coalesce(F.sum("m").over(before), F.lit(0))).where("rank >= below and rank < below + m")
        state = checkpointed(cells.select(by, "k", (F.col("rank") - F.col("below")).alias("rank"), "part", "lo", "hi"))
        found = found.unionByName(state.where("lo = hi").select(by, "k", "part", F.col("lo").alias("v")))
        state = state.where("lo != hi")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    return found.groupBy(by).agg(((1 - F.first("part")) * at(0) + F.first("part") * at(1)).alias(name))


def order_statistic(df: DataFrame, value: str, index: Callable[[int], int]) -> Column:
    """The value at a zero-based index (a function of n) of the sorted column."""
    return F.lit(at_ranks(df, value, lambda n: [index(n)])[0]).cast("double")


def winsorize(df: DataFrame, value: str, p: float, name: str) -> DataFrame:
    """Clamps to the quantiles p and 1 - p (linear interpolation, type 7)."""
    if not 0 < p < 0.25:
        raise ValueError("p must lie in (0, 0.25)")
    lo, hi = quantiles(df, value, [p, 1 - p])
    return df.withColumn(name, F.least(F.greatest(F.col(value), F.lit(lo)), F.lit(hi)))


def right_winsorize(df: DataFrame, value: str, p: float, name: str) -> DataFrame:
    """Clamps above only; p = 0 is the identity."""
    if not 0 <= p < 0.25:
        raise ValueError("p must lie in [0, 0.25)")
    return df.withColumn(name, F.col(value) if p == 0 else F.least(F.col(value), F.lit(quantiles(df, value, [1 - p])[0])))


def binary_clip(df: DataFrame, value: str, name: str, p: float = 0.02) -> DataFrame:
    """Prepares a fitted probability: floor 0, then the sorted value at floor(n (1 - p)) as ceiling, then 1."""
    floor = df.withColumn(name, F.greatest(F.col(value), F.lit(0.0)))
    top = order_statistic(floor, name, lambda n: int(n * (1 - p)))
    return floor.withColumn(name, F.least(F.col(name), top, F.lit(1.0)))
