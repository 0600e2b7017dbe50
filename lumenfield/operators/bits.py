"""Searches from many sources at once: 64 sources to a word, a bit each.

A state is a table (vertex, word, bits). Frontiers move by joins and ``bit_or``; what sources need of the rows that they
reach are sums for each bit of a word, taken without a row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenfield.sources.tables import checkpointed

from .graph import numbered

WIDTH = 64


def placed(sources: DataFrame) -> DataFrame:
    """Sources (source, ...) with a word and a bit of their own."""
    number = numbered(sources, ["source"], "_r")
    r = F.col("_r") - 1
    return checkpointed(number.withColumns({"word": F.floor(r / WIDTH), "bit": F.pmod(r, F.lit(WIDTH)).cast("int")}).drop("_r"))


def _bit(k: int | Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k if isinstance(k, Column) else F.lit(k))


def started(sources: DataFrame) -> DataFrame:
    """(vertex, word, bits): each source at itself."""
    return checkpointed(sources.groupBy(F.col("source").alias("vertex"), "word").agg(F.bit_or(_bit(F.col("bit"))).alias("bits")))


def masks(sources: DataFrame) -> DataFrame:
    """(word, mask) of the sources that are left."""
    return sources.groupBy("word").agg(F.bit_or(_bit(F.col("bit"))).alias("mask"))


def spread(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, word, bits) one hop on, for directed edges (vertex, nbr)."""
    return state.join(edges.select("vertex", "nbr"), "vertex").groupBy(F.col("nbr").alias("vertex"), "word").agg(F.bit_or("bits").alias("bits"))


def sums(rows: DataFrame, values: dict[str, Column | tuple[Column, Column]]) -> DataFrame:
    """(word, bit, ...): sums of the values over the rows (word, bits, ...) that hold a bit; bits that no row holds are left out.

    A value may come with an array of thresholds, one for each bit: then only rows count whose ``limit`` is below the bit's.
    """
    def one(k: int) -> Column:
        held = F.col("bits").bitwiseAND(F.lit(-(1 << 63) if k == 63 else 1 << k)) != 0
        parts = [F.count_if(held).alias("_rows")]
        for name, value in values.items():
            test = held & (F.col("limit") < value[1][k]) if isinstance(value, tuple) else held
            parts.append(F.coalesce(F.sum(F.when(test, value[0] if isinstance(value, tuple) else value)), F.lit(0.0)).alias(name))
        return F.struct(*parts)

    per = rows.groupBy("word").agg(F.array(*[one(k) for k in range(WIDTH)]).alias("_s"))
    return per.select("word", F.posexplode("_s").alias("bit", "_v")).select("word", "bit", "_v.*").where("_rows > 0").drop("_rows")
