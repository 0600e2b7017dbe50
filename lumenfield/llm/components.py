"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .workspace import Workspace

#: Edges that a task holds at a time.
EDGES_A_TASK = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it reaches) for every node of these edges but the smallest ones."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))  # every larger root hangs from its smallest neighbour
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _contracted(limit: int):
    """mapInArrow over edges (u, v): stars that join the same nodes. A task holds about ``limit`` edges at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            size += batch.num_rows
            if size > limit:
                u, v = forest(*(np.concatenate(c) for c in zip(*held)))
                held, size = [(u, v)], len(u)
                if size > limit // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    held, size = [], 0
        if held:
            u, v = forest(*(np.concatenate(c) for c in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node is either a root or hangs from exactly one root."""
    sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    )
    bad = sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return bad.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("root") > 0))).isEmpty()


def connected_components(ws: Workspace, edges: DataFrame, a: str = "src", b: str = "dst", limit: int = EDGES_A_TASK) -> DataFrame:
    """(node, component) for every node of at least one edge; component is the smallest node.

    Edges that one task can hold, as ``limit`` do whatever the input, are contracted to stars by one. More
    are contracted where they lie, and then the large-star and small-star steps of Kiveris et al. (2014)
    alternate with contraction until all are stars or one task can hold them. Each such round is aggregations
    and joins on node ids only; joins on a hub are split by adaptive execution. Edges with a null end
    and loops count as no edges.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    contract = lambda df: ws.save(df.mapInArrow(_contracted(limit), "u long, v long"), "edges")
    edges = ws.save(edges, "edges")  # so that no task runs the edges' own Python and the contraction at once
    if edges.count() > limit:
        edges = contract(edges)
    while (n := edges.count()) > limit and not _is_star_forest(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        later = contract(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        ws.drop(edges)
        edges = later
    if n <= limit:
        edges = contract(edges.coalesce(1))
    edges = edges.distinct() if n > limit else edges  # one star may lie in several tasks' shares
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
