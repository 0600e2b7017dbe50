"""Sources and sinks: feature matrices, responses, graphs, cached neighbours and L^p artifacts."""

from __future__ import annotations

import tempfile
import time
import uuid
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or one of our own where that is unset and driver and tasks share a machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="lumenfield-")
        sc.setCheckpointDir(root)
    return (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def finite(x: Column) -> Column:
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def points(df: DataFrame, key: str, features: str, strict: bool = True) -> DataFrame:
    """(vertex, x): dense features as doubles; a row that is not finite raises when strict, else goes."""
    x = F.col(features).cast("array<double>")
    out = df.select(F.col(key).cast("long").alias("vertex"), x.alias("x"))
    if not strict:
        return out.where(finite(F.col("x")))
    return out.select("vertex", F.when(finite(F.col("x")), F.col("x")).otherwise(F.raise_error(F.lit("X must be finite")).cast("array<double>")).alias("x"))


def points_from_long(df: DataFrame, key: str, feature: str, value: str, size: int) -> DataFrame:
    """(vertex, x) from sparse rows (vertex, feature 0.., value); absent features are zero."""
    cells = df.groupBy(F.col(key).cast("long").alias("vertex")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(feature).cast("int"), F.col(value).cast("double")))).alias("m"))
    return cells.select("vertex", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0.0))).alias("x"))


def graph_problems(directed: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(problem, n): defects of a directed edge table (vertex, nbr, length) that stands for an undirected graph."""
    e = directed
    back = e.select(F.col("vertex").alias("nbr"), F.col("nbr").alias("vertex"), F.col("length").alias("other"))
    bad_weight = F.col("length").isNull() | F.isnan("length") | (F.abs("length") == float("inf")) | (F.col("length") <= 0)
    scale = F.greatest(F.lit(1.0), F.abs("length"), F.abs("other"))
    counts = [
        e.where("vertex = nbr").agg(F.lit("self_loop").alias("problem"), F.count("*").alias("n")),
        e.where(bad_weight).agg(F.lit("bad_weight").alias("problem"), F.count("*").alias("n")),
        e.groupBy("vertex", "nbr").count().where("count > 1").agg(F.lit("duplicate").alias("problem"), F.count("*").alias("n")),
        e.join(back.select("vertex", "nbr"), ["vertex", "nbr"], "left_anti").agg(F.lit("not_reciprocal").alias("problem"), F.count("*").alias("n")),
        e.join(back, ["vertex", "nbr"]).where(F.abs(F.col("length") - F.col("other")) > tolerance * scale).agg(F.lit("unequal_weights").alias("problem"), F.count("*").alias("n")),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def validated_graph(directed: DataFrame) -> DataFrame:
    """Undirected edges (i, j, length), or ValueError naming the defects."""
    found = [f"{r.problem}: {r.n}" for r in graph_problems(directed).collect() if r.n]
    if found:
        raise ValueError("the graph is not usable: " + ", ".join(sorted(found)))
    return directed.where("vertex < nbr").select(F.col("vertex").alias("i"), F.col("nbr").alias("j"), "length")


def fingerprint(df: DataFrame) -> int:
    """A number that tells a table's rows from others', whatever their order."""
    n, a, b = df.select(F.xxhash64(*df.columns).alias("a"), F.xxhash64(F.lit("second"), *df.columns).alias("b")).agg(F.count("*"), F.bit_xor("a"), F.sum(F.col("b") % (1 << 31))).first()
    return hash((n, a or 0, b or 0)) & ((1 << 62) - 1)


def cached(spark: SparkSession, path: str, mode: str, make, of: DataFrame | None = None) -> DataFrame:
    """A table kept as Parquet; mode is none, read, write or readwrite.

    With ``of``, the table that it is made from, a fingerprint lies beside it: a cache of another table is made anew, or, in
    mode read, a ValueError.
    """
    if mode not in ("none", "read", "write", "readwrite"):
        raise ValueError(f"unknown cache mode {mode}")
    mark = fingerprint(of) if of is not None and mode != "none" else None
    if mode in ("read", "readwrite"):
        try:
            if mark is None or [r.mark for r in spark.read.parquet(f"{path}.fingerprint").collect()] == [mark]:
                return spark.read.parquet(path)
            if mode == "read":
                raise ValueError("the cache was made from another table")
        except AnalysisException:  # not written yet
            if mode == "read":
                raise
    out = make()
    if mode in ("write", "readwrite"):
        out.write.mode("overwrite").parquet(path)
        if mark is not None:
            spark.createDataFrame([(mark,)], "mark long").write.mode("overwrite").parquet(f"{path}.fingerprint")
        return spark.read.parquet(path)
    return out


def lp_save(results: DataFrame, path: str) -> None:
    """Results by p, typed: one partition directory for each p; present ones are replaced, others stay."""
    (results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("p").parquet(path))


def lp_load(spark: SparkSession, path: str, p_values: list[float]) -> DataFrame:
    """Only the partitions of the wanted p are read; a warning names those that are not there."""
    missing = lp_missing(spark, path, p_values)
    if missing:
        warnings.warn(f"there are no results for p = {', '.join(map(str, missing))}")
    return spark.read.parquet(path).where(F.col("p").isin(p_values))


def csv_append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def csv_read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def save_object(df: DataFrame, folder: str, name: str) -> str:
    """Keeps a result under a path that tells its time; earlier ones stay. Returns the path."""
    path = f"{folder}/{name}_{time.strftime('%Y%m%d_%H%M%S')}_{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return path


def lp_missing(spark: SparkSession, path: str, p_values: list[float]) -> list[float]:
    """The wanted p that no result has been written for yet; the others can be skipped."""
    try:
        have = {r.p for r in spark.read.parquet(path).select("p").distinct().collect()}
    except AnalysisException:
        return list(p_values)
    return [p for p in p_values if p not in have]
