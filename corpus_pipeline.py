"""A corpus pipeline of five operators. Each stage reads what the one before it wrote.

Every stage but the last returns the columns of ``documents``; its decisions take effect in
the rows and texts it returns. None of the stages is expressible in SQL as a whole.

Rows are judged by their texts, not by their ids: rows with a null doc_id take part like others, and rows
that repeat a doc_id with different texts do not share a fate. An empty table stays empty. Columns beyond
those of ``documents`` are handed on, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenfield.llm import decontaminate, minhash, packing, quality, secrets
from lumenfield.llm.workspace import Workspace


def _text_hash() -> Column:
    return F.xxhash64("text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored as one chunk of zero bytes, long ones whole. Equal texts, and so
    repeated rows and ties, get equal scores. Without labels of both kinds all rows score alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels), names=("__score", "__good"))
    return scored.where("__good = 1").select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id; null ids come last.

    Of rows that repeat an id and its text one stays. Null and empty texts are near to nothing, so that
    of these only rows that repeat an id go. Rows without an id are told apart by their texts.
    """
    # ids of rows without one lie beyond all others
    stand_in = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2)
    keys = {"__id": F.coalesce(F.col("doc_id").cast("long"), stand_in), "__hash": _text_hash()}
    judged = minhash.near_duplicates(docs.select(keys["__id"].alias("doc_id"), "text"), width=5, threshold=0.8)
    stay = judged.where("first").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("__rows"))
    stay = Workspace(spark, "stay").save(stay, "stay")
    # as many ids as a share of the corpus: one plan for every size, never a broadcast
    kept = lambda which: docs.withColumns(keys).hint("merge").join(stay.where(which), list(keys), "left_semi")
    if stay.where("__rows > 1").isEmpty():
        return kept("__rows = 1").select(docs.columns)
    return kept("__rows = 1").unionByName(kept("__rows > 1").dropDuplicates(list(keys))).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with at most a fifth of its words edited, go.

    Null and empty texts hold none. Texts are judged whole and under their hash, so that rows that repeat
    a text go together. A null or empty item matches nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hashed = docs.select(_text_hash().alias("doc_id"), "text")
    gone = decontaminate.contaminated(hashed, benchmark, similarity=0.8).select(F.col("doc_id").alias("__hash")).distinct()
    return docs.withColumn("__hash", _text_hash()).join(gone, "__hash", "left_anti").select(docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in square brackets; n_chars follows the text where it is not null.

    Null texts stay null and empty ones empty; every row is judged by itself.
    """
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return clean.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents' tokens, with the tokens.

    Null and empty texts are the end id alone; long ones are cut. Repeated rows and null ids are packed like others.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``. What a stage left is freed once the next one has written its own."""
    ws = Workspace(spark, "pipeline")
    mark = len(Workspace.made)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, ws.save(stage(spark, docs, sf_dir), name)
        ws.drop(before)
        Workspace.free_since(mark)
    return docs
