"""Removal of repeated passages of ``window`` words by difference-cover anchors.

A word goes if a window of 20 words that covers it also starts earlier: in a text with a smaller
doc_id or, in the same text, further ahead. Windows are judged on the input.

1. Anchors: hashes of ``ANCHOR`` words, only where the position modulo ``PERIOD`` lies in the
   difference cover. For any two positions some shift below the period brings both onto the cover,
   so two equal windows of PERIOD - 1 + ANCHOR = 20 words share an aligned anchor.
2. Anchors that occur once anywhere cannot lie in a repeated window; the others are found by an
   exchange of hashes in columnar blocks, one row for each slice of texts and bucket of hashes.
3. Repeated anchors extend: only windows that hold one are hashed whole (96 bits of two independent
   hashes), and a second exchange keeps the first occurrence of each.
4. Every text drops the words that its later occurrences cover.

In a slice of texts each hash counts once before anything is exchanged, so a passage that a third
of all texts share costs one entry for each slice, not one for each text.

Defined results: null and empty texts have no words. Rows with a null doc_id are neither earlier nor
later than others and stay whole. Rows that repeat a doc_id count as one place: equal ones do not
remove each other's words, and what is removed at a position of one is removed in all. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .textkit import BYTE_TABLES, Words, at_positions, slices
from .workspace import Workspace

#: A perfect difference set: every residue modulo 13 is a difference of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
SLICE = 4 << 20
BLOCK_SCHEMA = "bucket int, hashes binary, docs binary, places binary"


def _anchor_words(window: int) -> int:
    if window < PERIOD:
        raise ValueError(f"windows of at least {PERIOD} words are needed")
    return window - PERIOD + 1


def _bucket_bits(spark: SparkSession) -> int:
    """Buckets follow the number of shuffle partitions, so a bucket stays within a task's memory."""
    return int(np.clip(np.ceil(np.log2(2 * int(spark.conf.get("spark.sql.shuffle.partitions")))), 6, 16))


def _cells(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of a fixed-width array as binary cells."""
    raw = np.ascontiguousarray(values)
    width = raw.dtype.itemsize
    off = np.concatenate([[0], np.cumsum(counts)]) * width
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _blocks(top: np.ndarray, hashes: np.ndarray, docs: np.ndarray, places: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row for each bucket, named by the highest bits of ``top``; the rest of a hash stays in the row."""
    bucket = (top >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    names, counts = np.unique(bucket, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(names), *(_cells(c[order], counts) for c in (hashes, docs, places))], ["bucket", "hashes", "docs", "places"]
    )


def _direct(docs: np.ndarray, places: np.ndarray, bits: int) -> pa.RecordBatch:
    """Places that need no exchange travel with an empty cell of hashes."""
    none = np.zeros(0, np.uint32)
    bucket = int(docs[0]) & ((1 << bits) - 1)
    n = np.array([len(docs)])
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), _cells(none, np.array([0])), _cells(docs, n), _cells(places, n)], ["bucket", "hashes", "docs", "places"])


def _anchor_task(window: int, bits: int):
    width = _anchor_words(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                words = Words(part.column("text"))
                h = words.hashes(BYTE_TABLES[0])
                owner = words.owner()
                place = np.arange(len(h)) - words.bounds[owner]
                left = words.counts[owner] - place
                at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (left >= width) & (words.counts[owner] >= window))
                if not len(at):
                    continue
                anchor = at_positions(h, at, width)
                ids = part.column("doc_id").to_numpy()
                order = np.argsort(anchor, kind="stable")
                sorted_ = anchor[order]
                head = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
                again = ~head
                again[:-1] |= ~head[1:]
                if again.any():
                    twice = at[order[again]]
                    yield _direct(ids[owner[twice]], place[twice].astype(np.int32), bits)
                one = np.sort(order[head])
                # the bits below the bucket's suffice: a chance match only costs a look at a window
                low = (anchor[one] >> np.uint64(16)).astype(np.uint32)
                yield _blocks(anchor[one], low, ids[owner[at[one]]], place[at[one]].astype(np.int32), bits)

    return run


def _window_task(window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                words = Words(part.column("text"))
                h, g = words.hashes(BYTE_TABLES[0]), words.hashes(BYTE_TABLES[1], 1)
                # a window starts at most PERIOD - 1 words before an anchor that it holds
                edge = np.zeros(len(h) + 1, np.int32)
                ids = part.column("doc_id").to_numpy()
                flags = part.column("places")
                for row, (b, n) in enumerate(zip(words.bounds[:-1].tolist(), words.counts.tolist())):
                    p = np.asarray(flags[row].values, np.int64)
                    lo, hi = np.maximum(p - (PERIOD - 1), 0), np.minimum(p, n - window)
                    ok = lo <= hi
                    np.add.at(edge, b + lo[ok], 1)
                    np.add.at(edge, b + hi[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                if not len(at):
                    continue
                owner = np.searchsorted(words.bounds, at, "right") - 1
                docs, place = ids[owner], (at - words.bounds[owner]).astype(np.int32)
                key = at_positions(h, at, window)
                extra = (at_positions(g, at, window, 1) >> np.uint64(32)).astype(np.uint32)
                first, later = _first(key, extra, docs, place)
                if len(later):
                    yield _direct(docs[later], place[later], bits)
                pairs = np.empty(len(first), [("key", "<u8"), ("extra", "<u4")])
                pairs["key"], pairs["extra"] = key[first], extra[first]
                yield _blocks(key[first], pairs, docs[first], place[first], bits)

    return run


def _first(key: np.ndarray, extra: np.ndarray, docs: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of each window's first occurrence and of those at a later place."""
    order = np.lexsort((place, docs, extra, key))
    k, e, d, p = key[order], extra[order], docs[order], place[order]
    head = np.concatenate([[True], (k[1:] != k[:-1]) | (e[1:] != e[:-1])])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))
    later = (d != d[lead]) | (p != p[lead])
    return np.sort(order[head]), order[later]


def _by_bucket(judge: Callable[[bytes, np.ndarray, np.ndarray], np.ndarray]):
    """mapInArrow over blocks sorted by bucket: flat (doc_id, place) of direct and judged places."""

    def out(docs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(places)], ["doc_id", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close():
            docs = np.frombuffer(b"".join(r[1] for r in held), np.int64)
            places = np.frombuffer(b"".join(r[2] for r in held), np.int32)
            found = judge(b"".join(r[0] for r in held), docs, places)
            return out(docs[found], places[found])

        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "hashes", "docs", "places"))):
                if bucket != now and held:
                    yield close()
                    held = []
                now = bucket
                if row[0]:
                    held.append(row)
                else:
                    yield out(np.frombuffer(row[1], np.int64), np.frombuffer(row[2], np.int32))
        if held:
            yield close()

    return run


def _repeated(raw: bytes, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    h = np.frombuffer(raw, np.uint32)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return order[twice]


def _later(raw: bytes, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    pairs = np.frombuffer(raw, [("key", "<u8"), ("extra", "<u4")])
    return _first(pairs["key"], pairs["extra"], docs, places)[1]


def _exchange(blocks: DataFrame, judge: Callable) -> DataFrame:
    rows = blocks.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_by_bucket(judge), "doc_id long, place int").groupBy("doc_id").agg(F.collect_list("place").alias("places"))


def remove_repeats(documents: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) for each row."""
    spark = documents.sparkSession
    ws = Workspace(spark, "substring")
    bits = _bucket_bits(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    anchors = known.mapInArrow(_anchor_task(window, bits), BLOCK_SCHEMA)
    flagged = ws.save(_exchange(anchors, _repeated), "anchors")
    ws.release()
    windows = known.join(flagged, "doc_id").mapInArrow(_window_task(window, bits), BLOCK_SCHEMA)
    removed = ws.save(_exchange(windows, _later), "removed")
    ws.release()

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                total, gone, kept = [], [], []
                for text, starts in zip(part.column("text"), part.column("places")):
                    words = (text.as_py() or "").encode("utf-8", "replace").split()  # at ASCII white space
                    n, cut = len(words), 0
                    if starts.is_valid:
                        at = np.asarray(starts.values, np.int64)
                        at = at[at <= n - window]
                        edge = np.zeros(n + 1, np.int32)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + window, -1)
                        stay = np.cumsum(edge[:-1]) == 0
                        cut = n - int(stay.sum())
                        words = [w for w, s in zip(words, stay.tolist()) if s]
                    total.append(n)
                    gone.append(cut)
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return docs.join(removed, "doc_id", "left").mapInArrow(drop, "doc_id long, n_words long, n_removed long, kept_text string")
