"""Benchmark decontamination by the CGK embedding, bit-sampling LSH and exact edit distance.

Words are runs of letters and digits in lower case; in scripts without spaces every letter is a word.
A text is contaminated by an item of m words if some stretch of it turns into the item with at most
floor((1 - similarity) * m) word edits.

1. The walk of Chakraborty, Goldenberg and Koucky (2016) maps each item, and each window of an item's
   size in a text, to strings whose Hamming distance follows their edit distance: at step j it
   writes the current word and moves on if bit j of that word's random function says so.
2. ``WALKS`` walks with ``SAMPLES`` samples of ``BITS`` places each are the tables of a bit-sampling
   LSH, one set for each size. Windows are looked up there; items of the entries found are candidates.
3. Candidates are confirmed by the exact edit distance.

Windows that hold too little of the whole benchmark to match any item of their size are not walked:
by the q-gram lemma (Ukkonen 1992) e edits leave (m - q + 1) - q * e of an item's q-grams. This skips
no window that could match, and names no item. Equal windows of a text are walked once.

A null or empty text or item matches nothing, as does a row with a null id on either side.
Repeated documents give repeated rows; items that repeat an item_id count as one, by the smallest
distance. Of stretches with equally few edits the first is named. Very long texts are searched whole; an empty table of
documents or items gives no rows. Bytes that are no UTF-8 count as replacement characters. Extra columns are ignored, whatever their names. The
benchmark is worked off in blocks of ``ITEMS`` items, so what is sent to executors is bounded whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import BYTE_TABLES, PUNCTUATION, Words, caseless, mix, rolling, separated, slices
from .workspace import ship

ITEMS = 20_000
WALKS, SAMPLES, BITS = 6, 24, 3
#: Windows walked at once.
WINDOWS = 4096
_GATE = 1 << 22
#: Base of the hash that tells equal windows, and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass
class Size:
    """The tables of the items of one size."""

    m: int
    edits: int
    gram: int
    need: int  # grams that an occurrence keeps
    keys: np.ndarray  # entries of all tables, sorted
    items: np.ndarray  # the item of each entry


@dataclass
class ItemIndex:
    ids: np.ndarray  # item_id of each item
    words: list[np.ndarray]  # word hashes
    sizes: list[Size]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: values, place in sizes, bitmap


def _walk_keys(words: np.ndarray, m: int) -> np.ndarray:
    """LSH keys (rows, WALKS * SAMPLES) of windows (rows, m); keys of different tables differ."""
    rows = np.arange(len(words))
    padded = np.concatenate([words, np.zeros((len(words), 1), np.uint64)], 1)
    rng = np.random.Generator(np.random.PCG64(m))
    out = []
    for walk in range(WALKS):
        steps = rng.integers(0, 1 << 63, 3 * m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        at = np.zeros(len(words), np.int64)
        trace = np.empty((len(words), 3 * m), np.uint64)
        for j in range(3 * m):
            trace[:, j] = padded[rows, at]
            at = np.minimum(at + ((trace[:, j] * steps[j]) >> np.uint64(63)).astype(np.int64), m)
        # most walks are through the window after 2 m steps: later places say little
        places = rng.integers(0, max(1, 2 * m - 2), (SAMPLES, BITS))
        weights = rng.integers(0, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        table = np.arange(walk * SAMPLES, (walk + 1) * SAMPLES, dtype=np.uint64)
        out.append(mix((trace[:, places] * weights).sum(2, dtype=np.uint64) + table))
    return np.concatenate(out, 1)


def index_items(ids: list[int], texts: list[str], similarity: float) -> ItemIndex:
    found = Words(separated(caseless(pa.array(texts, pa.string()))), PUNCTUATION)
    h = found.hashes(BYTE_TABLES[0])
    kept = [(i, h[a:b]) for i, a, b in zip(ids, found.bounds[:-1], found.bounds[1:]) if b > a]
    words = [w for _, w in kept]
    length = np.array([len(w) for w in words], np.int64)
    sizes, held = [], {}
    for m in np.unique(length).tolist():
        own = np.flatnonzero(length == m)
        e = int((1 - similarity) * m + 1e-9)
        g = min(3, max(1, -(-(m - e) // (e + 1))))
        keys = _walk_keys(np.stack([words[i] for i in own]), m)
        order = np.argsort(keys.reshape(-1), kind="stable")
        held.setdefault(g, []).append((np.unique(np.concatenate([rolling(words[i], g) for i in own])), len(sizes)))
        sizes.append(Size(m, e, g, max(1, (m - g + 1) - g * e), keys.reshape(-1)[order], np.repeat(own, keys.shape[1])[order]))
    grams = {}
    for g, parts in held.items():
        values = np.concatenate([v for v, _ in parts])
        place = np.repeat([k for _, k in parts], [len(v) for v, _ in parts])
        order = np.argsort(values, kind="stable")
        gate = np.zeros(_GATE, bool)
        gate[values & np.uint64(_GATE - 1)] = True
        grams[g] = (values[order], place[order], gate)
    return ItemIndex(np.array([i for i, _ in kept], np.int64), words, sizes, grams)


def _starts(size: Size, pos: np.ndarray, bounds: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Starts of the windows of a size that may match: pos are the places of benchmark grams, row their texts."""
    last = np.arange(len(pos)) + size.need - 1
    ok = last < len(pos)
    last = np.minimum(last, len(pos) - 1)
    room = size.m + size.edits - size.gram
    ok &= (row[last] == row) & (pos[last] - pos <= room + size.edits)
    low = np.maximum(bounds[row], pos[last] - room)[ok]
    n = np.maximum(np.minimum(pos + size.edits, bounds[row + 1] - 1)[ok] - low + 1, 0)
    return np.unique(np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n))


def _candidates(index: ItemIndex, h: np.ndarray, bounds: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Size]]:
    """(starts, items, size): windows and the items whose table entries they share."""
    powers = np.full(len(h), _BASE, np.uint64)
    back = np.full(len(h), _INVERSE, np.uint64)
    if len(h):
        powers[0] = back[0] = 1
    before = np.concatenate([[np.uint64(0)], np.cumsum(h * np.multiply.accumulate(powers))])
    back = np.multiply.accumulate(back)
    for g, (values, place, gate) in index.grams.items():
        roll = rolling(h, g)
        pos = np.flatnonzero(gate[roll & np.uint64(_GATE - 1)])
        pos = pos[owner[pos] == owner[pos + g - 1]]
        lo, hi = np.searchsorted(values, roll[pos], "left"), np.searchsorted(values, roll[pos], "right")
        n = hi - lo
        at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        pos, which = np.repeat(pos, n), place[at]
        for k in np.unique(which).tolist():
            size, own = index.sizes[k], pos[which == k]
            start = _starts(size, own, bounds, owner[own])
            if not len(start):
                continue
            end = np.minimum(start + size.m, bounds[owner[start] + 1])
            name = mix((before[end] - before[start]) * back[start] + (end - start).astype(np.uint64)) ^ mix(owner[start].astype(np.uint64))
            start = np.sort(start[np.unique(name, return_index=True)[1]])
            for some in (start[a : a + WINDOWS] for a in range(0, len(start), WINDOWS)):
                places = some[:, None] + np.arange(size.m)
                inside = places < bounds[owner[some] + 1][:, None]
                keys = _walk_keys(np.where(inside, h[np.minimum(places, len(h) - 1)], np.uint64(0)), size.m).reshape(-1)
                a, b = np.searchsorted(size.keys, keys, "left"), np.searchsorted(size.keys, keys, "right")
                met = np.flatnonzero(b > a)
                c = (b - a)[met]
                entry = np.arange(int(c.sum())) + np.repeat(a[met] - (np.cumsum(c) - c), c)
                pairs = np.unique(np.stack([size.items[entry], some[np.repeat(met, c) // (WALKS * SAMPLES)]], 1), axis=0)
                if len(pairs):
                    yield pairs[:, 1], pairs[:, 0], size


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(fewest edits that make some stretch of text the item, end of the first such stretch)."""
    column = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - column) + column
    end = int(row.argmin())
    return int(row[end]), end


def _matches(index: ItemIndex, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item_id, edits, item's words, end word)."""
    found = Words(separated(caseless(column)), PUNCTUATION)
    h, bounds, owner = found.hashes(BYTE_TABLES[0]), found.bounds, found.owner()
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for starts, items, size in _candidates(index, h, bounds, owner):
        rows = owner[starts]
        a = np.maximum(bounds[rows], starts - size.edits)
        b = np.minimum(bounds[rows + 1], starts + size.m + size.edits)
        # windows of one text and item that overlap are judged together
        apart = np.flatnonzero((np.diff(items) != 0) | (np.diff(rows) != 0) | (a[1:] > b[:-1])) + 1
        for i, j in zip([0, *apart.tolist()], [*apart.tolist(), len(items)]):
            low, high, item, row = int(a[i]), int(b[j - 1]), int(items[i]), int(rows[i])
            edits, end = edit_distance_within(index.words[item], h[low:high])
            if edits <= size.edits:
                key, value = (row, int(index.ids[item])), (edits, low + end - int(bounds[row]), size.m)
                if key not in best or value < best[key]:
                    best[key] = value
    for (row, item_id), (edits, end, m) in sorted(best.items()):
        yield row, item_id, edits, m, end


def contaminated(documents: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block: int = ITEMS) -> DataFrame:
    """One row (doc_id, item_id, edits, item_words, end_word) for each document and item it holds."""
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    blocks = max(1, -(-items.count() // block))
    schema = "doc_id long, item_id long, edits int, item_words int, end_word long"
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        shared = ship(spark, index_items([r.item_id for r in rows], [r.text for r in rows], similarity))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared()
            for batch in batches if len(index.ids) else ():
                for part in slices(batch):
                    got = list(_matches(index, part.column("text")))
                    if got:
                        row, item, edits, m, end = (np.array(c) for c in zip(*got))
                        ids = part.column("doc_id").to_numpy()[row]
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(item), pa.array(edits.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(end)], ["doc_id", "item_id", "edits", "item_words", "end_word"])

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
