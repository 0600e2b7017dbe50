"""Vector code compression: product codes learned from weighted distinct parts.

Components become integers, and a vector is cut into ``PARTS`` equal consecutive parts. Equal parts of one position are one
row with a weight; Lloyd's rounds run over these rows, each a pass that hands on sums for each entry, and the driver
holds codebooks only. Finally each distinct part has a code and an error, which are joined back to the vectors. Parts that
more than a thousandth of the vectors share reach these by a broadcast of at most a thousand rows a position, the others by a
shuffle, so no task holds a hot part's vectors.

All arithmetic is exact: squared distances, sums and floors are integers, in 64 bits where they fit and in Python's
integers beyond.

Defined results: rows whose vector is null, empty, of a length that PARTS does not divide, or holds null or non-finite
components, are dropped, and so are vectors of another length than the one that the smallest vec_id's has. Null ids come last
in the order of ids; rows of equal ids are ordered by their parts and stay rows of their own. With fewer than ``ENTRIES``
vectors a codebook has as many entries. Of entries equally near the lower index is taken; equal entries stay apart. An empty
table gives no rows. Errors beyond 64 bits raise an overflow error. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .workspace import Workspace, ship

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Parts shared by more than one in so many vectors are joined by broadcast.
SHARED = 1000
#: Labels up to so many get their sums by broadcast; more by a salted join.
FEW_LABELS, SALTS = 100_000, 16
#: Squared distances of components below this fit into 64 bits for parts of up to 2**20 components.
SMALL = 1 << 20
#: Sums travel as high and low limbs of so many bits.
LIMB = 1 << 60
#: Distances that a task holds at once.
HELD = 1 << 22


@dataclass
class Codes:
    """The codebooks, by position and entry, and (vec_id, label, code, error) of each vector kept."""

    books: list[np.ndarray]
    vectors: DataFrame

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book.tolist() for x in entry).encode()).hexdigest()


def _packed(values: list[int]) -> bytes:
    """A part's integers as bytes, equal for equal parts: two bytes each, or as many as the largest needs."""
    width = max(2, *((v.bit_length() + 8) // 8 for v in values))
    return bytes([width]) + b"".join(v.to_bytes(width, "little", signed=True) for v in values)


def _unpacked(column: pa.Array) -> np.ndarray:
    """(rows, components) of packed parts, in int64 where all are small, else Python's integers."""
    raw = column.to_pylist()
    if not raw:
        return np.zeros((0, 0), np.int64)
    if all(r[0] == 2 for r in raw):
        return np.frombuffer(b"".join(r[1:] for r in raw), "<i2").reshape(len(raw), -1).astype(np.int64)
    rows = [[int.from_bytes(r[k : k + r[0]], "little", signed=True) for k in range(1, len(r), r[0])] for r in raw]
    return _fitting(rows)


def _fitting(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(v) < SMALL for row in rows for v in row)
    return np.array(rows, np.int64 if small else object).reshape(len(rows), -1)


def integer_parts(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, size, parts): packed parts by position for (vec_id, embedding, label); rows that cannot be coded go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(np.asarray(batch.column("embedding").offsets))
            whole = np.asarray(batch.column("embedding").flatten().to_numpy(zero_copy_only=False), np.float64)
            with np.errstate(over="ignore"):
                floor = np.floor(whole * SCALE)
            short = np.abs(floor) < 1 << 15
            begin = np.cumsum(size) - size
            out = []
            for a, n in zip(begin.tolist(), size.tolist()):
                w = n // PARTS
                if short[a : a + n].all():
                    raw = floor[a : a + n].astype("<i2").tobytes()
                    out.append([b"\x02" + raw[k : k + 2 * w] for k in range(0, 2 * n, 2 * w)])
                else:
                    # whole numbers beyond 2**40 are exact before they are scaled
                    ints = [int(np.floor(v * SCALE)) if abs(v) < 1 << 40 else int(v) * SCALE for v in whole[a : a + n].tolist()]
                    out.append([_packed(ints[k : k + w]) for k in range(0, n, w)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("label"), pa.array(size, pa.int32()), pa.array(out, pa.list_(pa.binary()))], ["row", "vec_id", "label", "size", "parts"])

    x = F.col("embedding").cast("array<double>")
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select("vec_id", x.alias("embedding"), "label").where((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0)).where(sound)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding")
    return rows.mapInArrow(run, f"row long, vec_id {types['vec_id']}, label {types['label']}, size int, parts array<binary>")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) for each row; ties go to the lower entry."""
    if x.dtype == object or book.dtype == object:
        d = [[sum((a - b) ** 2 for a, b in zip(row, entry)) for entry in book.tolist()] for row in x.tolist()]
        at = np.array([min(range(len(r)), key=r.__getitem__) for r in d], np.int64)
        return at, np.array([r[k] for r, k in zip(d, at)], object)
    at, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    step = max(1, HELD // max(1, book.size))
    for a in range(0, len(x), step):
        d = ((x[a : a + step, None, :] - book[None]) ** 2).sum(2)
        at[a : a + step] = d.argmin(1)
        best[a : a + step] = d.min(1)
    return at, best


def _by_position(batch: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(position, rows, values, entries, squared distances) of the batch."""
    position = batch.column("position").to_numpy()
    for p in np.unique(position).tolist():
        rows = np.flatnonzero(position == p)
        x = _unpacked(batch.column("part").take(pa.array(rows)))
        yield p, rows, x, *nearest(x, books[p])


def lloyd_round(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Entries replaced by the floors of their parts' weighted means; unused ones stay."""
    sent = ship(distinct.sparkSession, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            weight = batch.column("n").to_numpy()
            for p, rows, x, entry, _ in _by_position(batch, sent()):
                for e in np.unique(entry).tolist():
                    of = entry == e
                    w = weight[rows[of]].astype(object)
                    exact = x.dtype == object or int(w.sum()) >= 1 << 40
                    sums = (x[of].astype(object) * w[:, None]).sum(0) if exact else weight[rows[of]] @ x[of]
                    held = total.setdefault((p, e), [0] * (x.shape[1] + 1))
                    for k, v in enumerate([int(w.sum()), *(int(s) for s in sums)]):
                        held[k] += v
        flat = [(p, e, k, Decimal(v // LIMB), Decimal(v % LIMB)) for (p, e), sums in total.items() for k, v in enumerate(sums)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(28, 0), pa.decimal128(28, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat) if flat else [[]] * 5, kinds)], ["p", "e", "k", "high", "low"])

    sums = distinct.mapInArrow(run, "p int, e int, k int, high decimal(28,0), low decimal(28,0)").groupBy("p", "e", "k").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    got = {(r.p, r.e, r.k): int(r.high) * LIMB + int(r.low) for r in sums.collect()}  # entries and components of the codebooks
    out = []
    for p, book in enumerate(books):
        rows = [[got[p, e, k + 1] // got[p, e, 0] for k in range(book.shape[1])] if (p, e, 0) in got else entry for e, entry in enumerate(book.tolist())]
        out.append(_fitting(rows))
    return out


def _first_books(rows: DataFrame) -> tuple[list[np.ndarray], int]:
    """Codebooks of the smallest ids' parts, and the length of a vector."""
    order = [F.asc_nulls_last("vec_id"), "parts"]
    head = rows.orderBy(*order).limit(1).select("size").collect()
    if not head:
        return [], 0
    first = rows.where(F.col("size") == head[0][0]).orderBy(*order).limit(ENTRIES).select("parts").collect()
    return [_fitting(_unpacked(pa.array([bytes(r.parts[p]) for r in first], pa.binary())).tolist()) for p in range(PARTS)], head[0][0]


def compress(vectors: DataFrame) -> Codes:
    """Codes of all vectors (vec_id, embedding, label)."""
    ws = Workspace(vectors.sparkSession, "codes")
    rows = ws.save(integer_parts(vectors), "rows")
    books, size = _first_books(rows)
    rows = rows.where(F.col("size") == size)
    flat = rows.select("row", F.posexplode("parts").alias("position", "part"))
    distinct = ws.save(flat.groupBy("position", "part").agg(F.count("*").alias("n")), "distinct")
    for _ in range(ROUNDS if books else 0):
        books = lloyd_round(distinct, books)
    sent = ship(vectors.sparkSession, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
            for _, at, _, entry, far in _by_position(batch, sent()):
                code[at], error[at] = entry, far
            yield pa.RecordBatch.from_arrays([batch.column("position"), batch.column("part"), batch.column("n"), pa.array(code), pa.array(error.tolist(), pa.int64())], ["position", "part", "n", "entry", "far"])

    coded = ws.save(distinct.mapInArrow(run, "position int, part binary, n long, entry int, far long"), "coded")
    least = rows.count() // SHARED + 1
    hot = coded.where(F.col("n") > least).drop("n")  # at most SHARED rows a position, for n > rows / SHARED
    by_row = lambda df: df.groupBy("row").agg(F.collect_list(F.struct("position", "entry", "far")).alias("c"))
    marked = flat.join(F.broadcast(hot), ["position", "part"], "left")
    ready = marked.where("entry is not null").select("row", "position", "entry", "far")
    rest = marked.where("entry is null").select("row", "position", "part").join(coded.where(F.col("n") <= least).drop("n"), ["position", "part"]).select("row", "position", "entry", "far")
    found = by_row(ready.unionByName(rest))
    digits = F.array_join(F.transform(F.array_sort("c"), lambda c: F.lpad(F.lower(F.hex(c.entry)), 2, "0")), "")
    error = F.aggregate("c", F.lit(0).cast("long"), lambda s, c: s + c.far)
    out = rows.select("row", "vec_id", "label").join(found.select("row", digits.alias("code"), error.alias("error")), "row").drop("row")
    return Codes(books, ws.save(out, "codes"))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error: the errors summed over rows of equal label, nulls together."""
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0).cast(codes.schema["label"].dataType)).alias("value"))
    rows = codes.withColumn("_key", key)
    sums = rows.groupBy("_key").agg(F.sum("error").alias("label_error"))
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        return rows.join(F.broadcast(sums), "_key").drop("_key")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("code", "vec_id"), F.lit(SALTS)).cast("int"))
    return salted.join(sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_key", "_salt"]).drop("_key", "_salt")
