"""Quality classifier: a byte-level convolutional network written in numpy.

A text's UTF-8 bytes are embedded, convolved with learned filters every ``STRIDE`` bytes,
rectified and max-pooled over overlapping chunks that cover the whole text. A linear layer
over these and the chunk's length gives each chunk a logit; a second, tiny logistic layer combines the mean, largest and
smallest chunk logit and the log of the length into one probability.

It is fitted on whole texts of at most ``PER_CLASS`` labelled rows of each class.

Null and empty texts are scored as one chunk of zero bytes. Rows whose doc_id is null are
scored like any other. Scores are rounded to ``DIGITS`` places, so that equal texts get equal scores
wherever they lie in a batch. Very long texts are scored whole, chunk by chunk. An empty table gives no rows. Extra columns stay
as they are, but for those named like the results, which are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .textkit import slices, text_buffer

WIDTH, STRIDE, DIM, FILTERS = 8, 4, 8, 32
#: Chunk of 512 bytes, started every 480, so neighbours share 32 bytes.
CHUNK, STEP = 512, 480
#: The labelled sample's bound: rows of each class.
PER_CLASS = 1500
#: Places of a score: sums of floats differ in the last ones with the batch.
DIGITS = 5
#: Gradient steps do not depend on the data's size.
ROUNDS, BATCH, RATE = 700, 48, 4e-3
#: Share of the training chunks that are cut short, so that short texts are known too.
CROPPED = 0.25


@dataclass
class QualityModel:
    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    combine: np.ndarray
    constant: float | None = None

    def score_texts(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        if self.constant is not None:
            return np.full(n, self.constant)
        padded, begin, length = _aligned(column)
        pooled, owner = _pooled_all(self, padded, begin, length)
        logits = pooled @ self.out + self.out_bias
        first = np.searchsorted(owner, np.arange(n))
        counts = np.bincount(owner, minlength=n)
        feats = _features(
            np.add.reduceat(logits, first) / counts, np.maximum.reduceat(logits, first), np.minimum.reduceat(logits, first), length
        )
        return np.round(1 / (1 + np.exp(-np.clip(feats @ self.combine, -50, 50))), DIGITS)


def _features(mean, most, least, length) -> np.ndarray:
    return np.stack([np.ones(len(mean)), mean, most, least, np.log1p(length) / 10], 1)


def _size(slots: np.ndarray) -> np.ndarray:
    """What the output layer knows of a chunk's length: few bytes excite few filters."""
    part = np.log(np.asarray(slots, np.float32)) / np.float32(np.log(CHUNK / STRIDE))
    return np.stack([part, part * part], 1)


def _aligned(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with each text starting at a multiple of STRIDE and followed by zero bytes."""
    data, off = text_buffer(column)
    length = np.diff(off)
    room = np.maximum((length + STRIDE - 1) // STRIDE * STRIDE, STRIDE) + WIDTH
    begin = np.cumsum(room) - room
    padded = np.zeros(int(room.sum()) + WIDTH, np.uint8)
    for b, o, n in zip(begin.tolist(), off[:-1].tolist(), length.tolist()):
        padded[b : b + n] = data[o : o + n]
    return padded, begin, length


def _pooled_all(model: QualityModel, padded, begin, length) -> tuple[np.ndarray, np.ndarray]:
    """Max-pooled filter responses of every chunk of every text, and the chunk's text."""
    slots = np.maximum((length + STRIDE - 1) // STRIDE, 1)  # filter positions of each text
    per, step = CHUNK // STRIDE, STEP // STRIDE
    chunks = np.maximum(-(-(slots - per) // step), 0) + 1
    owner = np.repeat(np.arange(len(length)), chunks)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    lo = begin[owner] // STRIDE + k * step
    hi = np.minimum(lo + per, (begin // STRIDE + slots)[owner])
    pooled = np.empty((len(owner), FILTERS + 2), np.float32)
    pooled[:, FILTERS:] = _size(hi - lo)
    block = 256
    for a in range(0, len(owner), block):
        b = min(a + block, len(owner))
        left, right = int(lo[a]), int(hi[b - 1])
        piece = padded[left * STRIDE : (right - 1) * STRIDE + WIDTH]
        emb = model.embed[piece]
        view = np.lib.stride_tricks.sliding_window_view(emb.reshape(-1), WIDTH * DIM)[:: STRIDE * DIM]
        act = np.maximum(view @ model.kernel + model.bias, 0)
        act = np.vstack([act, np.zeros((1, FILTERS), np.float32)])
        pairs = np.stack([lo[a:b] - left, hi[a:b] - left], 1).reshape(-1)
        pooled[a:b, :FILTERS] = np.maximum.reduceat(act, pairs, axis=0)[::2]
    return pooled, owner


def fit(chunks: list[bytes], group: np.ndarray, labels: np.ndarray, lengths: np.ndarray, prior: float, seed: int = 7) -> QualityModel:
    """chunks: pieces of texts; group: the text of each chunk (0..n-1, ascending); labels, lengths: by text."""
    rng = np.random.default_rng(seed)
    flat = lambda v: QualityModel(None, None, None, None, 0.0, None, v)
    if not len(labels):
        return flat(0.5)
    if labels.min() == labels.max():
        return flat(float(labels[0]))
    x = np.zeros((len(chunks), CHUNK + WIDTH), np.uint8)
    for i, c in enumerate(chunks):
        x[i, : len(c)] = np.frombuffer(c, np.uint8)
    used = np.array([max(1, -(-len(c) // STRIDE)) for c in chunks])
    y = labels[group].astype(np.float32)
    P = {
        "embed": rng.normal(0, 0.5, (256, DIM)), "kernel": rng.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)),
        "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, FILTERS + 2), "out_bias": np.zeros(1),
    }
    P = {k: v.astype(np.float32) for k, v in P.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in P.items()} for _ in range(2))
    # a text of each class first, then one of its chunks: long texts do not outweigh the others
    by_class = [np.flatnonzero(labels == c) for c in (0, 1)]
    first, chunks_of = np.searchsorted(group, np.arange(len(labels))), np.bincount(group, minlength=len(labels))
    slots = CHUNK // STRIDE
    at = (np.arange(slots) * STRIDE)[:, None] + np.arange(WIDTH)
    for t in range(1, ROUNDS + 1):
        texts = np.concatenate([rng.choice(c, BATCH // 2) for c in by_class])
        rows = first[texts] + (rng.random(len(texts)) * chunks_of[texts]).astype(np.int64)
        tokens = x[rows][:, at]  # rows, slots, WIDTH
        e = P["embed"][tokens].reshape(len(rows) * slots, WIDTH * DIM)
        z = (e @ P["kernel"] + P["bias"]).reshape(len(rows), slots, FILTERS)
        seen = np.where(rng.random(len(rows)) < CROPPED, np.ceil(used[rows] * rng.random(len(rows)) ** 2), used[rows])
        z[np.arange(slots)[None, :] >= seen[:, None]] = -1e9
        best = z.argmax(1)
        top = np.take_along_axis(z, best[:, None, :], 1)[:, 0]
        pooled = np.concatenate([np.maximum(top, 0), _size(seen)], 1)
        p = 1 / (1 + np.exp(-np.clip(pooled @ P["out"] + P["out_bias"], -30, 30)))
        d = ((p - y[rows]) / len(rows)).astype(np.float32)
        g = {"out": pooled.T @ d, "out_bias": d.sum(keepdims=True)}
        back = (d[:, None] * P["out"][:FILTERS]) * (top > 0)  # rows, FILTERS
        picked = e.reshape(len(rows), slots, -1)[np.arange(len(rows))[:, None], best]  # rows, FILTERS, WIDTH*DIM
        g["kernel"] = np.einsum("rfk,rf->kf", picked, back)
        g["bias"] = back.sum(0)
        to = (back[:, :, None] * P["kernel"].T[None]).reshape(-1, DIM)
        g["embed"] = np.zeros_like(P["embed"])
        np.add.at(g["embed"], np.take_along_axis(tokens, best[:, :, None], 1).reshape(-1), to)
        rate = RATE * (1 - t / (ROUNDS + 1))
        for k in P:
            m1[k] += 0.1 * (g[k] - m1[k])
            m2[k] += 0.01 * (g[k] ** 2 - m2[k])
            P[k] -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-7)
    model = QualityModel(P["embed"], P["kernel"], P["bias"], P["out"], float(P["out_bias"][0]), np.zeros(5))
    padded, begin, length = _aligned(pa.array(chunks, pa.binary()))
    pooled, owner = _pooled_all(model, padded, begin, length)
    logits = (pooled @ model.out + model.out_bias)[np.searchsorted(owner, np.arange(len(chunks)))]
    feats = _features(np.add.reduceat(logits, first) / chunks_of, np.maximum.reduceat(logits, first), np.minimum.reduceat(logits, first), lengths)
    weight = np.where(labels == 1, prior / max(labels.mean(), 1e-9), (1 - prior) / max(1 - labels.mean(), 1e-9))
    w = np.zeros(feats.shape[1])
    for _ in range(40):  # weighted Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(feats @ w, -30, 30)))
        h = (feats * (weight * p * (1 - p) + 1e-6)[:, None]).T @ feats + 1e-2 * np.eye(feats.shape[1])
        w = w - np.linalg.solve(h, feats.T @ (weight * (p - labels)) + 1e-2 * w)
    model.combine = w
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Fits on at most ``per_class`` labelled rows of each class, chosen by a hash of the id.

    These texts come to the driver whole, in chunks, and nothing else of the corpus does. Labels other than 0 and 1 and null ids are ignored; of contradicting labels the lower counts.
    """
    ours = labels.select("doc_id", F.col("quality").alias("y")).where("doc_id is not null and y in (0, 1)")
    ours = ours.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    share = ours.agg(F.avg("y")).first()[0]
    order = F.xxhash64("doc_id", F.lit("quality-sample"))
    picked = ours.where("y = 0").orderBy(order).limit(per_class).unionByName(ours.where("y = 1").orderBy(order).limit(per_class))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, y, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "y", "text"))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                n = max(1, -(-max(len(raw) - CHUNK, 0) // STEP) + 1)
                rows += [(doc, y, len(raw), raw[k * STEP : k * STEP + CHUNK]) for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["doc_id", "y", "n", "chunk"])

    # the sample's size is bounded by its parameter, so it may be broadcast
    texts = documents.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", F.col("y").cast("int").alias("y"))), "doc_id")
    got = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text").mapInArrow(cut, "doc_id long, y int, n long, chunk binary").toArrow().to_pydict()
    order = sorted(range(len(got["chunk"])), key=lambda i: (got["doc_id"][i], got["chunk"][i]))
    _, first, group = np.unique(np.array([got["doc_id"][i] for i in order], np.int64), return_index=True, return_inverse=True)
    y = np.array([got["y"][i] for i in order])[first] if order else np.zeros(0)
    n = np.array([got["n"][i] for i in order])[first] if order else np.zeros(0)
    return fit([got["chunk"][i] for i in order], group, y, n, 0.5 if share is None else float(share))


def score(documents: DataFrame, model: QualityModel, threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``documents`` with the score and whether it reaches the threshold; columns so named are replaced."""
    keep = documents.drop(*names)
    schema = T.StructType([*keep.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = model.score_texts(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*part.schema.names, *names])

    return keep.mapInArrow(run, schema)


def crc_mod5(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5
