"""Packing of tokenised documents into windows of at most ``capacity`` tokens.

A document is its token ids followed by an end id. Documents are packed where they lie, in groups
of consecutive rows of one partition of about ``GROUP`` tokens, so nothing is shuffled and
a task's memory is bounded. In a group:

1. Longer documents are cut at multiples of the capacity; the full pieces fill windows of their own.
2. Multiway differencing after Karmarkar and Karp deals the other pieces to m windows: partial
   partitions are merged, the pair with the largest imbalance first, each one's large sums with
   the other's small ones, until a single, nearly equal partition is left. m starts at the total
   over the capacity and rises by one whenever a window exceeds the capacity, as long as no more than
   ``PADDING`` of the group is padding; after that the few tokens that do not fit move to windows
   with room. The windows stay as differencing made them but for those tokens.
3. In a group of few windows one more would be much padding. There what full windows leave over is
   taken from the largest pieces and cut into sequences of a power of two, which need no padding.

Defined results: null and empty texts are the end id alone. Rows are packed even if they repeat or
have a null doc_id. Bytes that are no UTF-8 count as replacement characters. Of pieces of equal length
the earlier row's is dealt first. Very long texts are tokenised whole. An empty table gives no rows. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .textkit import slices, valid

GROUP = 1 << 20
#: The share of a group that may be padding.
PADDING = 0.01
#: Pieces of words are kept with their ids, about so many at a time.
CACHED_PIECES = 400_000
#: Bytes of text that are tokenised at once.
SLICE = 4 << 20


def karmarkar_karp(sizes: np.ndarray, m: int) -> list[list[int]]:
    """Members of each of m parts of nearly equal sums."""
    if m == 1 or not len(sizes):
        return [list(range(len(sizes))), *([] for _ in range(m - 1))]
    # partitions are kept sparse: sums descending over their non-empty parts, the others hold 0
    heap = [(-int(s), k, np.array([s], np.int64), [[k]]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, sa, pa_ = heapq.heappop(heap)
        _, _, sb, pb = heapq.heappop(heap)
        # b's j-th largest sum belongs at place m - 1 - j of a's sums, the empty ones being last
        fresh = min(len(sb), m - len(sa))
        sums, parts = np.concatenate([sa, sb[:fresh]]), pa_ + pb[:fresh]
        for j in range(fresh, len(sb)):
            sums[m - 1 - j] += sb[j]
            parts[m - 1 - j] = parts[m - 1 - j] + pb[j]
        order = np.argsort(-sums, kind="stable")
        sums, parts = sums[order], [parts[i] for i in order]
        low = int(sums[-1]) if len(sums) == m else 0
        heapq.heappush(heap, (low - int(sums[0]), serial, sums, parts))
        serial += 1
    parts = heap[0][3]
    return parts + [[] for _ in range(m - len(parts))]


def plan(lengths: np.ndarray, capacity: int, padding: float = PADDING) -> list[list[tuple[int, int, int]]]:
    """Windows of a group: lists of (document, start, length)."""
    out, rest = [], []
    for d, n in enumerate(lengths.tolist()):
        full = n // capacity
        out += [[(d, k * capacity, capacity)] for k in range(full)]
        if n % capacity:
            rest.append((d, full * capacity, n % capacity))
    total = sum(r[2] for r in rest)
    m = -(-total // capacity)
    if m * capacity - total > padding * total:
        m = total // capacity
        over = total - m * capacity + int(padding * m * capacity)  # leaves the windows some room
        rest, ends = _taken(rest, min(over, total))
        out += _powers(ends)
        total = sum(r[2] for r in rest)
    if not rest:
        return out
    bundles = _bundled(rest, capacity // 32)
    sizes = np.array([sum(x[2] for x in b) for b in bundles], np.int64)
    while True:
        parts = karmarkar_karp(sizes, m)
        most = max(int(sizes[p].sum()) for p in parts if p)
        if most <= capacity or (m + 1) * capacity - total > padding * total:
            break
        m += 1
    windows = [[x for i in p for x in bundles[i]] for p in parts if p]
    return out + (_fitted(windows, capacity, m) if most > capacity else windows)


def _bundled(pieces: list[tuple[int, int, int]], least: int) -> list[list[tuple[int, int, int]]]:
    """Neighbouring small pieces are dealt as one, so that many tiny documents do not slow the differencing."""
    out, small, size = [], [], 0
    for x in pieces:
        if x[2] >= least:
            out.append([x])
            continue
        if size + x[2] > least:
            out.append(small)
            small, size = [], 0
        small.append(x)
        size += x[2]
    return out + ([small] if small else [])


def _cut(pieces: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """Takes the last ``n`` tokens off a list of pieces."""
    got = []
    while n:
        d, start, length = pieces.pop()
        part = min(n, length)
        got.append((d, start + length - part, part))
        if part < length:
            pieces.append((d, start, length - part))
        n -= part
    return got


def _taken(pieces: list[tuple[int, int, int]], n: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(what is left, n tokens of the largest pieces)."""
    left = sorted(pieces, key=lambda x: x[2])
    got = _cut(left, n)
    return left, got


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Sequences whose lengths are different powers of two."""
    out, left = [], sum(x[2] for x in pieces)
    while left:
        size = 1 << (left.bit_length() - 1)
        out.append(_cut(pieces, size))
        left -= size
    return out


def _fitted(windows: list[list[tuple[int, int, int]]], capacity: int, m: int) -> list[list[tuple[int, int, int]]]:
    """Tokens beyond the capacity move to windows with room; m windows hold everything."""
    windows = windows + [[] for _ in range(m - len(windows))]
    fill = [sum(x[2] for x in w) for w in windows]
    loose = []
    for w, n in zip(windows, fill):
        if n > capacity:
            w.sort(key=lambda x: x[2])  # one cut goes through the largest piece
            loose += _cut(w, n - capacity)
    for w, n in zip(windows, fill):
        if n < capacity and loose:
            w += _cut(loose, min(capacity - n, sum(x[2] for x in loose)))
    return [w for w in windows if w]


#: The tokenizer's own split of lower-cased text, a fixed value; a line feed stands between words here.
PIECES = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words with other characters are left to the tokenizer whole: other scripts, odd white space, special tokens.
ODD = re.compile("[^!-~\u00a1-\u024f\n]|<\\|")


class _Arena:
    """Runs of ids, numbered from 0."""

    def __init__(self):
        self.ids, self.begin, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.n = self.used = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(sizes) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        at = slice(self.n, self.n + len(sizes))
        self.size[at] = sizes
        self.begin[at] = self.used + np.cumsum(sizes) - sizes
        self.n += len(sizes)
        self.used += len(ids)
        return range(self.n - len(sizes), self.n)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these runs in a row, size of each)."""
        size = self.size[at]
        first = np.cumsum(size) - size
        return self.ids[np.arange(int(size.sum())) + np.repeat(self.begin[at] - first, size)], size


class WordTokenizer:
    """Ids of whole texts by way of their words: the tokenizer never looks across white space.

    The distinct words of a slice of texts are split into the tokenizer's own pieces, which many words
    share; only new pieces are encoded, all in one text, where each ends with the token that ends
    a word. Exact for byte-level tokenizers that lower-case, drop white space, split so and mark ends of words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for pieces that are lower-case and split already
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[str, int] = {}
        self.parts = _Arena()
        self.pieces["\n"] = self.parts.add(np.zeros(0, np.uint32), np.array([0]))[0]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.model.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids]) if not len(ids) or ids.max() < len(self.ends) else np.zeros(0, np.int64)
        if len(last) != len(pieces):
            return self._each(pieces)
        return ids, np.diff(last, prepend=-1)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many it has): plain words by their pieces, odd ones by themselves."""
        joined, odd = "\n".join(words), []
        if ODD.search(joined):
            odd = [i for i, w in enumerate(words) if ODD.search(w)]
            plain = list(words)
            for i in odd:
                plain[i] = ""
            joined = "\n".join(plain)
        split = PIECES.findall(joined.lower())
        if self.parts.n > CACHED_PIECES:
            self.clear()
        new = list(set(split) - self.pieces.keys())
        if new:
            self.pieces.update(zip(new, self.parts.add(*self._encoded(new))))
        at = np.fromiter(map(self.pieces.__getitem__, split), np.int64, len(split))
        ids, size = self.parts.gather(at)
        per = np.bincount(np.cumsum(at == 0), weights=size, minlength=len(words)).astype(np.int64)
        begin = np.cumsum(per) - per
        if odd:
            own, sizes = self._each([words[i] for i in odd])
            begin[odd], per[odd] = len(ids) + np.cumsum(sizes) - sizes, sizes
            ids = np.concatenate([ids, own])
        return ids, begin, per

    def encode_batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; where each text begins)."""
        texts = valid(texts).cast(pa.large_string()).fill_null("")
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        ids, begin, per = self._words(words.dictionary.to_pylist())
        at = words.indices.to_numpy(zero_copy_only=False)
        size = per[at]
        total = np.concatenate([[0], np.cumsum(size)])
        body = np.arange(int(total[-1])) + np.repeat(begin[at] - total[:-1], size)
        bounds = np.asarray(lists.offsets)
        cuts = total[bounds - bounds[0]]
        length = np.diff(cuts)
        out = np.full(int(cuts[-1]) + len(length), end, np.uint32)
        out[np.arange(len(body)) + np.repeat(np.arange(len(length)), length)] = ids[body]
        return out, np.concatenate([[0], np.cumsum(length + 1)])

    def encode(self, text: str, end: int) -> np.ndarray:
        return self.encode_batch(pa.array([text], pa.string()), end)[0]


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group: int = GROUP) -> DataFrame:
    """One row for each piece; ``sequence_id`` is unique over the table, ``ids`` are the piece's tokens."""

    def pieces(docs: pa.Array, ids: np.ndarray, offsets: np.ndarray, sequence: int) -> tuple[pa.RecordBatch, int]:
        windows = plan(np.diff(offsets), capacity)
        doc, start, length = (np.array(c, np.int64) for c in zip(*(x for w in windows for x in w)))
        per = np.array([len(w) for w in windows])
        first = np.repeat(np.cumsum(per) - per, per)
        before = np.cumsum(length) - length
        begin = offsets[doc] + start
        texts = [ids[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + length).tolist())]
        columns = [
            docs.take(pa.array(doc)), start, length, [zlib.crc32(t) for t in texts], np.diff(offsets)[doc],
            sequence + np.repeat(np.arange(len(windows)), per), before - before[first],
        ]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(texts, pa.binary())], names), sequence + len(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held, total
            docs = pa.concat_arrays([d for d, _, _ in held])
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, _, o in held]))])
            out, sequence = pieces(docs, np.concatenate([i for _, i, _ in held]), offsets, sequence)
            held, total = [], 0
            return out

        for part in (p for batch in batches for p in slices(batch, limit=SLICE)):
            ids, offsets = tokenizer.encode_batch(part.column("text"), end_id)
            docs, a = part.column("doc_id"), 0
            while a < len(docs):
                # up to the document that completes the group
                b = min(len(docs), int(np.searchsorted(offsets, offsets[a] + group - total)))
                held.append((docs.slice(a, b - a), ids[offsets[a] : offsets[b]].astype("<u4"), offsets[a : b + 1]))
                total += int(offsets[b] - offsets[a])
                a = b
                if total >= group:
                    yield flush()
        if held:
            yield flush()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = ", ".join(f"{n} long" for n in names[:-1]) + ", ids binary"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
