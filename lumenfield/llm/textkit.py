"""Vectorised word hashing over Arrow string buffers.

All kernels work on whole texts. A slice of rows is cut so that its text stays near
``SLICE_BYTES``; a single longer text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))


def _odd(n: int) -> np.ndarray:
    return _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Two independent byte tables and their position multipliers.
BYTE_TABLES = [_odd(256), _odd(256)]
POSITION_BASES = _odd(2)
#: One multiplier for each place in a window of words.
PLACES = [_odd(64), _odd(64)]

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and bytes of longer characters separates words.
PUNCTUATION = np.array([not (chr(b).isalnum() if b < 128 else True) for b in range(256)])


def lowered(table: np.ndarray) -> np.ndarray:
    out = table.copy()
    out[65:91] = table[97:123]
    return out


def valid(column: pa.Array) -> pa.Array:
    """The texts themselves, or with replacement characters where bytes are no UTF-8."""
    try:
        column.validate(full=True)
        return column
    except pa.ArrowInvalid:
        raw = column.cast(pa.large_binary()).to_pylist()
        return pa.array([None if t is None else t.decode("utf-8", "replace") for t in raw], pa.large_string())


def caseless(column: pa.Array) -> pa.Array:
    """Texts in lower case, whatever the script; bytes that are no UTF-8 become replacement characters."""
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:
        raw = column.cast(pa.large_binary()).to_pylist()
        return pa.array([None if t is None else t.decode("utf-8", "replace").lower() for t in raw], pa.large_string())


#: Letters of scripts that write no spaces, and all that separates words beyond ASCII.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
_SEPARATOR = r"[\p{P}\p{S}\p{Z}\p{C}]+"
_PLAIN = r"^[\x00-\x7f\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]*$"


def separated(column: pa.Array) -> pa.Array:
    """Texts whose words stand apart: spaces for separators in any script, and around letters of scripts without spaces."""
    column = column.cast(pa.large_string())
    plain = pc.fill_null(pc.match_substring_regex(column, _PLAIN), True)
    if pc.all(plain).as_py() is not False:
        return column
    other = pc.replace_substring_regex(pc.filter(column, pc.invert(plain)), _SEPARATOR, " ")
    return pc.replace_with_mask(column, pc.invert(plain), pc.replace_substring_regex(other, _UNSPACED, r" \1 "))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser in the manner of the public-domain splitmix generator."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    base = off[0] if len(off) else 0
    return raw[base : off[-1] if len(off) else 0], off - base


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive runs of rows of about ``limit`` bytes of text."""
    if not batch.num_rows:
        return

    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    which = np.cumsum(lens) // limit
    cuts = np.flatnonzero(np.diff(which)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


class Words:
    """Words of a slice of texts: byte spans and, per text, the range of its words."""

    def __init__(self, column: pa.Array, separators: np.ndarray = WHITESPACE):
        self.data, self.offsets = text_buffer(column)
        n = len(self.data)
        inside = ~separators[self.data]
        before = np.empty(n, bool)
        before[1:] = inside[:-1]
        firsts = self.offsets[:-1]
        firsts = firsts[firsts < n]
        if n:
            before[0] = False
        before[firsts] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[:-1] = inside[1:]
        if n:
            after[-1] = False
        after[firsts[firsts > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.inside = inside
        self.bounds = np.searchsorted(self.starts, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self, table: np.ndarray, which: int = 0) -> np.ndarray:
        """A 64-bit hash for each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        at = np.cumsum(lens) - lens
        powers = np.full(int(lens.max()), POSITION_BASES[which], np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        place = np.arange(int(at[-1] + lens[-1]))
        place -= np.repeat(at, lens)
        value = table[self.data[self.inside]]
        value *= powers[place]
        return mix(np.add.reduceat(value, at))

    def owner(self) -> np.ndarray:
        """For each word the row of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def rolling(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of every ``width`` consecutive words, across texts too: mask those that cross."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * PLACES[which][0]
    for j in range(1, width):
        out += words[j : n + j] * PLACES[which][j]
    return mix(out)


def at_positions(words: np.ndarray, positions: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of the ``width`` words that start at each position."""
    out = np.zeros(len(positions), np.uint64)
    for j in range(width):
        out += words[positions + j] * PLACES[which][j]
    return mix(out)


def string_out(values) -> pa.Array:
    return pa.array(values, pa.string())
