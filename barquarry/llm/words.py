"""Vectorised words of Arrow string columns: boundaries, hashes and n-gram hashes.

Words are runs of bytes other than 0x20 and 0x09-0x0D.  Those bytes never occur
inside a multi-byte UTF-8 character, so boundaries are found on the raw buffer and
no Python object is made per word.  A word's hash is the sum of one random 64-bit value
for each (place in the word, byte), mixed with its length: unlike a polynomial, such a
sum has no family of texts that collide for every choice of the values.  Hashes of n
words join those of their halves by a mixed, ordered sum, again and again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes of text that are worked on at once
_SLAB = 1 << 18  # bytes covered by one running sum
_PLACES = 64  # places in a word that have a table of their own; values of later ones are mixed from place and byte


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(seed: int) -> np.ndarray:
    """A random value for each place below _PLACES and byte."""
    return np.random.default_rng(seed).integers(0, 2**64, _PLACES * 256, dtype=np.uint64)


FIRST, SECOND = 20_240_229, 77_003_141  # seeds of two independent hash functions
_TABLES = {seed: _table(seed) for seed in (FIRST, SECOND)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, seed: int = FIRST) -> np.ndarray:
    """Hashes of the bytes data[start:end] of sorted spans that do not overlap, without their lengths. lower: A-Z count as a-z."""
    out = np.zeros(len(start), np.uint64)
    table = _TABLES[seed]
    i = 0
    while i < len(start):
        a = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, a + _SLAB, "right")))
        if j == i + 1 and int(end[i]) - a > _SLAB:  # one long span, a slab at a time
            for x in range(a, int(end[i]), _SLAB):
                y = min(x + _SLAB, int(end[i]))
                out[i : i + 1] += _values(data[x:y], np.arange(x - a, y - a), table, lower, seed).sum(dtype=np.uint64)
            i = j
            continue
        first, size = start[i:j] - a, int(end[j - 1]) - a
        place = np.arange(size, dtype=np.int32) - np.repeat(first.astype(np.int32), np.diff(np.append(first, size)))
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_values(data[a : a + size], place, table, lower, seed), out=total[1:])
        out[i:j] = total[end[i:j] - a] - total[first]
        i = j
    return out


def _values(part: np.ndarray, place: np.ndarray, table: np.ndarray, lower: bool, seed: int) -> np.ndarray:
    """The random value of each byte at its place."""
    part = _LOWER[part] if lower else part
    at = (place << 8) | part
    far = np.flatnonzero(at >= len(table))
    if not len(far):
        return table[at]
    out = table[np.minimum(at, len(table) - 1)]
    out[far] = mix(at[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return out


def joined(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on, in order; the last n - 1 places have none."""
    size = max(0, len(h) - n + 1)
    now, width, out, done = h, 1, None, 0
    while True:
        if n & width:  # binary digits of n: the parts are taken from the front
            part = now[done : done + size]
            out = part if out is None else mix(out * np.uint64(0xD1342543DE82EF95) + part + np.uint64(done))
            done += width
        if done == n:
            return mix(out + np.uint64(n))
        now = mix(now[:-width] * np.uint64(0xDA942042E4DD58B5) + now[width:]) if len(now) > width else now[:0]
        width *= 2


@dataclass
class Words:
    """Words of some rows. first[r]:first[r + 1] are the words of row r."""

    data: np.ndarray  # the bytes of all rows
    offsets: np.ndarray  # where rows begin in data, one more at the end
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def grams(self, n: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the n words from each word on, whether they are all in one row). h: other hashes of the words."""
        at = np.arange(len(self.hash))
        out = np.zeros(len(at), np.uint64)
        if (m := len(at) - n + 1) > 0:
            out[:m] = joined(self.hash if h is None else h, n)
        return out, at + n <= self.first[self.row + 1]

    def second(self) -> np.ndarray:
        """Hashes of the words by the second function, as independent of the first as two random ones."""
        return mix(spans(self.data, self.start, self.end, seed=SECOND) + (self.end - self.start).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets of rows from 0); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array, lower: bool = False) -> Words:
    """The words of a string column. lower: A-Z count as a-z in the hashes."""
    data, offsets = buffers(column)
    inside = ~_SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True  # a row begins, so no word goes on
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1] | begins[1:-1]
    tail[:-1] &= ~inside[1:] | begins[1:-1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    raw = spans(data, start, end, lower)
    return Words(data, offsets, start, end, row, first, mix(raw + (end - start).astype(np.uint64)))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text and at most `rows` rows; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each row's bytes; null counts as empty."""
    data, offsets = buffers(column)
    whole = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield whole[a:b]
