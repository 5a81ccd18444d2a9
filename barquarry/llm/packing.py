"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous supersteps.

1. Tokenise.  A document becomes its ids and an end id, and is cut every `length` ids.
   Words are looked up by hash in a bounded table that a Python worker keeps, and compared
   with the table's text; only words it lacks go through the tokenizer.  Where two words
   should share a hash, the piece of text at hand is tokenised without the table.  Words
   are cut at signs and looked up without their case only for a tokenizer that is found to
   treat them so (see `WordIds`); for any other, whole texts go through it.
2. Range-sort the pieces by length (descending), id and piece.  The sorted table is
   written; a piece's rank among pieces of its length is its place in its partition plus
   the counts of that length in earlier partitions.  As partitions are ranges, there are
   at most `length` + partitions such counts.
3. Supersteps, longest pieces first.  The open sequences are kept as runs of equal gaps.
   The sweep looks up the successor of the length among the sorted gaps (the tightest
   fit); the pieces that compete for a run of gaps are told apart by rank, the gaps are
   updated, and the step repeats until the length's pieces are placed.  A run takes as
   many pieces as it has room for at once, which gives the same packing as best-fit
   decreasing piece by piece.  The state is bounded by the sequence length, not by the
   documents: a few rows for each length between 1 and 4096.
4. Every piece finds its sequence and offset from its length and rank: a lookup in that
   bounded plan, done where the pieces are.

Defined results: null or empty text is the end id alone; rows that repeat an id are
packed each for itself; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquarry.llm import storage
from barquarry.llm.storage import Scratch
from barquarry.llm.words import _LOWER, _SPACE, buffers, mix, pieces, spans

LENGTH, END_ID = 4096, 1
CACHE = 500_000  # words that a worker remembers
_TOKENIZERS: dict[str, WordIds] = {}

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
# ASCII signs that may stand apart from a neighbouring ASCII letter or digit: not the
# apostrophe (contractions) and not the signs of special tokens
_SIGN = np.zeros(256, bool)
_SIGN[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "'<|>"]] = True


class Known:
    """Ids of strings, remembered by 64-bit hash with the strings themselves; forgotten when they are too many."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes and their rows below
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # ids in flat
        self.flat = np.zeros(0, np.int32)
        self.text, self.text_at, self.text_n = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, surfaces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each string)."""
        raise NotImplementedError

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, self.at[i], -1)

    def learn(self, keys: np.ndarray, surfaces: list[str], shown: list[bytes]) -> None:
        ids, count = self.encode(surfaces)
        size = np.array([len(x) for x in shown], np.int64)
        row = len(self.begin) + np.arange(len(keys))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, ids])
        self.text_at = np.concatenate([self.text_at, len(self.text) + np.cumsum(size) - size])
        self.text_n = np.concatenate([self.text_n, size])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(shown), np.uint8)])
        every, at = np.concatenate([self.keys, keys]), np.concatenate([self.at, row])
        order = np.argsort(every, kind="stable")
        self.keys, self.at = every[order], at[order]

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray, shown: np.ndarray, surface) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the strings data[start:end] one after the other, where each one's begin, one more at the end).

        shown: the bytes by which strings are told apart, at the places of data; surface(i): what is encoded for string i.
        """
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        row = self.find(keys)
        if (new := np.flatnonzero(row < 0)).size:
            if len(self.keys) + len(new) > CACHE:
                self.clear()
                new = np.arange(len(keys))
            whole = shown.tobytes()
            i = first[new].tolist()
            self.learn(keys[new], [surface(x) for x in i], [whole[start[x] : end[x]] for x in i])
            row = self.find(keys)
        row = row[inverse]
        if not self._same(row, start, end, shown):
            ids, count = self.encode([surface(x) for x in range(len(start))])
            return ids, np.concatenate([[0], np.cumsum(count)])
        n = self.count[row]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(self.begin[row] - total[:-1], n) + np.arange(total[-1])], total

    def _same(self, row: np.ndarray, start: np.ndarray, end: np.ndarray, shown: np.ndarray) -> bool:
        """Whether the strings are those that the table has in these rows."""
        n = end - start
        if np.any(self.text_n[row] != n):
            return False
        for a in range(0, len(row), 1 << 15):
            m = n[a : a + (1 << 15)]
            begin = np.cumsum(m) - m
            inner = np.arange(int(m.sum())) - np.repeat(begin, m)
            if np.any(shown[np.repeat(start[a : a + (1 << 15)], m) + inner] != self.text[np.repeat(self.text_at[row[a : a + (1 << 15)]], m) + inner]):
                return False
        return True


class WordIds(Known):
    """Token ids of words.

    apart: the tokenizer's ids of a text are those of its words, cut at signs and taken without their case, one after
    the other.  That is so if its normaliser drops case and its pre-tokeniser cuts at white space and around signs;
    it is tried on a text of all ASCII characters in pairs before it is relied on.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        super().__init__()
        self.apart = self._apart()

    def _apart(self) -> bool:
        signs = [chr(i) for i in range(33, 127)]
        tries = ["".join(f"a{x}B{x}{y} {x} c{y}D" for y in signs) for x in signs] + ["Two  Words\t and\r\nLines \x0b\x0c here ", "Ünïted ÉTÉ straße 123abc Abc's don't 12.5 a_b", ""]
        for text in tries:
            data = np.frombuffer(text.encode(), np.uint8)
            start, end = _parts(data, np.array([0, len(data)]))
            whole = data.tobytes()
            own = [whole[a:b].decode().lower() if whole[a:b].isascii() and b"<" not in whole[a:b] else whole[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
            if self.encode(own)[0].tolist() != self.tokenizer.encode(text, add_special_tokens=False).ids:
                return False
        return True

    def encode(self, surfaces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(surfaces), 20_000):
            part = surfaces[at : at + 20_000]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(got.ids, np.int32))
            counts.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(counts)


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the parts that are tokenised apart: words, cut between an ASCII sign and an ASCII letter or digit."""
    inside = ~_SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    cut = begins[1:-1].copy()
    if len(data):
        a, b = data[:-1], data[1:]
        cut |= (_SIGN[a] & _ALNUM[b]) | (_ALNUM[a] & _SIGN[b])
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1] | cut
    tail[:-1] &= ~inside[1:] | cut
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def token_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, where each row's begin, one more at the end)."""
    known = _TOKENIZERS.setdefault(path, None) or WordIds(path)
    _TOKENIZERS[path] = known
    data, offsets = buffers(column)
    if not known.apart:
        whole = data.tobytes()
        found = [known.tokenizer.encode(whole[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.array([x for ids in found for x in ids], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
    start, end = _parts(data, offsets)
    # plain ASCII words are looked up without their case, as the normaliser drops it
    odd = np.concatenate([[0], np.cumsum((data >= 128) | (data == ord("<")), dtype=np.int32)])
    plain = odd[end] == odd[start]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start[plain]] = 1
    edge[end[plain]] -= 1
    shown = np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, _LOWER[data], data)
    keys = mix(spans(shown, start, end) + (end - start).astype(np.uint64))
    whole = data.tobytes()
    flat, at = known.look_up(data, start, end, keys, shown, lambda i: whole[start[i] : end[i]].decode("utf-8", "replace"))
    return flat, at[np.searchsorted(start, offsets)]


def cut_pieces(path: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False):
    """mapInArrow function: (doc_id, text) to doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            flat, begin = token_ids(batch.column("text"), path)
            rows, ids = [], []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), begin[:-1].tolist(), begin[1:].tolist()):
                own = np.empty(b - a + 1, "<u4")
                own[:-1], own[-1] = flat[a:b], end_id
                for k, at in enumerate(range(0, len(own), length)):
                    part = own[at : at + length]
                    rows.append((doc, k, at, len(part), zlib.crc32(part)))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return run


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over runs of equal lengths and equal gaps.

    Rows (piece length, first rank, pieces per sequence, first sequence, offset): the
    piece of that length and rank r goes to first sequence + (r - first rank) // per
    sequence, behind (r - first rank) % per sequence others of its run.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, sequences)
    sizes: list[int] = []  # the gaps there are, sorted
    rows, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(sizes, size)
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap = length
                first, n = opened, -(-left // (length // size))
                opened += n
            each = gap // size
            full = min(n, left // each)
            if full:
                rows.append((size, rank, each, first, length - gap))
                rank, left = rank + full * each, left - full * each
                put(gap - each * size, first, full)
            first, n = first + full, n - full
            if n and left:  # fewer are left than fit into one sequence
                rows.append((size, rank, left, first, length - gap))
                put(gap - left * size, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(gap, first, n)
    return rows


def _placed(offsets: dict[tuple[int, int], int], rows: list[tuple]):
    """mapInArrow function: adds sequence_id and offset. offsets: (partition, length) to rank less place in the partition."""
    where = {k: i for i, k in enumerate(offsets)}
    shift = np.array([*offsets.values(), 0], np.int64)
    sizes, ranks, each, first, begin = (np.array(c, np.int64) for c in zip(*sorted(rows)))
    bits = np.int64(1) << 45
    keys = sizes * bits + ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            place, size = b.column("place").to_numpy(), b.column("length").to_numpy()
            part, at = place >> 33, place & ((1 << 33) - 1)
            both, back = np.unique(part * (1 << 20) + size, return_inverse=True)
            rank = at + shift[[where[(int(x) >> 20, int(x) & 0xFFFFF)] for x in both]][back]
            i = np.searchsorted(keys, size * bits + rank, "right") - 1
            d = rank - ranks[i]
            out = [b.column(c) for c in b.schema.names if c != "place"]
            out += [pa.array(first[i] + d // each[i]), pa.array(begin[i] + d % each[i] * size)]
            yield pa.RecordBatch.from_arrays(out, [c for c in b.schema.names if c != "place"] + ["sequence_id", "offset"])

    return run


def best_fit(cut: DataFrame, length: int = LENGTH, scratch: Scratch | None = None) -> DataFrame:
    """Pieces (doc_id, piece, length of at most `length` < 2**20, ...) with their sequence_id and offset."""
    spark = cut.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece")]
    ranged = cut.repartitionByRange(storage.partitions(spark), *order).sortWithinPartitions(*order)
    ranged = scratch.write(ranged.withColumn("place", F.monotonically_increasing_id()))
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    found = ranged.groupBy(part.alias("part"), "length").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).collect()
    schema = ",".join(f"`{x.name}` {x.dataType.simpleString()}" for x in cut.schema) + ", sequence_id long, offset long"
    if not found:
        return spark.createDataFrame([], schema)
    scratch.only(ranged)
    totals: dict[int, int] = {}
    offsets = {}
    for r in sorted(found, key=lambda r: r["part"]):
        offsets[(r["part"], r["length"])] = totals.get(r["length"], 0) - r["first"]
        totals[r["length"]] = totals.get(r["length"], 0) + r["n"]
    return ranged.mapInArrow(_placed(offsets, plan(totals, length)), schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (if with_ids), sequence_id, offset."""
    spark = docs.sparkSession
    storage.small_batches(spark)
    scratch = Scratch(spark, "packing")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return best_fit(scratch.write(texts.mapInArrow(cut_pieces(tokenizer, length, end_id, with_ids), schema)), length, scratch)
