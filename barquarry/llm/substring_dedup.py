"""Substring dedup: a log-structured index of window fingerprints.

A window is `window` consecutive words.  It is a repeat if the same word sequence
starts earlier: in a document with a smaller id, or earlier in the same document.

*Fingerprint.*  A window is identified by its anchor (64 bits: the least mixed hash among
the 8-grams inside it) and a second hash of its own 20 words (64 bits, stored whole).  The
two derive from independent functions of the words' bytes.  Windows that follow each other
mostly share their anchor, so a run stores the anchor once per segment and 8 bytes per
window.  An anchor match alone is never a repeat: each is verified by the second hash over
the whole word sequence; the words themselves do not travel and are not compared.  A
frequent 8-gram is the anchor of many different windows, and only the second hash tells
those apart: with n windows under one anchor n * n / 2**65 false pairs are to be expected:
1e-8 for 650,000 windows (a line in 50,000 documents, 13 windows each), one at 6e9 windows
under a single anchor.

*Runs.*  Every piece of text (about 4 MB) is cut into sorted immutable runs, one per
shard of the anchor space.  Within the piece only the first copy of a window goes into
the run; later ones are settled on the spot.  Hence a passage that a third of all rows
hold arrives once per piece, and shards stay even.

*Merge.*  Per shard, new runs are joined with the historical ones by one ordered pass over
(anchor, window hash, document, start); the earliest owner of each fingerprint stands, all
others are repeats.  A shard is worked on in one worker, a range of its anchors at a time, so
that only one range is spread out in memory; there are as many shards as shuffle
partitions, or as many as hold about 64 MB of runs each if that is more.

*Index.*  `FingerprintIndex.ingest` writes the new runs beside the old; after `fanout`
batches all runs are compacted into one that holds each fingerprint's earliest owner only,
and the replaced ones are deleted.  A manifest, replaced by renaming, names the runs that
count: an index is reopened from its folder, and what a lost driver left unnamed is ignored.

*Answer.*  Repeats go back as ranges of window starts by document key, next to the
documents themselves, and the words that they cover are removed.

Defined results: null text has no words; fewer words than a window: nothing removed; a
null id counts as the largest; rows that repeat an id start at the same place, so that
neither is earlier and both stay; other columns are carried along unchanged.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquarry.llm import storage
from barquarry.llm.words import mix, pieces, words

WINDOW = 20
ANCHOR = 8  # words of an anchor; at most the window
NULL_ID = np.iinfo(np.int64).max
RUN = "kind int, place int, level int, docs binary, seg binary, win binary"
_SEG = np.dtype([("anchor", "<u8"), ("start", "<u4"), ("row", "<u2"), ("n", "u1")])
_DOC = np.dtype([("id", "<i8"), ("key", "<u8")])
_HIT = np.dtype([("key", "<u8"), ("start", "<u4"), ("n", "<u4")])
_RUN, _ANSWER = 0, 1


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Least of h[i:i + n] for every i at which that lies inside h."""
    width = 1
    while width * 2 <= n:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (n - width)], h[n - width :]) if n > width else h


def _ranges(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (row, start) pairs as (row, first start, length) of unbroken ranges."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return row[at], start[at], np.diff(np.append(at, len(row)))


def _hits(keys: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.empty(len(keys), _HIT)
    out["key"], out["start"], out["n"] = keys, start, n
    return out


def _answers(hits: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Hits as one row per bucket of document keys."""
    place = (hits["key"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    hits, place = hits[order], place[order]
    cut = np.flatnonzero(np.diff(place, prepend=-1)) if len(place) else []
    for a, b in itertools.pairwise([*cut, len(place)]):
        yield _ANSWER, int(place[a]), 0, None, hits[a:b].tobytes(), None


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["kind", "place", "level", "docs", "seg", "win"])


def cut_runs(shards: int, window: int = WINDOW, size: int = 1 << 22):
    """mapInArrow function: (doc_id, key, text) to runs by shard, and answers that need no merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", size, 65_535):
            if out := _cut(piece, shards, window):
                yield _table(out)

    return run


def _cut(piece: pa.RecordBatch, shards: int, window: int) -> list[tuple]:
    """One piece's runs and answers. Arrays go as soon as they are read: they hold 8 bytes a word each, about as much as the text."""
    ids = piece.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    doc = np.empty(len(ids), _DOC)
    doc["id"], doc["key"] = ids[order], piece.column("key").to_numpy(zero_copy_only=False).view(np.uint64)[order]
    w = words(piece.column("text").take(pa.array(order)))
    k = min(ANCHOR, window)
    at = np.flatnonzero(np.arange(len(w.hash)) + window <= w.first[w.row + 1]) if len(w.hash) else np.zeros(0, np.int64)
    if not len(at):
        return []
    gram = w.grams(k)[0]
    anchor = _least(gram[: len(gram) - k + 1], window - k + 1)[at]
    del gram
    own = w.grams(window, w.second())[0][at]
    row = w.row[at]
    start = at - w.first[row]
    del w, at
    # only the first copy here goes on; rows that repeat an id are each other's equals
    both = mix(anchor + own)
    by = np.argsort(both, kind="stable")
    both = both[by]
    same = np.zeros(len(by), bool)
    same[1:] = both[1:] == both[:-1]
    del both
    at = np.flatnonzero(same)
    same[at] = (anchor[by[at]] == anchor[by[at - 1]]) & (own[by[at]] == own[by[at - 1]])
    lead = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
    later = same & ((doc["id"][row[by]] > doc["id"][row[lead]]) | (start[by] > start[lead]))
    gone = np.sort(by[later])
    del by, same, lead, later, at
    out: list[tuple] = []
    if len(gone):
        r, s, n = _ranges(row[gone], start[gone])
        out += _answers(_hits(doc["key"][r], s, n), shards)
        left = np.ones(len(row), bool)
        left[gone] = False
        anchor, row, start, own = anchor[left], row[left], start[left], own[left]
        del left
    del gone
    new = np.ones(len(row), bool)  # a segment: unbroken windows of one row under one anchor
    new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    cut = np.flatnonzero(new)
    new |= (np.arange(len(row)) - np.repeat(cut, np.diff(np.append(cut, len(row))))) % 255 == 0
    cut = np.flatnonzero(new)
    seg = np.empty(len(cut), _SEG)
    seg["anchor"], seg["start"], seg["row"], seg["n"] = anchor[cut], start[cut], row[cut], np.diff(np.append(cut, len(row)))
    del anchor, row, start, new, cut
    return out + _by_shard(doc, seg, own, shards, 0)


def _flat(seg: np.ndarray) -> np.ndarray:
    """Place of each window in its segment, for windows stored segment by segment."""
    n = seg["n"].astype(np.int64)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _by_shard(doc: np.ndarray, seg: np.ndarray, win: np.ndarray, shards: int, level: int) -> list[tuple]:
    """One sorted run per shard. Rows are numbered anew in each, so that a run lists its own documents only."""
    place = (seg["anchor"] % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((seg["start"], seg["row"], seg["anchor"], place))
    n = seg["n"].astype(np.int64)
    begin = np.cumsum(n) - n
    seg, place = seg[order], place[order]
    m = n[order]
    win = win[np.repeat(begin[order] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
    ends = np.cumsum(m)
    out = []
    cut = np.flatnonzero(np.diff(place, prepend=-1)) if len(place) else []
    for a, b in itertools.pairwise([*cut, len(place)]):
        part = seg[a:b].copy()
        have, part["row"] = np.unique(part["row"], return_inverse=True)
        out.append((_RUN, int(place[a]), level, doc[have].tobytes(), part.tobytes(), win[ends[a] - m[a] : ends[b - 1]].tobytes()))
    return out


def _column(table: pa.Table, name: str, runs: np.ndarray, kind: np.dtype | type) -> tuple[np.ndarray, np.ndarray]:
    """(records of all runs one after the other, how many each run has)."""
    parts = [np.frombuffer(x.as_buffer(), np.uint8) for x, own in zip(table.column(name), runs.tolist()) if own]
    sizes = np.array([len(x) for x in parts], np.int64) // np.dtype(kind).itemsize
    return np.concatenate(parts or [np.zeros(0, np.uint8)]).view(kind), sizes


def _joined(hits: np.ndarray) -> np.ndarray:
    """Hits that go on where another one ends as one."""
    hits = hits[np.lexsort((hits["start"], hits["key"]))]
    new = np.ones(len(hits), bool)
    new[1:] = (hits["key"][1:] != hits["key"][:-1]) | (hits["start"][1:] != hits["start"][:-1] + hits["n"][:-1])
    at = np.flatnonzero(new)
    return _hits(hits["key"][at], hits["start"][at], np.add.reduceat(hits["n"], at)) if len(at) else hits


def merge_shard(shards: int, compact: bool, size: int = 1 << 18):
    """applyInArrow function over one shard: merge-join new runs (level 0) with each other and with the
    historical ones, and answer for the new. compact: also the runs of earliest owners that replace them all.

    The shard's anchors are taken in order, in ranges of about `size` windows: beside the shard as it is
    stored and 29 bytes a segment, a worker holds the columns of one range. An anchor is never divided.
    """

    def merge(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        out = [(_ANSWER, p, 0, None, s.as_py(), None) for kind, p, s in zip(kinds.tolist(), table.column("place").to_pylist(), table.column("seg")) if kind == _ANSWER]
        own = kinds == _RUN
        doc, docs = _column(table, "docs", own, _DOC)
        seg, segs = _column(table, "seg", own, _SEG)
        win, _ = _column(table, "win", own, np.uint64)
        base = np.repeat((np.cumsum(docs) - docs).astype(np.uint32), segs)  # a run's rows count from its own first document
        new = np.repeat(table.column("level").to_numpy()[own] == 0, segs)
        n = seg["n"]
        begin = np.cumsum(n, dtype=np.int64) - n
        order = np.argsort(seg["anchor"], kind="stable")
        anchors = seg["anchor"][order]
        ends = np.cumsum(n[order], dtype=np.int64)
        found = [np.zeros(0, _HIT)]
        a = 0
        while a < len(order):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
            b = int(np.searchsorted(anchors, anchors[b - 1], "right"))
            pick, m = order[a:b], n[order[a:b]].astype(np.int64)
            flat = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            row = np.repeat(base[pick] + seg["row"][pick], m)
            part = (
                np.repeat(anchors[a:b], m),
                win[np.repeat(begin[pick], m) + flat],
                doc["id"][row],
                doc["key"][row],
                np.repeat(seg["start"][pick], m) + flat.astype(np.uint32),
                np.repeat(new[pick], m),
            )
            hits, runs = _merged(*part, compact, int(table.column("place")[0].as_py()))
            found.append(hits)
            out += runs
            a = b
        out += _answers(_joined(np.concatenate(found)), shards)
        return pa.Table.from_batches([_table(out)])

    return merge


def _merged(anchor, win, ident, key, start, fresh, compact: bool, place: int) -> tuple[np.ndarray, list[tuple]]:
    """(hits among all windows of some anchors, with compact the runs of their earliest owners)."""
    order = np.lexsort((start, ident, win, anchor))
    anchor, win, ident, key, start, fresh = (x[order] for x in (anchor, win, ident, key, start, fresh))
    head = np.ones(len(anchor), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (win[1:] != win[:-1])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    gone = np.flatnonzero(((ident > ident[lead]) | (start > start[lead])) & fresh)
    by = gone[np.lexsort((start[gone], key[gone]))]
    hits = _hits(*_ranges(key[by], start[by])) if len(by) else np.zeros(0, _HIT)
    return hits, _compacted(anchor[head], win[head], ident[head], key[head], start[head], place) if compact else []


def _compacted(anchor, win, ident, key, start, place) -> list[tuple]:
    """One run of earliest owners, in parts of at most 65,536 documents."""
    out = []
    both = np.empty(len(key), _DOC)
    both["id"], both["key"] = ident, key
    doc, row = np.unique(both, return_inverse=True)
    for part in range(0, len(doc), 1 << 16):
        pick = np.flatnonzero((row >= part) & (row < part + (1 << 16)))
        seg = np.empty(len(pick), _SEG)
        seg["anchor"], seg["start"], seg["row"], seg["n"] = anchor[pick], start[pick], row[pick] - part, 1
        out.append((_RUN, place, 1, doc[part : part + (1 << 16)].tobytes(), seg.tobytes(), win[pick].tobytes()))
    return out


def _remove(window: int, with_text: bool):
    """mapInArrow function over (place, kind, hits, key, text, row): answers first, then the documents they speak of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: list[np.ndarray] = []
        known = None
        for piece in pieces(batches, "text"):
            kind = piece.column("kind").to_numpy(zero_copy_only=False)
            for blob in piece.column("hits").filter(pa.array(kind == _ANSWER)):
                hits.append(np.frombuffer(blob.as_py(), _HIT))
            piece = piece.filter(pa.array(kind != _ANSWER))
            if not piece.num_rows:
                continue
            if known is None:
                known = np.concatenate(hits) if hits else np.zeros(0, _HIT)
                known = known[np.argsort(known["key"], kind="stable")]
                hits.clear()
            w = words(piece.column("text"))
            keys = piece.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            low, high = np.searchsorted(known["key"], keys, "left"), np.searchsorted(known["key"], keys, "right")
            n = high - low
            row = np.repeat(np.arange(len(keys)), n)
            pick = known[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            begin = w.first[row] + pick["start"]
            change = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + pick["n"] + window - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[w.first[1:]] - total[w.first[:-1]]
            data, sha, text = w.data.tobytes(), [], []
            for r, (a, b, f, t, cut) in enumerate(zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), w.first[:-1].tolist(), w.first[1:].tolist(), removed.tolist())):
                own = data[a:b].split()
                kept = b" ".join(itertools.compress(own, (~gone[f:t]).tolist()) if cut else own)
                sha.append(hashlib.sha256(kept).hexdigest())
                text.append(kept if cut and with_text else None)
            left = pa.array(text, pa.binary()).cast(pa.string())
            left = pc.coalesce(left, piece.column("text")) if with_text else left
            yield pa.RecordBatch.from_arrays(
                [piece.column("row"), pa.array(np.diff(w.first)), pa.array(removed), pa.array(sha), left],
                ["row", "n_words", "n_removed", "kept_sha256", "text"],
            )

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    return docs.select(ident.alias("doc_id"), F.xxhash64(ident, F.coalesce(text, F.lit(""))).alias("key"), text.alias("text"), rest.alias("row"))


class FingerprintIndex:
    """Historical window fingerprints, as immutable sorted runs in a folder of their own; an existing one is reopened.

    path None: no history; a batch is then judged against itself only.
    """

    def __init__(self, spark, path: str | None = None, window: int = WINDOW, shards: int | None = None, fanout: int = 4):
        self.spark, self.path, self.window, self.fanout = spark, path and path.rstrip("/"), window, fanout
        self.shards = shards
        self.runs: list[str] = []
        self.version = 0
        if path:
            found = max(storage.names(spark, self.path, "manifest-"), default=None)
            if found:
                said = json.loads(storage.read_text(spark, f"{self.path}/{found}"))
                self.runs, self.version = [f"{self.path}/{x}" for x in said["runs"]], int(found.split("-")[1])
                if said["window"] != window or shards not in (None, said["shards"]):
                    raise ValueError("the index has other windows or shards")
                self.shards = said["shards"]

    def _commit(self, runs: list[str]) -> None:
        """Make these the runs that count."""
        self.version += 1
        own = {"window": self.window, "shards": self.shards, "runs": [x.rsplit("/", 1)[1] for x in runs]}
        storage.write_text(self.spark, f"{self.path}/manifest-{self.version:09d}", json.dumps(own))
        gone = [x for x in self.runs if x not in runs]
        self.runs = runs
        for x in gone:
            storage.delete(self.spark, x)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
        """Judge a batch, whose ids are larger than all earlier ones or not, against the index and itself.

        Returns row (the input's columns but the text), n_words, n_removed, kept_sha256 and text: the kept words
        joined by single spaces where some were removed, else the text unchanged (null if not with_text).
        A batch judges its own documents; those of earlier batches are not judged again.
        """
        storage.small_batches(self.spark)
        if self.shards is None:
            least = max(4, storage.partitions(self.spark))
            self.shards = min(64 * least, max(least, 3 * storage.input_bytes(docs) // (1 << 26)))
        keyed = _keyed(docs, id_col, text_col)
        new = keyed.select("doc_id", "key", "text").mapInArrow(cut_runs(self.shards, self.window), RUN)
        known = new
        if self.path:
            at = f"{self.path}/run-{uuid.uuid4().hex}"
            new.write.parquet(at)
            known = self._read(at, 0)
            for run in self.runs:
                known = known.unionByName(self._read(run, 1).where(F.col("kind") == _RUN))
        merged = known.groupBy("place").applyInArrow(merge_shard(self.shards, False), RUN).where(F.col("kind") == _ANSWER)
        if self.path:
            # the answer is settled before older runs may go
            answers = f"{self.path}/answers-{uuid.uuid4().hex}"
            merged.write.parquet(answers)
            storage.delete_at_end(self.spark, answers)
            merged = self.spark.read.schema(RUN).parquet(answers)
            self._commit([*self.runs, at])
            if len(self.runs) > self.fanout:
                self._compact()
        return self._apply(keyed, merged, with_text)

    def _read(self, run: str, level: int) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(run).withColumn("level", F.lit(level))

    def _compact(self) -> None:
        """Replace all runs by one that holds the earliest owner of each fingerprint."""
        at = f"{self.path}/run-{uuid.uuid4().hex}"
        runs = None
        for run in self.runs:
            one = self._read(run, 1).where(F.col("kind") == _RUN)
            runs = one if runs is None else runs.unionByName(one)
        runs.groupBy("place").applyInArrow(merge_shard(self.shards, True), RUN).where((F.col("kind") == _RUN) & (F.col("level") == 1)).write.parquet(at)
        self._commit([at])

    def _apply(self, keyed: DataFrame, merged: DataFrame, with_text: bool) -> DataFrame:
        none = F.lit(None)
        answers = merged.select(F.col("place"), F.lit(_ANSWER).alias("kind"), F.col("seg").alias("hits"), none.cast("long").alias("key"), none.cast("string").alias("text"), none.cast(keyed.schema["row"].dataType).alias("row"))
        # unsigned remainder of the key, as the answers' buckets have it
        place = F.pmod(F.pmod(F.col("key"), F.lit(self.shards)) + F.when(F.col("key") < 0, F.lit((1 << 64) % self.shards)).otherwise(0), F.lit(self.shards))
        rows = keyed.select(place.cast("int").alias("place"), F.lit(2).alias("kind"), none.cast("binary").alias("hits"), "key", "text", "row")
        together = answers.unionByName(rows).repartition(self.shards, "place").sortWithinPartitions("kind")
        row = keyed.schema["row"].dataType.simpleString()
        return together.mapInArrow(_remove(self.window, with_text), f"row {row}, n_words long, n_removed long, kept_sha256 string, text string")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """All of docs as the first batch of an empty index: see FingerprintIndex.ingest."""
    return FingerprintIndex(docs.sparkSession, window=window).ingest(docs, id_col, text_col, with_text)
