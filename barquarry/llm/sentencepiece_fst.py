"""SentencePiece encoding and decoding as a weighted finite-state transducer.

*Compile* (once, on the driver).  The normaliser (the model's table of replaced strings, the
longest match first; dummy prefix; white space escaped, extra white space dropped if the
model says so), the pieces and the byte fallback become one
transducer: an arc for each piece, and for each character without a piece an arc that
writes its bytes' pieces.

*Weights.*  Unigram models: a path weighs the sum of its pieces' negated scores.  BPE
models: merging is no sum of weights, but a cut is the one that the merges make exactly if
each two neighbouring pieces stay apart when merged alone.  So the transducer is composed
with the acceptor of those neighbours: a neighbour pair weighs 0 or infinity, and the only
path of finite weight is the encoding.  Whether a pair stays apart is decided by undoing
its pieces' merges, latest first; a worker remembers that for about a million pairs.

*Compose and search.*  Each distinct chunk (blanks and what follows them) of the input is
composed with the transducer and the shortest path in the tropical semiring is taken, for
all chunks of a length at once, position by position.  No piece reaches over a chunk's
end, nor over two neighbouring characters that no piece holds: there, longer chunks are cut
as well.  What is longer still is searched arc by arc, with its arcs and the neighbours
they meet found for all positions at once.  Results are remembered by chunk in a bounded
table of the Python worker, and compared with the chunk's text.

Decoding concatenates the pieces' bytes, turns the escape into a blank and drops the dummy
prefix.  decode(encode(text)) is the normalised text; a literal U+2581 comes back as a blank.

Defined results: null or empty text has no ids; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquarry.llm import storage
from barquarry.llm.packing import Known
from barquarry.llm.words import buffers, mix, pieces, spans

ESCAPE = "▁"
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_C = np.uint64(0xD6E8FEB86659FD93)
# The kinds of pieces and of models in a model file
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
NONE, START = -2, -1
PAIRS = 1 << 20  # places of the table of neighbours that were told apart, in a Python worker
SHORT = 48  # characters of a chunk that is searched together with others of its length


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer."""
    i = 0

    def number() -> int:
        nonlocal i
        x = shift = 0
        while True:
            c = b[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(b):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        n = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, b[i : i + n]
        i += n


def _rules(blob: bytes) -> dict[str, str]:
    """The normaliser's replaced strings: all paths of the double-array trie in a model's table, with what they end in."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, values = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    out: dict[str, str] = {}
    every = np.arange(1, 256)

    def base(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    stack = [(base(int(units[0])), b"")]
    while stack:
        at, key = stack.pop()
        place = at ^ every
        place = np.where(place < len(units), place, 0)
        for c in every[(units[place] & ((1 << 31) | 255)) == every].tolist():
            unit = int(units[at ^ c])
            below = (at ^ c) ^ base(unit)
            if unit >> 8 & 1:
                begin = int(units[below]) & ((1 << 31) - 1)
                out[(key + bytes([c])).decode()] = values[begin : values.index(b"\0", begin)].decode()
            stack.append((below, key + bytes([c])))
    return out


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_B) + ord(c) + 1) & (2**64 - 1)
    return h


class Transducer:
    """A compiled model: arrays only, so that it travels to the executors."""

    pairs: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pairs": None}  # what was remembered stays

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts: list[str] = []
        kinds, scores = [], []
        normal: dict[int, int | bytes] = {}
        self.kind = UNIGRAM
        for field, value in _fields(model.serialized_model_proto()):
            if field == 1:
                one = dict(_fields(value))
                self.texts.append(one[1].decode())
                scores.append(float(np.frombuffer(one.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(one.get(3, NORMAL))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                normal = dict(_fields(value))
        self.rules = _rules(normal.get(2) or b"")
        self.rule_starts = "".join(sorted({k[0] for k in self.rules}))
        self.rule_longest = max(map(len, self.rules), default=0)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be compiled")
        self.prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.scores = np.array(scores)
        self.worst = min((s for s, k in zip(scores, kinds) if k == NORMAL), default=0.0) - 10  # of a character without a piece
        self.size = len(kinds)
        self.byte = np.full(256, kinds.index(UNKNOWN))
        for i, k in enumerate(kinds):
            if k == BYTE:
                self.byte[int(self.texts[i][1:-1], 16)] = i
        if BYTE not in kinds:
            raise ValueError("only models with byte fallback can be compiled")
        usable = {t: i for i, t in enumerate(self.texts) if kinds[i] in (NORMAL, USER)}
        if self.kind == BPE:
            usable = self._undone(usable)
        self.longest = max(map(len, usable), default=1)
        self.inner = np.array(sorted({(ord(a) << 32) | ord(b) for t in usable for a, b in itertools.pairwise(t)}), np.int64)  # neighbours that a piece holds
        keys = np.array([_hash(t) for t in usable], np.uint64)
        self.keys, self.ids = keys, np.array(list(usable.values()), np.int64)
        self._place()
        self.hashes = np.zeros(self.size, np.uint64)
        self.hashes[self.ids] = self.keys
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.powers = np.array([pow(int(_B), n, 1 << 64) for n in range(self.longest + 1)], np.uint64)
        shown = [bytes([int(t[1:-1], 16)]) if k == BYTE else t.replace(ESCAPE, " ").encode() if k in (NORMAL, USER) else b"" for t, k in zip(self.texts, kinds)]
        self.shown, self.shown_at = np.frombuffer(b"".join(shown), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in shown])])
        inner = {c for t in usable for c in t if ord(c) < 32}
        self.apart = np.array([i for i in range(32) if chr(i) not in inner], np.int64)  # control characters in no piece
        if any(ESCAPE in t.lstrip(ESCAPE) for t in usable):
            raise ValueError("pieces that go on behind a blank cannot be composed chunk by chunk")

    def _undone(self, usable: dict[str, int]) -> dict[str, int]:
        """Each piece's rank and the two pieces of its last merge; pieces that no merges make are left out."""
        self.rank = np.full(self.size, -1)
        chars = sorted(t for t in usable if len(t) == 1)
        longer = sorted((t for t in usable if len(t) > 1), key=lambda t: -self.scores[usable[t]])
        for r, t in enumerate([*chars, *longer]):
            self.rank[usable[t]] = r
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        out = {t: usable[t] for t in chars}
        for t in longer:
            parts = list(t)
            while len(parts) > 1:
                best = min((int(self.rank[usable[m]]), i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in usable) if any(parts[i] + parts[i + 1] in usable for i in range(len(parts) - 1)) else None
                if best is None:
                    break
                i = best[1]
                if len(parts) == 2 and all(p in usable for p in parts):
                    self.left[usable[t]], self.right[usable[t]] = usable[parts[0]], usable[parts[1]]
                    out[t] = usable[t]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return out

    def _place(self) -> None:
        """The pieces in a table by their hashes' upper bits, at most a quarter full; what finds its place taken moves on to the next free one."""
        bits = max(4, (4 * len(self.keys) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slot_key, self.slot_piece = np.zeros(1 << bits, np.uint64), np.full(1 << bits, NONE)
        for at, key, piece in zip(((self.keys * _C) >> self.shift).tolist(), self.keys, self.ids):
            while self.slot_piece[at] != NONE:
                at = (at + 1) & int(self.mask)
            self.slot_key[at], self.slot_piece[at] = key, piece

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, or NONE."""
        at = ((h * _C) >> self.shift).astype(np.int64)
        out = self.slot_piece[at]
        taken = np.flatnonzero((self.slot_key[at] != h) & (out != NONE))
        at, h = at[taken], h[taken]
        while len(taken):
            at = (at + 1) & self.mask
            found = self.slot_piece[at]
            out[taken] = found
            go = (self.slot_key[at] != h) & (found != NONE)
            taken, at, h = taken[go], at[go], h[go]
        return out

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As apart_pair; pairs are remembered with the answer, each in the one place that its number gives, and compared."""
        if self.pairs is None:
            self.pairs = np.full(PAIRS, -1)  # pair * 2 + whether it stays apart
        known = self.pairs
        pair = a.astype(np.int64) * self.size + b
        at = ((pair.astype(np.uint64) * _C) >> np.uint64(65 - PAIRS.bit_length())).astype(np.int64)
        said = known[at]
        out = (said & 1).astype(bool)
        if len(new := np.flatnonzero(said >> 1 != pair)):
            out[new] = self.apart_pair(a[new], b[new])
            known[at[new]] = pair[new] * 2 + out[new]
        return out

    def apart_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, side by side, stay as they are under the merges."""
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            n = self.lengths[b]
            fits = self.lengths[a] + n <= self.longest
            joined = np.where(fits, self.find(self.hashes[a] * self.powers[np.minimum(n, self.longest)] + self.hashes[b]), NONE)
            broken = (joined >= 0) & (self.rank[joined] < limit)  # merged before the later of the two was whole
            out[live[broken]] = False
            go = ~broken
            live, a, b = live[go], a[go], b[go]
            # undo the later merge; of equals the right one, as merges go from the left
            first = self.rank[a] > self.rank[b]
            whole_a, whole_b = self.lengths[a] == 1, self.lengths[b] == 1
            undo_a = (first & ~whole_a) | whole_b
            go = ~(whole_a & whole_b)
            limit = np.where(undo_a, self.rank[a], self.rank[b] + 1)[go]
            live, undo_a, a, b = live[go], undo_a[go], a[go], b[go]
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out

    def paths(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shortest paths of chunks of one length (rows of code points): (last piece, its length) by chunk and position.

        The piece `size` stands for a character without a piece.
        """
        n, length = codes.shape
        h = np.zeros((length + 1, n), np.uint64)  # by position, then chunk
        for i in range(length):
            h[i + 1] = h[i] * _B + (codes[:, i].astype(np.uint64) + np.uint64(1))
        last, step = np.full((length + 1, n), NONE), np.zeros((length + 1, n), np.int64)
        cost = np.full((length + 1, n), np.inf, np.float32)  # as the library adds up
        last[0], cost[0] = START, 0
        reached = [np.arange(n)]  # chunks with a path to each position
        worst, scores = np.float32(self.worst), self.scores.astype(np.float32)
        for i in range(1, length + 1):
            for size in range(min(i, self.longest), 0, -1):  # of equal paths the one with the longer last piece
                j = i - size
                rows = reached[j]
                piece = self.find(h[i][rows] - h[j][rows] * self.powers[size])
                if size == 1:
                    piece = np.where(piece == NONE, self.size, piece)
                rows, piece = rows[piece >= 0], piece[piece >= 0]
                if self.kind == BPE:
                    ask = (last[j, rows] >= 0) & (last[j, rows] < self.size) & (piece < self.size)
                    good = np.ones(len(rows), bool)
                    good[ask] = self.stay_apart(last[j, rows[ask]], piece[ask])
                    rows, piece = rows[good], piece[good]
                    last[i, rows], step[i, rows] = piece, size
                else:
                    weight = cost[j, rows] - np.where(piece < self.size, scores[np.minimum(piece, self.size - 1)], worst)
                    better = weight < cost[i, rows]
                    rows, piece = rows[better], piece[better]
                    cost[i, rows], last[i, rows], step[i, rows] = weight[better], piece, size
            reached.append(np.flatnonzero(last[i] != NONE))
        return last.T, step.T

    def normalise(self, text: str) -> str:
        """The text with the model's replaced strings, longest match first, and without extra blanks if it drops them."""
        if self.rules:
            out, at = [], 0
            for m in re.finditer(f"[{re.escape(self.rule_starts)}]", text):
                if (i := m.start()) < at:
                    continue
                for n in range(self.rule_longest, 0, -1):
                    new = self.rules.get(text[i : i + n])
                    if new is not None:
                        out += [text[at:i], new]
                        at = i + min(n, len(text) - i)
                        break
            text = "".join([*out, text[at:]])
        return " ".join(p for p in text.split(" ") if p).rstrip(" " + ESCAPE) if self.squeeze else text

    def path_long(self, codes: np.ndarray) -> list[int]:
        """The ids of one long chunk (code points): arcs and neighbours by array, the search arc by arc."""
        length = len(codes)
        values = codes.astype(np.uint64) + np.uint64(1)
        h, begins, pieces_, sizes = values, [], [], []
        for size in range(1, min(length, self.longest) + 1):
            if size > 1:
                h = h[:-1] * _B + values[size - 1 :]
            found = self.find(h)
            at = np.arange(length) if size == 1 else np.flatnonzero(found >= 0)
            begins.append(at)
            pieces_.append(np.where(found[at] == NONE, self.size, found[at]))
            sizes.append(np.full(len(at), size))
        begin, piece, size = (np.concatenate(x) for x in (begins, pieces_, sizes))
        end = begin + size
        order = np.lexsort((begin, end))
        begin, piece, end = begin[order], piece[order], end[order]
        first = np.searchsorted(end, np.arange(length + 2)).tolist()
        barred: set[tuple[int, int]] = set()
        if self.kind == BPE:
            # every two arcs that meet, told apart once
            left = np.argsort(begin, kind="stable")
            low, high = np.searchsorted(begin[left], end, "left"), np.searchsorted(begin[left], end, "right")
            step = max(1, 1 << 20)
            for a in range(0, len(end), step):
                n = high[a : a + step] - low[a : a + step]
                second = piece[left[np.repeat(low[a : a + step] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]]
                pairs = np.unique(np.repeat(piece[a : a + step], n) * (self.size + 1) + second)
                x, y = pairs // (self.size + 1), pairs % (self.size + 1)
                known = (x < self.size) & (y < self.size)
                x, y = x[known], y[known]
                bad = ~self.apart_pair(x, y)
                barred.update(zip(x[bad].tolist(), y[bad].tolist()))
        last, back = [NONE] * (length + 1), [0] * (length + 1)
        cost = [np.float32("inf")] * (length + 1)
        last[0], cost[0] = START, np.float32(0)
        begins_, pieces_ = begin.tolist(), piece.tolist()
        scores, worst = list(self.scores.astype(np.float32)), np.float32(self.worst)
        for i in range(1, length + 1):
            for e in range(first[i], first[i + 1]):
                j, p = begins_[e], pieces_[e]
                if last[j] == NONE or (last[j], p) in barred:
                    continue
                weight = cost[j] - (scores[p] if p < self.size else worst) if self.kind == UNIGRAM else 0.0
                if weight < cost[i] or self.kind == BPE:
                    last[i], back[i], cost[i] = p, j, weight
        out, i = [], length
        while i:
            if last[i] == self.size:
                out += [int(self.byte[x]) for x in reversed(chr(int(codes[i - 1])).encode("utf-8", "replace"))]
            else:
                out.append(last[i])
            i = back[i]
        return out[::-1]

    def _cut(self, chunk: str) -> list[str]:
        """A chunk cut between neighbours that no piece holds."""
        codes = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        both = (codes[:-1] << 32) | codes[1:]
        at = np.minimum(np.searchsorted(self.inner, both), len(self.inner) - 1)
        cuts = (np.flatnonzero(self.inner[at] != both) + 1).tolist() if len(self.inner) else list(range(1, len(chunk)))
        return [chunk[a:b] for a, b in itertools.pairwise([0, *cuts, len(chunk)])]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each chunk); chunks are normalised."""
        if not any(len(c) > SHORT for c in chunks):
            return self._encode_short(chunks)
        parts = [self._cut(c) if len(c) > SHORT else [c] for c in chunks]
        numbers: dict[str, int] = {}
        flat = np.array([numbers.setdefault(p, len(numbers)) for own in parts for p in own], np.int64)
        short = [p for p in numbers if len(p) <= SHORT]
        ids, counts = self._encode_short(short)
        found = dict(zip(short, np.split(ids, np.cumsum(counts)[:-1]))) if short else {}
        for p in numbers:
            if len(p) > SHORT:
                found[p] = np.array(self.path_long(np.frombuffer(p.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)), np.int32)
        by = [found[p] for p in numbers]
        sizes = np.array([len(x) for x in by], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes[flat])])
        cuts = np.concatenate([[0], np.cumsum([len(own) for own in parts])])
        return np.concatenate([by[i] for i in flat.tolist()] or [np.zeros(0, np.int32)]).astype(np.int32), np.diff(ends[cuts])

    def _encode_short(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode_chunks, for chunks of at most SHORT characters. The paths are followed back for all chunks of a length at once."""
        sizes = np.array([len(c) for c in chunks], np.int64)
        flat = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        by_size = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[by_size], prepend=-1)).tolist() + [len(chunks)]
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]  # chunk, steps from its end, piece, character
        for low, high in itertools.pairwise(cuts):
            length = int(sizes[by_size[low]])
            for at in range(low, high if length else low, 50_000):
                rows = by_size[at : min(at + 50_000, high)]
                codes = flat[begin[rows][:, None] + np.arange(length)]
                last, step = self.paths(codes)
                live, place, k = np.arange(len(rows)), np.full(len(rows), length), 0
                while len(live):
                    found.append((rows[live], np.full(len(live), k), last[live, place], codes[live, place - 1]))
                    place = place - step[live, place]
                    live, place, k = live[place > 0], place[place > 0], k + 1
        row, k, piece, code = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-k, row))
        row, piece, code = row[order], piece[order], code[order]
        n = np.ones(len(row), np.int64)
        bare = np.flatnonzero(piece == self.size)  # characters without a piece: their bytes'
        written = [[int(self.byte[x]) for x in chr(c).encode("utf-8", "replace")] for c in code[bare].tolist()]
        n[bare] = [len(x) for x in written]
        ids = np.repeat(piece, n).astype(np.int32)
        if written:
            first = (np.cumsum(n) - n)[bare]
            ids[np.repeat(first, n[bare]) + np.arange(int(n[bare].sum())) - np.repeat(np.cumsum(n[bare]) - n[bare], n[bare])] = [x for w in written for x in w]
        return ids, np.bincount(row, n, len(chunks)).astype(np.int64)


class ChunkIds(Known):
    """Ids of chunks, remembered by hash."""

    def __init__(self, fst: Transducer):
        self.fst = fst
        super().__init__()

    def encode(self, surfaces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.fst.encode_chunks(surfaces)


_KNOWN: dict[int, ChunkIds] = {}


def encode(column: pa.Array, fst: Transducer, known: ChunkIds) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, where each row's begin, one more at the end)."""
    if fst.squeeze or fst.rules:
        column = pa.array([None if x is None else fst.normalise(x) for x in column.to_pylist()], pa.string())
    data, offsets = buffers(column)
    blank = data == 32
    opens_blank = blank.copy()
    if (mark := np.flatnonzero(data == 0xE2)).size:  # a literal escape character counts as a blank
        padded = np.append(data, [0, 0])
        mark = mark[(padded[mark + 1] == 0x96) & (padded[mark + 2] == 0x81)]
        opens_blank[mark] = True
        blank[np.concatenate([mark, mark + 1, mark + 2])] = True
    alone = np.isin(data, fst.apart)
    head = np.zeros(len(data) + 1, bool)
    head[offsets] = True
    opens = head[:-1].copy()
    head = head[:-1]
    head |= alone
    if len(data):
        head[1:] |= alone[:-1] | (opens_blank[1:] & ~blank[:-1])
    start = np.flatnonzero(head)
    end = np.append(start[1:], len(data))
    first_of_row = opens[start] & fst.prefix
    keys = mix(spans(data, start, end) + (end - start).astype(np.uint64))
    keys = np.where(first_of_row, mix(keys ^ np.uint64(0xA5A5A5A5)), keys)
    whole = data.tobytes()
    flat, at = known.look_up(data, start, end, keys, data, lambda i: (ESCAPE if first_of_row[i] else "") + whole[start[i] : end[i]].decode("utf-8", "replace").replace(" ", ESCAPE))
    return flat, at[np.searchsorted(start, offsets)]


def decode(flat: np.ndarray, begin: np.ndarray, fst: Transducer) -> list[bytes]:
    """Each row's text as bytes."""
    n = np.diff(fst.shown_at)[flat]
    total = np.concatenate([[0], np.cumsum(n)])
    data = fst.shown[np.repeat(fst.shown_at[flat] - total[:-1], n) + np.arange(total[-1])].tobytes()
    cut = total[begin].tolist()
    out = [data[a:b] for a, b in zip(cut, cut[1:])]
    return [x.removeprefix(b" ") for x in out] if fst.prefix else out


def _round_trip(fst: Transducer, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _KNOWN.setdefault(zlib.crc32(fst.keys), None) or ChunkIds(fst)
        _KNOWN[zlib.crc32(fst.keys)] = known
        for piece in pieces(batches, "text", 1 << 22):
            flat, begin = encode(piece.column("text"), fst, known)
            data, offsets = buffers(piece.column("text"))
            back, whole, cut = decode(flat, begin, fst), data.tobytes(), offsets.tolist()
            same = [x == whole[a:b] for x, a, b in zip(back, cut, cut[1:])]
            raw = flat.astype("<u4")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), begin[1:].tolist())]
            out = [piece.column("doc_id"), pa.array(np.diff(begin)), pa.array(crc, pa.int64()), pa.array(same)]
            if with_ids:
                out += [pa.array([x.astype(np.int32) for x in np.split(flat, begin[1:-1])], pa.list_(pa.int32())), pa.array([x.decode("utf-8", "replace") for x in back])]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_ids", "ids_crc32", "round_trip", "ids", "decoded"][: len(out)])

    return run


def encode_documents(docs: DataFrame, fst: Transducer, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), round_trip and, if asked for, ids and the decoded text."""
    storage.small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return texts.mapInArrow(_round_trip(fst, with_ids), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean" + ", ids array<int>, decoded string" * with_ids)
