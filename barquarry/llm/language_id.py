"""Language identification of words in code-switched text by a linear-chain CRF.

Labels are the languages that the training rows name.  A word's emission scores are
sums of learned weights of its features: lexicon (the whole word), prefixes of 2 and 3
bytes, suffixes of 2, 3 and 4 bytes and all 3-byte n-grams, hashed into one table.
Transition weights are learned with them.  Training rows are labelled as a whole, so
half of the training sequences splice passages of two languages: that is where the
switch weights come from.  Marginals are exact (forward-backward); long documents are
worked on in blocks whose transfer matrices are chained, so that a text of a million
words costs no million Python steps.  A text of more than PIECE bytes is worked on in two
passes over parts of it that end between words: the first chains the parts' matrices from
either end, the second takes each part's marginals between what comes in from both sides.
The result is that of the whole text; memory follows the part, not the text.

A document's language is the one with the most expected words; its score is the share
of its lettered words expected in it.

The model is fitted on a bounded sample: `per_language` rows of each language, those
with the least hash of their id, as long as they have `characters` in all.  Prediction reads every row and every whole text and
sees nothing but the text.

Defined results: null text or no letter: `und`, score 0; no labelled rows: `und`
throughout; ties go to the language first in the alphabet; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquarry.llm import storage
from barquarry.llm.words import Words, buffers, mix, pieces, spans, words

PER_LANGUAGE = 400  # training rows of a language: the documented bound
CHARACTERS = 4_000_000  # of these rows together, by language; at least one row
PIECE = 1 << 19  # bytes of text that are labelled at once
REMEMBERED = 200_000  # distinct words whose scores a worker keeps
BUCKETS = 1 << 18
BLOCK = 64
SLAB = 1 << 18  # n-grams that are summed at a time
CHUNK = 32_768  # training words worked on at a time; a sequence is cut wherever a chunk ends
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CLASS = np.zeros(256, bool)  # bytes of letters: ASCII letters and all of other scripts
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0x5851F42D4C957F2D * (kind + 1) & (2**64 - 1))) >> np.uint64(64 - 18)).astype(np.int32)


class Features:
    """Hashed features of some distinct words: spans of bytes that do not overlap."""

    def __init__(self, data: np.ndarray, s: np.ndarray, e: np.ndarray):
        self.data, self.start = data, s
        marks = np.append(_CLASS[data], False).view(np.uint8)
        self.lettered = np.maximum.reduceat(marks, np.stack([s, e], 1).ravel())[::2] > 0 if len(s) else np.zeros(0, bool)  # words are never empty
        fixed = [spans(data, s, e, True) + (e - s).astype(np.uint64)]
        fixed += [spans(data, s, np.minimum(s + k, e), True) for k in (2, 3)]
        fixed += [spans(data, np.maximum(e - k, s), e, True) for k in (2, 3, 4)]
        self.fixed = np.stack([_bucket(h, k) for k, h in enumerate(fixed)], 1)
        self.count = np.maximum(e - s - 2, 0)
        self.end = np.cumsum(self.count)

    def grams(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of the n-grams a to b of all words in a row, their words)."""
        word = np.searchsorted(self.end, np.arange(a, b), "right")
        at = self.start[word] + np.arange(a, b) - (self.end[word] - self.count[word])
        d = self.data[at].astype(np.uint64) << np.uint64(16)
        d |= self.data[at + 1].astype(np.uint64) << np.uint64(8)
        d |= self.data[at + 2]
        return _bucket(d, 9), word

    def keep(self) -> Features:
        """Hold all n-grams, for training."""
        self.gram, self.word = self.grams(0, int(self.end[-1]) if len(self.end) else 0)
        return self

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Scores by word and label; 0 for words without letters."""
        out = weights[self.fixed[:, 0]].astype(np.float64)
        for k in range(1, self.fixed.shape[1]):
            out += weights[self.fixed[:, k]]
        total = int(self.end[-1]) if len(self.end) else 0
        for a in range(0, total, SLAB):
            b = min(a + SLAB, total)
            gram, word = (self.gram[a:b], self.word[a:b]) if hasattr(self, "gram") else self.grams(a, b)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] += np.add.reduceat(weights[gram].astype(np.float64), first, axis=0)
        return out * self.lettered[:, None]

    def gradient(self, change: np.ndarray) -> np.ndarray:
        """What a change of the distinct words' scores means for the weights."""
        change = change * self.lettered[:, None]
        out = np.zeros((BUCKETS, change.shape[1]))
        for label in range(change.shape[1]):
            c = change[:, label]
            out[:, label] = np.bincount(self.gram, c[self.word], BUCKETS)
            for k in range(self.fixed.shape[1]):
                out[:, label] += np.bincount(self.fixed[:, k], c, BUCKETS)
        return out


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


def transfer(scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The scaled matrix that takes what stands before some words to what stands behind them."""
    labels = transitions.shape[0]
    step = np.exp(transitions - transitions.max())
    phi = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    out = np.eye(labels)
    whole = len(phi) // BLOCK
    blocks = np.broadcast_to(out, (whole, labels, labels))
    for t in range(BLOCK if whole else 0):
        blocks = _scaled((blocks @ step) * phi[t : whole * BLOCK : BLOCK, None, :])
    for block in blocks:
        out = out @ block
        out /= out.sum()
    for own in phi[whole * BLOCK :]:
        out = (out @ step) * own
        out /= out.sum()
    return out


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, before: np.ndarray | None = None, behind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities of each word, expected transitions) of rows first[r]:first[r + 1], by forward-backward.

    Each row starts from the even distribution, one transition before its first word.  before and behind: what
    comes in from either side instead, where the rows are parts of longer ones.
    """
    labels = transitions.shape[0]
    step = np.exp(transitions - transitions.max())
    phi = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    count = np.diff(first)
    blocks = -(-count // BLOCK)
    row = np.repeat(np.arange(len(count)), blocks)
    k = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[row] + k * BLOCK
    size = np.minimum(count[row] - k * BLOCK, BLOCK)
    order = np.argsort(-size, kind="stable")  # longer blocks first: the active ones are a prefix
    begin, size = begin[order], size[order]
    active = [int(np.searchsorted(-size, -t)) for t in range(BLOCK + 1)]  # blocks longer than t
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))

    whole = np.broadcast_to(np.eye(labels), (len(order), labels, labels)).copy()
    for t in range(BLOCK):
        a = active[t]
        if not a:
            break
        whole[:a] = _scaled((whole[:a] @ step) * phi[begin[:a] + t][:, None, :])
    # chain the blocks of each row
    entry, leave = np.empty((len(order), labels)), np.empty((len(order), labels))
    last = np.cumsum(blocks) - blocks
    rows = np.argsort(-blocks, kind="stable")
    left = np.full((len(rows), labels), 1 / labels) if before is None else before[rows]
    deepest = int(blocks.max()) if len(blocks) else 0
    for d in range(deepest):
        n = int(np.searchsorted(-blocks[rows], -d))
        at = back[last[rows[:n]] + d]
        entry[at] = left[:n]
        left[:n] = _scaled((left[:n, None, :] @ whole[at])[:, 0, :])
    right = np.ones((len(rows), labels)) if behind is None else behind[rows]
    for d in range(deepest - 1, -1, -1):
        n = int(np.searchsorted(-blocks[rows], -d))
        at = back[last[rows[:n]] + d]
        leave[at] = right[:n]
        right[:n] = _scaled((whole[at] @ right[:n, :, None])[:, :, 0])
    # inside the blocks
    alpha, prior = np.empty_like(phi), np.empty_like(phi)
    now = entry
    for t in range(BLOCK):
        a = active[t]
        if not a:
            break
        prior[begin[:a] + t] = now[:a]
        now[:a] = _scaled((now[:a] @ step) * phi[begin[:a] + t])
        alpha[begin[:a] + t] = now[:a]
    beta = np.empty_like(phi)
    now = leave
    for t in range(BLOCK - 1, -1, -1):
        a = active[t]
        if not a:
            continue
        beta[begin[:a] + t] = now[:a]
        now[:a] = _scaled((phi[begin[:a] + t] * now[:a]) @ step.T)
    both = alpha * beta
    both /= both.sum(1, keepdims=True)
    ahead = phi * beta
    norm = ((prior @ step) * ahead).sum(1, keepdims=True)
    return both, step * (prior.T @ (ahead / norm))


class Model:
    """Labels, weights by feature bucket and transition weights."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((BUCKETS, len(labels)))
        self.transitions = np.zeros((len(labels), len(labels)))

    def fit(self, texts: list[str], langs: list[str], rounds: int = 25, rate: float = 0.3, shrink: float = 1e-4, seed: int = 5) -> Model:
        """Penalised likelihood of labelled and spliced sequences, by Adagrad over all words at once."""
        features, inverse, count = _vocabulary(texts)
        number = {x: i for i, x in enumerate(self.labels)}
        lang = np.array([number[x] for x in langs], np.int32)
        order, first = _spliced(np.concatenate([[0], np.cumsum(count)]), lang, np.random.default_rng(seed))
        first = np.union1d(first, np.arange(0, len(order), CHUNK))
        word, gold = inverse[order], np.repeat(lang, count)[order]
        inner = np.ones(len(order), bool)
        inner[first[:-1]] = False
        at = np.flatnonzero(inner)
        pairs = np.bincount(gold[at - 1] * len(self.labels) + gold[at], minlength=len(self.labels) ** 2).reshape(self.transitions.shape)
        del order, inner, at
        seen, seen_t = np.full(self.weights.shape, 1e-8), np.full(self.transitions.shape, 1e-8)
        n = max(1, len(word))
        for _ in range(rounds):
            change, expected = self._missing(features, word, gold, first)
            g = features.gradient(change)
            g -= shrink * self.weights
            g /= n
            t = (pairs - expected + 1 / len(self.labels)) / n - shrink * self.transitions
            seen += g * g
            seen_t += t * t
            g /= np.sqrt(seen)
            g *= rate
            self.weights += g
            self.transitions += rate * t / np.sqrt(seen_t)
        self.weights = self.weights.astype(np.float32)
        return self

    def _missing(self, features: Features, word: np.ndarray, gold: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(by distinct word and label: its labels less the expected ones, expected transitions), about CHUNK words at a time."""
        labels = len(self.labels)
        scores = features.emissions(self.weights)
        change, expected = np.zeros((len(features.fixed), labels)), np.zeros((labels, labels))
        at = 0
        while at < len(first) - 1:
            to = max(at + 1, int(np.searchsorted(first, first[at] + CHUNK, "right")) - 1)
            own = slice(first[at], first[to])
            post, some = marginals(scores[word[own]], first[at : to + 1] - first[at], self.transitions)
            expected += some
            for k in range(labels):
                change[:, k] += np.bincount(word[own], (gold[own] == k) - post[:, k], len(change))
            at = to
        return change, expected

    def label(self, column: pa.Array, known: Scores | None = None) -> tuple[np.ndarray, Words, np.ndarray]:
        """(label probabilities of every word, the words, whether they hold a letter)."""
        w = words(column, lower=True)
        scores, lettered = (known or Scores(self)).of(w)
        return marginals(scores, w.first, self.transitions)[0], w, lettered

    def label_long(self, text: np.ndarray, known: Scores, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As label, for one text of any length (its bytes), in parts: (label probabilities, whether they hold a letter)."""
        labels = len(self.labels)
        cuts = [0]
        while cuts[-1] < len(text):
            at = cuts[-1] + size
            while at < len(text):
                blank = np.flatnonzero(_SPACE[text[at : at + size]])
                if len(blank):
                    at += int(blank[0])
                    break
                at += size
            cuts.append(min(at, len(text)))
        parts = [(a, b) for a, b in zip(cuts, cuts[1:])]

        def scored(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            return known.of(words(pa.array([text[a:b].tobytes()], pa.binary()), lower=True))

        steps = [transfer(scored(a, b)[0], self.transitions) for a, b in parts]
        behind = [np.ones((1, labels))]
        for step in reversed(steps[1:]):
            behind.append(_scaled((step @ behind[-1][0])[None, :]))
        before = np.full((1, labels), 1 / labels)
        for (a, b), step in zip(parts, steps):
            scores, lettered = scored(a, b)
            yield marginals(scores, np.array([0, len(scores)]), self.transitions, before, behind.pop())[0], lettered
            before = _scaled(before @ step)


class Scores:
    """Emission scores of words, remembered by hash; forgotten when they are too many."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.scores, self.lettered = np.zeros((0, len(self.model.labels)), np.float32), np.zeros(0, bool)

    def of(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(scores of every word, whether it holds a letter). w.hash is that of lower-cased words."""
        keys, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(~np.isin(keys, self.keys, assume_unique=True) if len(self.keys) else np.ones(len(keys), bool))
        if len(new):
            if len(self.keys) + len(new) > REMEMBERED:
                self.clear()
                new = np.arange(len(keys))
            order = new[np.argsort(first[new])]  # spans in the order of the text
            size = w.end[first[order]] - w.start[first[order]]
            end = np.cumsum(size)
            data = w.data[np.repeat(w.start[first[order]] - (end - size), size) + np.arange(int(end[-1]))]  # the new words alone
            one = Features(data, end - size, end)
            every = np.concatenate([self.keys, keys[order]])
            by = np.argsort(every, kind="stable")
            self.keys = every[by]
            self.scores = np.concatenate([self.scores, one.emissions(self.model.weights).astype(np.float32)])[by]
            self.lettered = np.concatenate([self.lettered, one.lettered])[by]
            at = np.searchsorted(self.keys, keys)
        at = at[inverse]
        return self.scores[at].astype(np.float64), self.lettered[at]


def _vocabulary(texts: list[str]) -> tuple[Features, np.ndarray, np.ndarray]:
    """(features of the distinct words of all texts, number of each word in order, words of each text), a few texts at a time."""
    known: dict[int, int] = {}
    surfaces: list[bytes] = []
    inverse, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(texts), 16):
        w = words(pa.array(texts[at : at + 16], pa.string()), lower=True)
        keys, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        number = np.empty(len(keys), np.int32)
        for j in np.argsort(first).tolist():
            key = int(keys[j])
            if key not in known:
                known[key] = len(surfaces)
                surfaces.append(w.data[w.start[first[j]] : w.end[first[j]]].tobytes())
            number[j] = known[key]
        inverse.append(number[back])
        counts.append(np.diff(w.first))
    del known
    sizes = np.array([len(x) for x in surfaces], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    features = Features(np.frombuffer(b" ".join(surfaces) + b" ", np.uint8), ends - sizes, ends)
    return features.keep(), np.concatenate(inverse), np.concatenate(counts)


def _spliced(first: np.ndarray, lang: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Training sequences as (word numbers in order, where sequences begin): even rows as they are, odd rows
    in passages of 8 to 60 words taken in turn with the next odd row of another language."""
    parts: list[np.ndarray] = [np.arange(first[r], first[r + 1]) for r in range(0, len(lang), 2)]
    odd = [r for r in range(1, len(lang), 2)]
    by = sorted(odd, key=lambda r: (r * 2654435761) % 2**32)
    for a, b in zip(by[::2], by[1::2]):
        if lang[a] == lang[b]:
            parts += [np.arange(first[r], first[r + 1]) for r in (a, b)]
            continue
        out, at, end = [], {a: first[a], b: first[b]}, {a: first[a + 1], b: first[b + 1]}
        turn = a
        while at[a] < end[a] or at[b] < end[b]:
            n = int(rng.integers(8, 61))
            out.append(np.arange(at[turn], min(end[turn], at[turn] + n)))
            at[turn] += n
            turn = b if turn == a else a
        parts.append(np.concatenate(out))
    if len(by) % 2:
        parts.append(np.arange(first[by[-1]], first[by[-1] + 1]))
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(sizes)])


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, characters: int = CHARACTERS) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull() & ~held_out(F.col(f"`{id_col}`")))
    rows = rows.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{lang_col}`").alias("l"), F.col(f"`{text_col}`").alias("t"))
    labels = sorted(r["l"] for r in rows.select("l").distinct().collect())
    model = Model(labels)
    if not labels:
        return model
    keys = []
    for label in labels:  # ids and sizes of at most per_language rows a language; the texts follow for those that fit
        left = characters
        own = rows.where(F.col("l") == label).select("i", "l", F.char_length("t").alias("n")).orderBy(F.xxhash64("i"), "i", "n")
        for k, r in enumerate(own.limit(per_language).collect()):
            if not k or r["n"] <= left:
                keys.append((r["i"], r["l"], r["n"]))
                left -= r["n"]
    sized = rows.select("i", "l", F.char_length("t").alias("n"), "t")
    chosen = docs.sparkSession.createDataFrame(sorted(set(keys), key=str), sized.drop("t").schema)
    same = F.col("a.i").eqNullSafe(F.col("b.i")) & (F.col("a.l") == F.col("b.l")) & (F.col("a.n") == F.col("b.n"))
    found = sized.alias("a").join(F.broadcast(chosen.alias("b")), same, "left_semi")
    sample = found.groupBy("i", "l", "n").agg(F.min("t").alias("t")).collect()  # of rows that agree in all three, one
    sample.sort(key=lambda r: (r["i"] is None, r["i"], r["l"], r["t"]))
    # languages in turn, so that neighbours differ and passages can be spliced
    return model.fit([r["t"] for r in sample], [r["l"] for r in sample])


def _predict(model: Model, with_spans: bool, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Scores(model)
        for piece in pieces(batches, "text", PIECE):
            n, labels = piece.num_rows, len(model.labels)
            share, cuts = np.zeros((n, labels)), []
            data, offsets = buffers(piece.column("text"))
            if n == 1 and len(data) > PIECE:
                best = []
                for post, lettered in model.label_long(data, known):
                    share[0] += lettered @ post
                    if with_spans:
                        best.append(post.argmax(1).astype(np.int16))
                if with_spans:
                    best = np.concatenate(best)
                    cuts = _spans(best, np.array([0, len(best)]), model.labels)
            else:
                post, w, lettered = model.label(piece.column("text"), known)
                share = np.stack([np.bincount(w.row, post[:, k] * lettered, n) for k in range(labels)], 1)
                if with_spans:
                    cuts = _spans(post.argmax(1), w.first, model.labels)
            total = share.sum(1)
            best = share.argmax(1)
            good = piece.column("lettered").to_numpy(zero_copy_only=False).astype(bool) & (total > 0)
            score = np.where(good, np.clip(share[np.arange(n), best] / np.maximum(total, 1e-300), 0, 1), 0.0)
            lang = [model.labels[k] if ok else "und" for k, ok in zip(best.tolist(), good.tolist())]
            out = [piece.column("row"), pa.array(lang, pa.string()), pa.array(score)]
            if with_spans:
                out.append(pa.array(cuts, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))))
            names = ["row", "lang_pred", "score"] + ["spans"] * with_spans + ["text"] * with_text
            yield pa.RecordBatch.from_arrays(out + [piece.column("text")] * with_text, names)

    return run


def _spans(best: np.ndarray, first: np.ndarray, labels: list[str]) -> list[list[dict]]:
    """Per row its stretches of words of one label. best: each word's label; first: where rows begin."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        cut = [a, *(a + 1 + np.flatnonzero(best[a + 1 : b] != best[a : b - 1])).tolist()] if b > a else []
        out.append([{"lang": labels[best[x]], "first_word": x - a, "n_words": y - x} for x, y in zip(cut, [*cut[1:], b])])
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", with_spans: bool = False, with_text: bool = False) -> DataFrame:
    """row (the input's columns but the text), lang_pred, score and, if asked for, spans of words of one language and the text."""
    storage.small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rows = docs.select(rest.alias("row"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    kind = rows.schema["row"].dataType.simpleString()
    spans_kind = "array<struct<lang:string,first_word:bigint,n_words:bigint>>"
    if not model.labels:
        out = rows.select("row", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.expr(f"cast(array() as {spans_kind})").alias("spans"), "text")
        return out.drop(*["spans"] * (not with_spans), *["text"] * (not with_text))
    schema = f"row {kind}, lang_pred string, score double" + f", spans {spans_kind}" * with_spans + ", text string" * with_text
    return rows.mapInArrow(_predict(model, with_spans, with_text), schema)
