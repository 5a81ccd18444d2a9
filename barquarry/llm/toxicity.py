"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other.  Each classifier is a logistic regression
over the words of a document (lower case, without signs at their ends) and their first 4, 5
and 6 bytes, hashed, plus the log odds that the earlier classifiers give.  A feature counts
with its log ratio between the classes, and only if that ratio is beyond chance: by standard
errors and by a bound of the binomial tail, which holds for few rows too.  One that speaks
for the rarer class must also be in at least 4 of that class's training rows, however few
those are among all.  For training, those earlier log odds come from models that did not see the row (out-of-fold, `folds` parts by a hash of the id), as the models' own
training rows would make them look too sure.  For prediction the models fitted on all
training rows are chained.

The chain is fitted on a bounded sample of about `sample` labelled rows.  Half of it is dealt
evenly to the combinations of labels that occur, so that rare classes are drawn whole or with
many rows, the rest by their size; within a combination the rows with the least hash of their
id are taken, and each row weighs as many as it stands for.  Prediction reads every row and
the whole text.

Defined results: null or empty text has no features, so that the intercepts decide; rows
whose label is null do not train that category; a category with one class only always
predicts it; no labelled rows: probability 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquarry.llm import storage
from barquarry.llm.words import mix, pieces, spans, words

SAMPLE, FOLDS, BUCKETS = 8_000, 5, 1 << 18
CHANCE = 5.0  # standard errors by which a feature's share of a class must differ
LEAST = 4  # training rows of the rarer class that a feature must be in to speak for it
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(column: pa.Array, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct sorted feature buckets of all rows, where each row's begin, one more at the end). used: buckets that count."""
    w = words(column, lower=True)
    # the word without signs at its ends
    letters = _LETTER[w.data]
    at = np.flatnonzero(letters)
    low, high = np.searchsorted(at, w.start), np.searchsorted(at, w.end)
    some = high > low
    s, e = at[low[some]], at[high[some] - 1] + 1
    row, found = [], []
    for kind, n in enumerate((1 << 30, 4, 5, 6)):
        cut = np.minimum(s + n, e)
        whole = mix(spans(w.data, s, cut, True) + (cut - s + 64 * kind).astype(np.uint64))
        bucket = (whole >> np.uint64(64 - 18)).astype(np.int64)
        good = slice(None) if used is None else used[bucket]
        row.append(w.row[some][good])
        found.append(bucket[good])
    both = np.unique(np.concatenate(row) * BUCKETS + np.concatenate(found))
    return both % BUCKETS, np.searchsorted(both, np.arange(len(w.first)) * BUCKETS)


class Linear:
    """Logistic regression over feature sets and a few dense columns, by Adagrad over all rows at once."""

    def __init__(self, dense: int):
        self.weights, self.dense, self.bias = np.zeros(BUCKETS), np.zeros(dense), 0.0

    def odds(self, flat: np.ndarray, begin: np.ndarray, dense: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[flat])])
        return total[begin[1:]] - total[begin[:-1]] + dense @ self.dense + self.bias

    def fit(self, flat: np.ndarray, begin: np.ndarray, dense: np.ndarray, y: np.ndarray, stands: np.ndarray | None = None, rounds: int = 60, rate: float = 0.2, shrink: float = 1e-4) -> Linear:
        """stands: the labelled rows that each row stands for."""
        if not len(y) or y.min() == y.max():
            self.bias = 20.0 if len(y) and y[0] else -20.0
            return self
        row = np.repeat(np.arange(len(y)), np.diff(begin))
        n, yes = np.bincount(flat, minlength=BUCKETS), np.bincount(flat, y[row], BUCKETS)
        rate_all = y.mean()
        ratio = np.log((yes + rate_all) / (yes.sum() + 1)) - np.log((n - yes + 1 - rate_all) / ((n - yes).sum() + 1))
        beyond = np.abs(yes - n * rate_all) >= CHANCE * np.sqrt(np.maximum(n * rate_all * (1 - rate_all), 1e-9))
        beyond &= _surprise(yes, n, rate_all) >= CHANCE * CHANCE / 2
        rarer, share = (yes, rate_all) if rate_all <= 0.5 else (n - yes, 1 - rate_all)
        scale = np.where(beyond & ((rarer >= LEAST) | (rarer < n * share)), ratio, 0.0)  # the others would only name rows
        used = scale[flat] != 0
        row, flat = row[used], flat[used]
        begin = np.searchsorted(row, np.arange(len(y) + 1))
        weight = np.full(len(y), 1 / len(y)) if stands is None else stands / stands.sum()
        seen, seen_d, seen_b = np.full(BUCKETS, 1e-10), np.full(len(self.dense), 1e-10), 1e-10
        own = np.zeros(BUCKETS)
        for _ in range(rounds):
            self.weights = own * scale
            gap = (y - 1 / (1 + np.exp(-np.clip(self.odds(flat, begin, dense), -30, 30)))) * weight
            g = np.bincount(flat, gap[row], BUCKETS) * scale - shrink * own
            d, b = dense.T @ gap - shrink * self.dense, gap.sum()
            seen += g * g
            seen_d += d * d
            seen_b += b * b
            own += rate * g / np.sqrt(seen)
            self.dense += rate * d / np.sqrt(seen_d)
            self.bias += rate * b / np.sqrt(seen_b)
        self.weights = own * scale
        return self


def _surprise(yes: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
    """Chernoff's bound: the chance of a share this far from rate among n rows is at most exp(-this)."""
    p = yes / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return n * (np.where(p > 0, p * np.log(p / rate), 0.0) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - rate)), 0.0))


class Chain:
    """One Linear for each category, in order."""

    def __init__(self, categories: list[str]):
        self.categories = categories
        self.models: list[Linear] = []

    def fit(self, flat: np.ndarray, begin: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int = FOLDS, stands: np.ndarray | None = None) -> Chain:
        """labels: (rows, categories), NaN where there is none. stands: the labelled rows that each row stands for."""
        stands = np.ones(len(fold)) if stands is None else stands
        dense = np.zeros((len(fold), 0))
        for k in range(labels.shape[1]):
            known = ~np.isnan(labels[:, k])
            model = Linear(k).fit(*_rows(flat, begin, known), dense[known], labels[known, k], stands[known])
            outside = np.zeros(len(fold))
            if k + 1 < labels.shape[1]:
                for part in range(folds):
                    use, rest = known & (fold != part), fold == part
                    apart = Linear(k).fit(*_rows(flat, begin, use), dense[use], labels[use, k], stands[use])
                    outside[rest] = apart.odds(*_rows(flat, begin, rest), dense[rest])
            dense = np.column_stack([dense, np.clip(outside, -10, 10)])
            model.weights = model.weights.astype(np.float32)
            self.models.append(model)
        return self

    def predict(self, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(rows, categories) of probabilities."""
        n = len(begin) - 1
        dense = np.zeros((n, 0))
        for model in self.models:
            dense = np.column_stack([dense, np.clip(model.odds(flat, begin, dense), -10, 10)])
        return 1 / (1 + np.exp(-dense)) if self.models else np.zeros((n, len(self.categories)))


def _rows(flat: np.ndarray, begin: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(begin)
    return flat[np.repeat(use, n)], np.concatenate([[0], np.cumsum(n[use])])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        flat, begin = features(piece.column("text"))
        rows = [x.astype("<i4").tobytes() for x in np.split(flat, begin[1:-1])]
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "found"])


def quotas(sizes: list[int], sample: int) -> list[int]:
    """How many rows of each stratum are drawn: all if they fit, else half of the sample evenly and half by size."""
    if sum(sizes) <= sample:
        return sizes
    even = sample // (2 * len(sizes))
    rest = sample - even * len(sizes)
    return [min(n, max(1, even + rest * n // sum(sizes))) for n in sizes]


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit on about `sample` labelled rows, drawn by combination of labels; labels may be null."""
    spark = docs.sparkSession
    storage.small_batches(spark)
    marks = [f"y{k}" for k in range(len(categories))]
    every = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[(F.col(f"`{c}`").cast("double") > 0).cast("double").alias(m) for c, m in zip(categories, marks)])
    every = every.where("doc_id is not null")
    strata = every.groupBy(*marks).agg(F.count(F.lit(1)).alias("size")).collect()  # at most 3 ** categories
    if not strata:
        return Chain(categories)
    some = None
    for r, n in zip(strata, quotas([r["size"] for r in strata], sample)):
        own = every
        for m in marks:
            own = own.where(F.col(m).eqNullSafe(F.lit(r[m]).cast("double")))
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).withColumn("stands", F.lit(r["size"] / n))
        some = own if some is None else some.unionByName(own)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")
    found = {r["doc_id"]: np.frombuffer(r["found"], "<i4") for r in texts.mapInArrow(_sampled, "doc_id long, found binary").toLocalIterator()}
    rows = sorted((r for r in some.distinct().collect() if r["doc_id"] in found), key=lambda r: r["doc_id"])
    if not rows:
        return Chain(categories)
    common = np.zeros(BUCKETS, np.int64)
    for x in found.values():
        common[x] += 1
    parts = [(x := found[r["doc_id"]])[common[x] >= 4] for r in rows]  # rarer features are never used
    y = np.array([[np.nan if v is None else v for v in r[1:-1]] for r in rows], float).reshape(len(rows), -1)
    fold = (mix(np.array([r["doc_id"] for r in rows], np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(int)
    return Chain(categories).fit(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), y, fold, stands=np.array([r["stands"] for r in rows]))


def _scores(chain: Chain):
    used = np.zeros(BUCKETS, bool)
    for model in chain.models:
        used |= model.weights != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            p = chain.predict(*features(piece.column("text"), used))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *[pa.array(p[:, k]) for k in range(p.shape[1])]], ["doc_id", *[f"p_{c}" for c in chain.categories]])

    return run


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and p_<category> of every document."""
    storage.small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return texts.mapInArrow(_scores(chain), ", ".join(["doc_id long", *[f"p_{c} double" for c in chain.categories]]))
