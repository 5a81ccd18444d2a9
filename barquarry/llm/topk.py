"""Exact top-k by inner product, with block-at-a-time pruning.

Components are terms, integer weights their impacts.  Documents are ordered so that
neighbours are alike (by the best of 64 pivots, then id) and cut into range blocks of 256
with the least and greatest weight of each term.  A query's bound for a block sums, term
by term, the larger of weight * least and weight * greatest; no document of the block can
score more.  Blocks are visited by falling bound and scored through their forward index
(the matrix of the block's vectors), until the bound falls below the query's kth score.

Blocks travel in packs of 16; the packs' bounds are all that the driver holds.  A first
pass scores each query in its most promising pack, which gives it a threshold; in the
second it meets only packs whose bound reaches that threshold.  Candidates are merged by
score and id.  A query meets packs in blocks of queries, so neither side is gathered.

Defined results: vectors that are null, or hold a null or non-finite component, take no
part; a shorter vector counts as filled up with zeros; rows with the query's id
are not its answers; fewer than k candidates give fewer rows.  Components are stored in 32
bits, or in 64 if the greatest does not fit; then, and where a score could pass 2**62, blocks
are computed with Python's integers.  A component or a candidate's score beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquarry.llm import storage
from barquarry.llm.storage import Scratch

SCALE, K = 1024, 10
PIVOTS, BLOCK, PACK = 64, 256, 16
QUERIES = 256  # queries that travel together


def usable(vec: Column) -> Column:
    """Not null, without null or non-finite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _kind(low: int, high: int) -> str:
    """The integers that hold components from low to high. What Spark's floor cut to 64 bits is refused."""
    if low <= -(1 << 63) or high >= (1 << 63) - 1:
        raise ValueError("components beyond 64 bits")
    return "<i4" if -(1 << 31) <= low and high < 1 << 31 else "<i8"


def _exact(m: np.ndarray) -> np.ndarray:
    """Integers whose products and sums do not wrap: Python's own if the greatest component asks for them."""
    most = max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0
    return m.astype(object if most >= 1 << 31 or m.shape[-1] * most * most >= 1 << 62 else np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers of `width` components; shorter rows end in zeros."""
    size = np.asarray(pc.list_value_length(column)) if len(column) else np.zeros(0, int)
    out = np.zeros((len(column), width), np.int64)
    flat = np.asarray(column.flatten())
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def _nearest(pivots: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                best = (_matrix(b.column("vec"), width) @ pivots.T).argmax(1) if len(pivots) else np.zeros(b.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), pa.array(best.astype(np.int32))], ["vec_id", "vec", "pivot"])

    return run


def _packs(width: int, block: int, pack: int, kind: str):
    """Sorted rows of a partition to packs: ids, rows of integers, and per block its terms' least and greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, n = [], [], 0

        def emit(i: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            low = np.stack([m[a : a + block].min(0) for a in range(0, len(m), block)])
            high = np.stack([m[a : a + block].max(0) for a in range(0, len(m), block)])
            cells = [c.astype("<i8") if c is i else c.astype(kind) for c in (i, m, low, high, low.min(0), high.max(0))]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["ids", "rows", "low", "high", "least", "most"])

        for b in batches:
            ids.append(b.column("vec_id").to_numpy())
            rows.append(_matrix(b.column("vec"), width))
            n += b.num_rows
            while n >= block * pack:
                i, m = np.concatenate(ids), np.concatenate(rows)
                yield emit(i[: block * pack], m[: block * pack])
                ids, rows, n = [i[block * pack :]], [m[block * pack :]], n - block * pack
        if n:
            yield emit(np.concatenate(ids), np.concatenate(rows))

    return run


def _bound(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sum over terms of the most that a weight between low and high can add: (queries, blocks)."""
    if object in (q.dtype, high.dtype, low.dtype):
        q, low, high = (x.astype(object) for x in (q, low, high))
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def _route(width: int, numbers: np.ndarray, low: np.ndarray, high: np.ndarray, first: bool, kind: str):
    """Queries (vec_id, vec, limit) to the packs that they must meet, in blocks. first: the most promising pack only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, QUERIES):
                part = b.slice(at, QUERIES)
                q = _matrix(part.column("vec"), width)
                exact = _exact(q)
                bound = _bound(exact, low, high)
                ids = part.column("vec_id").to_numpy()
                limit = part.column("limit").to_numpy()
                if first:
                    meet = np.arange(len(numbers))[None, :] == bound.argmax(1)[:, None]
                else:
                    done = part.column("seen").to_numpy()
                    meet = (bound >= limit[:, None]) & (numbers[None, :] != done[:, None])
                out = [(int(numbers[p]), ids[s].astype("<i8").tobytes(), q[s].astype(kind).tobytes(), limit[s].astype("<i8").tobytes()) for p in range(len(numbers)) if (s := np.flatnonzero(meet[:, p])).size]
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["pack", "q_ids", "q", "limits"])

    return run


def _search(width: int, k: int, block: int, kind: str):
    """(pack, blocks of queries) to each query's best k of the pack, none below its limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q = _exact(np.frombuffer(r["q"], kind).reshape(-1, width))
                q_ids, kth = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["limits"], "<i8").copy()
                rows = _exact(np.frombuffer(r["rows"], kind).reshape(-1, width))
                ids = np.frombuffer(r["ids"], "<i8")
                low, high = (_exact(np.frombuffer(r[c], kind).reshape(-1, width)) for c in ("low", "high"))
                bound = _bound(q, low, high)
                visit = np.argsort(-bound, 1, kind="stable")
                best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
                live = np.arange(len(q))
                for turn in range(len(low)):
                    live = live[bound[live, visit[live, turn]] >= kth[live]]  # bounds only fall: the others are done
                    if not len(live):
                        break
                    for n in np.unique(visit[live, turn]):
                        who = live[visit[live, turn] == n]
                        some = slice(n * block, (n + 1) * block)
                        score = q[who] @ rows[some].T
                        for i, s in zip(who, score):
                            good = (s >= kth[i]) & (ids[some] != q_ids[i])
                            if not good.any():
                                continue
                            s, own = np.concatenate([best[i][0], s[good].astype(np.int64)]), np.concatenate([best[i][1], ids[some][good]])
                            top = np.lexsort((own, -s))[:k]
                            best[i] = (s[top], own[top])
                            if len(top) == k:
                                kth[i] = max(kth[i], s[top[-1]])
                out = [(r["pack"], q_ids[i], d, s) for i in range(len(q)) for s, d in zip(*best[i])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["pack", "query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k best rows of every query row: query_id, rank, vec_id, score. Components become floor(scale * x)."""
    spark = vectors.sparkSession
    storage.small_batches(spark, 1000)
    scratch = Scratch(spark, "topk")
    whole = F.transform(F.col(f"`{vec_col}`"), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(usable(F.col(f"`{vec_col}`")) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole.alias("vec"), is_query.alias("asks"))
    width, least, most = rows.agg(F.max(F.size("vec")), F.min(F.array_min("vec")), F.max(F.array_max("vec"))).first()
    width = width or 1
    kind = _kind(least or 0, most or 0)
    # a bounded sample of pivots: it decides the order of documents, not the result
    pivots = rows.select("vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    pivots = np.array([r["vec"] + [0] * (width - len(r["vec"])) for r in pivots], np.int64).reshape(-1, width)
    near = rows.select("vec_id", "vec").mapInArrow(_nearest(pivots, width), "vec_id long, vec array<long>, pivot int")
    ranged = near.repartitionByRange(storage.partitions(spark), "pivot", "vec_id").sortWithinPartitions("pivot", "vec_id")
    packs = ranged.mapInArrow(_packs(width, BLOCK, PACK, kind), "ids binary, rows binary, low binary, high binary, least binary, most binary")
    packs = scratch.write(packs.withColumn("pack", F.monotonically_increasing_id()))
    ends = packs.select("pack", "least", "most").collect()  # a row for 4096 vectors
    schema = "pack long, query_id long, vec_id long, score long"
    if not ends:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    numbers = np.array([r["pack"] for r in ends], np.int64)
    low, high = (_exact(np.stack([np.frombuffer(r[c], kind) for r in ends])) for c in ("least", "most"))
    none = -(1 << 63)
    queries = scratch.write(rows.where("asks").select("vec_id", "vec").distinct().withColumn("limit", F.lit(none).cast("long")))
    blocks = "pack long, q_ids binary, q binary, limits binary"

    def met(asked: DataFrame, first: bool) -> DataFrame:
        met = asked.mapInArrow(_route(width, numbers, low, high, first, kind), blocks).join(packs.drop("least", "most"), "pack")
        return met.mapInArrow(_search(width, k, BLOCK, kind), schema)

    storage.small_batches(spark, 32)  # a pack is a megabyte
    one = scratch.write(met(queries, True))
    limit = one.groupBy("query_id").agg(F.max("pack").alias("seen"), F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    limit = limit.select("query_id", "seen", F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(none)).alias("limit"))
    again = queries.drop("limit").join(limit, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "vec", F.coalesce("limit", F.lit(none)).alias("limit"), F.coalesce("seen", F.lit(-1).cast("long")).alias("seen"))
    two = scratch.write(met(again, False))
    storage.small_batches(spark)
    scratch.only(one, two)
    both = one.unionByName(two)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
