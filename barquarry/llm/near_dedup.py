"""MinHash near-dedup by SetSketch registers.

A document's set is its distinct shingles of five words.  Each of 160 registers holds
the truncated, exponentially spaced minimum of one exponential variate per shingle
(SetSketch, Ertl 2021): K = clip(floor(1 - log_b(min / a)), 0, q + 1), b = 1.001.
Registers of unions are maxima of registers, and two registers agree with about the
sets' Jaccard similarity J.

1. Equal sets fall into one class; its least id stands for it.  Copies cost no pairs.
2. 40 bands of 4 registers: at J = 0.75 a pair shares no band with probability 2.5e-7.
3. A bucket's hub is its most central member: the one with the most company in all its
   buckets.  Every other member meets the hub only (a star, never all pairs), and whole
   texts are compared exactly: 100 * intersection >= 75 * union is a link.  A pair that
   meets in buckets of two only is all there is to settle there: it is compared only if the
   maximum-likelihood estimate of J from both sketches is not five standard errors below
   0.75 (missed with probability 3e-7).  In larger buckets the comparison with the hub also
   tells the members' edits, which settle the pairs among them.
4. Two members o and m of a bucket, o not linked with the hub h, can only be linked with
   each other if (i) they share a shingle that h lacks, or (ii) they mostly left out the
   same of h's shingles.  With a, c the numbers of h's shingles that o, m lack and b, e
   those that they add, a link needs 7 * shared edits >= 3 (b + e) + 4 (a + c) - |h|; the
   shared lacking ones are at most min(a, c).  So (i) the members that share an added
   shingle make smaller buckets, which are treated in the same way, and (ii) pairs are
   formed only where 3 (b + e) + 4 (a + c) - |h| <= 7 min(a, c).  Copies of one text with
   random edits share hardly any edit: their refutation takes no pairs.
5. What is open after `stars` such rounds, or is as few as the members themselves, is
   compared pair by pair across components: the maximum-likelihood estimate of J from
   the registers must not be five standard errors below 0.75, then whole texts decide.

Defined results: null text or no words: empty set, linked with nothing; fewer than five
words: the whole sequence is the one shingle; a row without an id gets no component and
stays; rows that share an id are nodes of their own, with the least id reachable from each
(so equal rows that repeat an id all stay); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquarry.llm import storage
from barquarry.llm.components import components
from barquarry.llm.storage import Scratch
from barquarry.llm.words import Words, mix, pieces, words

SHINGLE, BANDS, WIDTH = 5, 40, 4
REGISTERS = BANDS * WIDTH
BASE, RATE, TOP = 1.001, 20.0, 65_534  # b, a and q of the sketch
PERCENT = 75
MEMBERS = 512  # pairs of one hub that one comparison group holds
_FACTORS = np.random.default_rng(77).integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, where each row's begin, one more at the end)."""
    hashes, whole = w.grams(size)
    count = np.diff(w.first)
    parts = [np.zeros(0, np.uint64)]
    sizes = np.zeros(len(count) + 1, np.int64)
    for r, (a, n) in enumerate(zip(w.first[:-1].tolist(), count.tolist())):
        if n >= size:
            own = np.sort(hashes[a : a + n - size + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            own = np.zeros(1, np.uint64)
            for h in w.hash[a : a + n]:
                own = mix(own * np.uint64(0xD1342543DE82EF95) + h + np.uint64(n))
        else:
            continue
        parts.append(own)
        sizes[r + 1] = len(own)
    return np.concatenate(parts), np.cumsum(sizes)


def registers(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of registers for each set; of an empty set all 0."""
    out = np.zeros((len(begin) - 1, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(begin))
    if not len(full):
        return out
    least = np.empty((REGISTERS, len(full)), np.uint64)
    # whole rows at a time, so that the hashes stay in the processor's cache
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(begin[full + 1], begin[full[at]] + 16_384, "right")))
        part = hashes[begin[full[at]] : begin[full[to - 1] + 1]]
        cuts = begin[full[at:to]] - begin[full[at]]
        for j, factor in enumerate(_FACTORS):
            least[j, at:to] = np.minimum.reduceat(part * factor, cuts)
        at = to
    x = -np.log1p(-np.maximum(least.T.astype(np.float64), 0.5) / 2.0**64)
    out[full] = np.clip(np.floor(1 - np.log(x / RATE) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        hashes, begin = shingle_sets(words(piece.column("text"), lower=True))
        n = np.diff(begin)
        keys = np.zeros((len(n), 2), np.uint64)  # 128 bits of the set, whatever its order
        if len(hashes):
            full = n > 0
            for k, salt in enumerate((0x1B873593, 0xCC9E2D51)):
                keys[full, k] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), begin[:-1][full])
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.array(n), pa.array([x.tobytes() for x in keys], pa.binary()), pa.array([x.tobytes() for x in registers(hashes, begin)], pa.binary())],
            ["doc_id", "n_shingles", "set_key", "sketch"],
        )


def likely_jaccard(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood J of pairs from their registers (rows) and set sizes, on a grid of 1/256."""
    above, below = (ka > kb).sum(1)[:, None], (ka < kb).sum(1)[:, None]
    level = ka.shape[1] - above - below
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(np.minimum(u / v, v / u) * (np.arange(257) / 256), 1)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    more, less = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    like = above * np.log(np.maximum(more, tiny)) + below * np.log(np.maximum(less, tiny)) + level * np.log(np.maximum(1 - more - less, tiny))
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def _screen(least: float):
    """mapInArrow function: pairs with sketches to the pairs whose estimate is not below `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ka, kb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ka", "kb"))
            na, nb = (b.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            good = pa.array(likely_jaccard(ka, kb, na, nb) >= least)
            yield b.select(["a", "b"]).filter(good)

    return run


def _compare(with_added: bool):
    """mapInArrow function over (b, salt, a, text) sorted by b, salt, hub first (a null): how a's set stands to b's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, last = None, np.zeros(0, np.uint64), None
        for piece in pieces(batches, "text"):
            hashes, begin = shingle_sets(words(piece.column("text"), lower=True))
            out, added = [], []
            for r, (b, a) in enumerate(zip(piece.column("b").to_pylist(), piece.column("a").to_pylist())):
                if (b, a) == last:  # rows that repeat an id
                    continue
                last = (b, a)
                x = hashes[begin[r] : begin[r + 1]]
                if a is None:
                    hub, own = b, x.copy()
                elif hub == b and len(x) and len(own):
                    same = own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x
                    out.append((a, b, int(same.sum()), len(x), len(own)))
                    added.append(x[~same].view(np.int64) if with_added else np.zeros(0, np.int64))
            if out:
                columns = [pa.array(c, pa.int64()) for c in zip(*out)] + [pa.array(added, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "inter", "na", "nb", "added"])

    return run


def _screened(pairs: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sizes and registers allow a link."""
    one = reps.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("ka"))
    two = reps.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("kb"))
    sized = pairs.join(one, "a").join(two, "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    error = (PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS) ** 0.5
    return scratch.write(sized.mapInArrow(_screen(PERCENT / 100 - 5 * error), "a long, b long"))


def _compared(pairs: DataFrame, docs: DataFrame, scratch: Scratch, with_added: bool) -> DataFrame:
    """Written pairs (a, b, n), b the hub of a bucket of n, as a written table (a, b, inter, na, nb, added, linked).

    A hub's text travels once for about every MEMBERS of its members.  The salt that deals them out follows from the
    bucket's size, which every pair carries: no join or grouping is by hub alone.
    """
    n = storage.partitions(docs.sparkSession)
    text = docs.select("doc_id", "text").hint("merge")  # pairs grow with the input: never broadcast
    salts = F.ceil(F.col("n") / MEMBERS)
    pairs = pairs.select("a", "b", salts.alias("salts"), F.pmod(F.xxhash64("a"), salts).alias("salt"))
    members = pairs.join(text, F.col("a") == F.col("doc_id")).select("b", "salts", "salt", "a", "text")
    groups = pairs.select("b", "salts", "salt").distinct()
    hubs = groups.join(text, F.col("b") == F.col("doc_id")).select("b", "salts", "salt", F.lit(None).cast("long").alias("a"), "text")
    rows = hubs.unionByName(members).repartition(n, "b", "salts", "salt").sortWithinPartitions("b", "salts", "salt", F.col("a").asc_nulls_first())
    out = rows.mapInArrow(_compare(with_added), "a long, b long, inter long, na long, nb long, added array<long>")
    return scratch.write(out.withColumn("linked", F.expr(f"100 * inter >= {PERCENT} * (na + nb - inter)")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stars: int = 3) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable), kept."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    storage.small_batches(docs.sparkSession)
    rows = scratch.write(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, set_key binary, sketch binary"))
    if _repeats(rows):
        # an id names different texts: rows get numbers of their own, which the result translates back
        numbered = scratch.write(docs.withColumn("number", F.monotonically_increasing_id()))
        own = numbered.select(F.col("number").alias("doc_id"), "text").where(numbered["doc_id"].isNotNull())
        rows = scratch.write(own.mapInArrow(_sketch, "doc_id long, n_shingles long, set_key binary, sketch binary"))
        found = scratch.write(_near_dedup(rows, own, scratch, stars, numbered))
        named = numbered.select("number", F.col("doc_id").alias("named")).join(found, F.col("number") == F.col("doc_id"), "left")
        least = named.groupBy("component_id").agg(F.min("named").alias("least"))
        none = F.lit(0).cast("long")
        out = named.drop("doc_id").join(least, "component_id", "left").select(F.col("named").alias("doc_id"), "number", "n_shingles", F.col("least").alias("component_id"))
        bare = docs.where("doc_id is null").mapInArrow(_sketch, "doc_id long, n_shingles long, set_key binary, sketch binary")
        out = out.where("doc_id is not null").select("doc_id", F.coalesce("n_shingles", none).alias("n_shingles"), "component_id")
        out = out.unionByName(bare.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    else:
        out = _near_dedup(rows, docs, scratch, stars)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _near_dedup(rows: DataFrame, docs: DataFrame, scratch: Scratch, stars: int, *keep: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) from sketches (written) and texts of documents whose ids tell them apart."""
    spark = docs.sparkSession
    some = rows.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.write(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    reps = classes.select("rep", "n_shingles", "sketch")
    size = 2 * WIDTH
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sketch, i * {size} + 1, {size})))")
    bands = reps.select("rep", F.explode(keys).alias("key"))

    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = scratch.write(bands.join(shared, "key").select("key", "rep", "n"))  # members of buckets that hold two or more
    storage.release(spark)
    checked = rest = labels = None
    for star in range(stars + 1):
        stars_rows = scratch.write(_hubs(buckets))  # key, rep, hub, n
        pairs = stars_rows.where("rep != hub").groupBy(F.col("rep").alias("a"), F.col("hub").alias("b")).agg(F.max("n").alias("n"))
        todo = scratch.write(pairs if checked is None else pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti"))
        alone = _screened(todo.where("n = 2").select("a", "b"), reps, scratch)
        new = _compared(todo.where("n > 2").unionByName(alone.withColumn("n", F.lit(2).cast("long"))), docs, scratch, True)
        checked = new if checked is None else checked.unionByName(new)
        scratch.remove(todo, alone, *([] if labels is None else [labels]))
        labels = components(_links(checked), scratch)
        storage.release(spark)
        family = scratch.write(_families(pairs, checked, labels))
        bare = scratch.write(_left_out(stars_rows, family))
        rest = bare if rest is None else rest.unionByName(bare)
        sharing = scratch.write(_sharing(family))
        scratch.remove(stars_rows, family, buckets)  # what is small is on disk; nothing reads these again
        buckets = sharing
        storage.release(spark)
        members, across = _sizes(buckets.join(labels, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("label", "rep").alias("label")))
        if star == stars or across <= 8 * members:
            break
    rest = rest.unionByName(_across(buckets, labels)).distinct()
    for way in (("a", "b"), ("b", "a")):
        rest = rest.join(checked.select(F.col("a").alias(way[0]), F.col("b").alias(way[1])), ["a", "b"], "left_anti")
    screened = _screened(rest, reps, scratch)
    if not screened.isEmpty():
        sized = Window.partitionBy("b", F.pmod(F.xxhash64("a"), F.lit(64)))  # pairs of one b, at most 64 times as many
        counted = screened.withColumn("n", 64 * F.count(F.lit(1)).over(sized))
        links = _links(checked).unionByName(_links(_compared(counted, docs, scratch, False)))
        labels = components(links, scratch)
    storage.release(spark)
    ids = classes.select("set_key", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("label", "rep").alias("label"))
    # a document with an id but without words stands alone
    out = rows.select("doc_id", "n_shingles", "set_key").join(ids, "set_key", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("label")).otherwise(F.col("doc_id"))
    scratch.only(rows, classes, labels, docs, *keep)
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def _repeats(rows: DataFrame) -> bool:
    """Whether one id names two different sets."""
    some = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y"))
    return not some.where("x != y").isEmpty()


def _links(checked: DataFrame) -> DataFrame:
    return checked.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _hubs(buckets: DataFrame) -> DataFrame:
    """(key, rep, n) to (key, rep, hub, n): the member with the most company in all its buckets, the least of equals."""
    company = buckets.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("company"))
    best = buckets.join(company, "rep").groupBy("key").agg(F.max(F.struct("company", (-F.col("rep")).alias("minus"))).alias("best"))
    return buckets.join(best.select("key", (-F.col("best.minus")).alias("hub")), "key").select("key", "rep", "hub", "n")


def _families(pairs: DataFrame, checked: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (hub, rep, label, linked, lacks, adds, whole, added) of hubs that some member is not linked with."""
    all_of = pairs.join(checked, ["a", "b"])
    some = all_of.where("not linked").select("b").distinct()
    all_of = all_of.join(some, "b").join(labels, F.col("a") == F.col("node"), "left")
    return all_of.select(F.col("b").alias("hub"), F.col("a").alias("rep"), F.coalesce("label", "a").alias("label"), "linked", (F.col("nb") - F.col("inter")).alias("lacks"), (F.col("na") - F.col("inter")).alias("adds"), F.col("nb").alias("whole"), "added")


def _left_out(rows: DataFrame, family: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket that may be linked although they share no added shingle: both lack much of the hub's."""
    own = family.select("hub", "rep", "label", "linked", "lacks", "adds", "whole")
    own = own.withColumn("over", F.expr("4 * lacks + 3 * adds - whole")).withColumn("spare", F.expr("3 * (lacks - adds)"))
    both = rows.join(own, ["hub", "rep"])
    most = both.groupBy("key").agg(F.max("spare").alias("most")).where("most > 0")
    # an unlinked member goes on only if some member of the bucket can make up for what it is over
    outer = both.where("not linked").join(most, "key").where("over <= most").select("key", F.col("rep").alias("a"), F.col("label").alias("la"), F.col("lacks").alias("xa"), F.col("over").alias("oa"))
    inner = both.where("spare > 0").select("key", F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("lacks").alias("xb"), F.expr("4 * lacks + 3 * adds").alias("ob"))
    return outer.join(inner, "key").where("a != b and la != lb and oa + ob <= 7 * least(xa, xb)").select("a", "b").distinct()


def _sharing(family: DataFrame) -> DataFrame:
    """(key, rep, n, rest, lacks, adds, whole): the members that share an added shingle, where not all are linked with the hub.

    A link needs an intersection of three quarters of either set, and at most whole - lacks of a member's shingles
    are the hub's: so it shares at least (3 adds + lacks - whole) / 4 of its added shingles.  Two sets that share
    that many share one among the rarest of each, all but the last that many less one (prefix filter); what many
    members of a family have in common, such as a passage that the hub lacks, is at the far end of that order.
    rest is how many of a member's shared ones follow in that order: two members whose first common shingle this
    is share at most one more than the lesser rest.
    """
    rows = family.select("hub", "rep", "linked", F.expr("adds - greatest(1, ceil((3 * adds + lacks - whole) / 4)) + 1").alias("prefix"), "lacks", "adds", "whole", F.explode("added").alias("shingle"))
    rows = rows.withColumn("key", F.xxhash64("hub", "shingle"))
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    rows = rows.join(often, "key")
    own = Window.partitionBy("hub", "rep")
    rows = rows.withColumn("at", F.row_number().over(own.orderBy("often", "shingle"))).withColumn("common", F.count(F.lit(1)).over(own))
    rows = rows.where("at <= prefix - (adds - common)").select("key", "rep", "linked", (F.col("common") - F.col("at")).alias("rest"), "lacks", "adds", "whole")  # those that occur once come first
    kept = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_and("linked").alias("all_linked")).where("n > 1 and not all_linked")
    return rows.join(kept, "key").select("key", "rep", "n", "rest", "lacks", "adds", "whole").distinct()


def _sizes(rows: DataFrame) -> tuple[int, float]:
    """(members of buckets, pairs of them that lie in different components)."""
    by = rows.groupBy("key", "label").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    n, pairs = by.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0.0))).first()
    return int(n), pairs


def _across(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's members that lie in different components, if their sizes, edits and rests allow a link.

    A pair meets in every bucket of a shingle they share.  In the first of them the rests bound what they share; later
    ones have lesser rests.  So a link passes in its first bucket, and a pair that fails there fails in all.
    """
    named = buckets.join(labels, F.col("rep") == F.col("node"), "left").withColumn("size", F.expr("whole - lacks + adds"))
    named = named.select("key", F.col("rep").alias("a"), F.coalesce("label", "rep").alias("la"), F.col("lacks").alias("xa"), F.col("adds").alias("ya"), F.col("size").alias("na"), F.col("rest").alias("ra"), "whole")
    other = named.select("key", F.col("a").alias("b"), F.col("la").alias("lb"), F.col("xa").alias("xb"), F.col("ya").alias("yb"), F.col("na").alias("nb"), F.col("ra").alias("rb"))
    sizes = f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"
    edits = "3 * (ya + yb) + 4 * (xa + xb) - whole <= 7 * (least(xa, xb) + least(ra, rb) + 1)"
    return named.join(other, "key").where(f"a > b and la != lb and {sizes} and {edits}").select("a", "b").distinct()
