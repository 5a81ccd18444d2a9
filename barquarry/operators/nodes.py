"""Nodes and shape of a volume profile: peaks and valleys of the smoothed histogram.

A histogram is one array per symbol (at most a few hundred bins), so peaks are found by
array functions on a row and nothing but the histogram's own grouping is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquarry.operators import profile

RADIUS = 4


def weights(sigma: float = 1.0) -> list[float]:
    """A Gaussian kernel over RADIUS bins to either side."""
    w = [math.exp(-((k / sigma) ** 2) / 2) for k in range(-RADIUS, RADIUS + 1)]
    return [x / sum(w) for x in w]


def arrays(hist: DataFrame) -> DataFrame:
    """One row per symbol: v (volumes), price (bin centres), n, s (v smoothed, the ends mirrored), top (the largest s)."""
    rows = hist.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("bin", F.round("volume", 6).alias("v"), "price"))).alias("b"))
    rows = rows.select("symbol", F.col("b.v").alias("v"), F.col("b.price").alias("price"), F.size("b").alias("n"))
    w = ", ".join(f"{x!r}D" for x in weights())
    at = "pmod(i + k, 2 * n)"
    value = f"get(v, if({at} < n, {at}, 2 * n - 1 - {at}))"
    smooth = f"transform(sequence(0, n - 1), i -> round(aggregate(sequence(-{RADIUS}, {RADIUS}), 0D, (a, k) -> a + get(array({w}), k + {RADIUS}) * {value}), 6))"
    return rows.withColumn("s", F.expr(smooth)).withColumn("top", F.array_max("s"))


def peaks(rows: DataFrame, signal: str, share: float) -> DataFrame:
    """(symbol, bin) of the signal's local maxima whose prominence is at least share * top.

    A flat top counts once, at its middle; the ends are no maxima.
    """
    # flat tops begin where the signal has just risen and end before the next other value
    out = rows.where("n >= 3").withColumn("x", F.expr(signal))
    out = out.withColumn("i", F.explode(F.expr("filter(sequence(1, n - 2), i -> get(x, i - 1) < get(x, i) and get(x, i + 1) <= get(x, i))")))
    out = out.withColumn("h", F.expr("get(x, i)")).withColumn("j", F.expr("array_min(filter(sequence(i + 1, n - 1), j -> get(x, j) != h))"))
    out = out.where("get(x, j) < h").withColumn("bin", F.expr("cast((i + j - 1) div 2 as int)"))
    # how far the signal falls on either side before it rises above the peak
    left = F.expr("coalesce(array_max(filter(sequence(0, i - 1), k -> get(x, k) > h)), -1)")
    right = F.expr("coalesce(array_min(filter(sequence(j, n - 1), k -> get(x, k) > h)), n)")
    out = out.withColumn("l", left).withColumn("r", right)
    base = F.expr("greatest(array_min(slice(x, l + 2, bin - l)), array_min(slice(x, bin + 1, r - bin)))")
    return out.where(F.round(F.col("h") - base, 6) >= F.round(share * F.col("top"), 6)).select("symbol", "bin")


def nodes(hist: DataFrame, prominence: float = 0.10, max_nodes: int = 5) -> DataFrame:
    """(symbol, kind, rank, bin, price, volume, volume_pct): HVN heaviest first, the point of control always, LVN emptiest first.

    At most `max_nodes` of a kind.  Fewer than three bins: the point of control alone; fewer than five: no LVN.
    """
    rows = arrays(hist)
    heaviest = rows.where("top > 0 or n < 3").select("symbol", (F.array_position("v", F.array_max("v")) - 1).cast("int").alias("bin"))
    high = peaks(rows, "s", prominence).unionByName(heaviest).distinct().withColumn("kind", F.lit("HVN"))
    low = peaks(rows.where("n >= 5"), "transform(s, y -> round(top - y, 6))", prominence).withColumn("kind", F.lit("LVN"))
    own = rows.select("symbol", "v", "price", F.expr("aggregate(v, 0D, (a, y) -> a + y)").alias("total"))
    out = high.unionByName(low).join(own, "symbol").select("symbol", "kind", "bin", F.expr("get(price, bin)").alias("price"), F.expr("get(v, bin)").alias("volume"), "total")
    order = F.when(F.col("kind") == "HVN", -F.col("volume")).otherwise(F.col("volume"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("symbol", "kind").orderBy(order, "bin"))).where(F.col("rank") <= max_nodes)
    return out.select("symbol", "kind", "rank", "bin", "price", "volume", (100 * F.try_divide("volume", "total")).alias("volume_pct"))


def nearest_node(found: DataFrame, prices: DataFrame) -> DataFrame:
    """The node nearest to each (symbol, x), of each kind and of either: ties go to HVN, then to the better rank."""
    both = prices.join(found, "symbol")
    far = F.round(F.abs(F.col("price") - F.col("x")), 9)
    one = F.struct(far.alias("d"), "kind", "rank", "price")
    out = both.groupBy("symbol", "x").agg(F.min(one).alias("any"), F.min(F.when(F.col("kind") == "HVN", one)).alias("high"), F.min(F.when(F.col("kind") == "LVN", one)).alias("low"))
    return out.select("symbol", "x", F.col("any.kind").alias("kind"), F.col("any.price").alias("price"), F.col("high.price").alias("hvn"), F.col("low.price").alias("lvn"))


def with_nodes(table: DataFrame, found: DataFrame) -> DataFrame:
    """A flagged histogram with is_hvn and is_lvn."""
    marks = found.groupBy("symbol", "bin").agg(F.bool_or(F.col("kind") == "HVN").alias("is_hvn"), F.bool_or(F.col("kind") == "LVN").alias("is_lvn"))
    return table.join(marks, ["symbol", "bin"], "left").fillna(False, ["is_hvn", "is_lvn"])


def levels(hist: DataFrame, edges: DataFrame, area: DataFrame) -> DataFrame:
    """(symbol, poc, val, vah, width, bin_size, poc_location, compression): bin centres, width over poc, poc's place in the range."""
    out = area.join(edges, "symbol")

    def centre(bin):
        return F.col("lo") + (F.col(bin) + 0.5) * F.col("size")

    out = out.select("symbol", centre("poc_bin").alias("poc"), centre("val_bin").alias("val"), centre("vah_bin").alias("vah"), F.col("size").alias("bin_size"), "lo", (F.col("lo") + F.col("n") * F.col("size")).alias("hi"))
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("hi") > F.col("lo"), (F.col("poc") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)))
    width = F.col("vah") - F.col("val")
    return out.select("symbol", "poc", "val", "vah", width.alias("width"), "bin_size", place.alias("poc_location"), F.try_divide(width, F.abs("poc")).alias("compression"))


#: The codes of shapes.
UNKNOWN, TOP_HEAVY, BOTTOM_HEAVY, BALANCED, DOUBLE = 0, 1, 2, 3, 4


def shape(hist: DataFrame, places: DataFrame, prominence: float = 0.15, valley: float = 0.20, skewed: float = 0.5) -> DataFrame:
    """(symbol, n_peaks, is_double, valley_ratio, shape).

    Double: exactly two peaks with a bin between them under `valley` of the mean bin.  Else a heavy top with
    negative skew, a heavy bottom with positive skew, balanced without skew, or unknown.
    """
    rows = arrays(hist)
    own = rows.select("symbol", "v", F.expr("aggregate(v, 0D, (a, y) -> a + y) / n").alias("mean"))
    found = peaks(rows, "s", prominence).join(rows.select("symbol", "v"), "symbol")
    pair = F.sort_array(F.collect_list(F.struct(F.expr("get(v, bin)").alias("w"), "bin")), asc=False)
    found = found.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_peaks"), pair.alias("p"))
    found = found.select("symbol", "n_peaks", F.expr("least(get(p, 0).bin, get(p, 1).bin)").alias("a"), F.expr("greatest(get(p, 0).bin, get(p, 1).bin)").alias("z"))
    out = own.join(found, "symbol", "left").join(profile.moments(hist).select("symbol", "skew"), "symbol").join(places.select("symbol", "poc_location"), "symbol")
    ratio = F.when((F.col("n_peaks") >= 2) & (F.col("mean") > 1e-12), F.expr("array_min(slice(v, a + 1, z - a + 1)) / mean")).otherwise(1.0)
    out = out.withColumn("n_peaks", F.coalesce("n_peaks", F.lit(0))).withColumn("valley_ratio", ratio).withColumn("is_double", (F.col("n_peaks") == 2) & (ratio < valley))
    code = F.when(F.col("is_double"), DOUBLE).when((F.col("skew") < -skewed) & (F.col("poc_location") > 0.7), TOP_HEAVY)
    code = code.when((F.col("skew") > skewed) & (F.col("poc_location") < 0.3), BOTTOM_HEAVY).when(F.abs("skew") < skewed, BALANCED).otherwise(UNKNOWN)
    return out.select("symbol", "n_peaks", "is_double", "valley_ratio", code.alias("shape"))
