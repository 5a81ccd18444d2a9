"""Volume profiles: bins, spread, point of control, value area, shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquarry.operators import indicators as ind
from barquarry.sources.bars import valid


def bins(bars: DataFrame, mode: str = "count", n_bins: int = 100, bin_size: float | None = None) -> DataFrame:
    """One row per symbol: lo, size, n. mode: count (n_bins of equal size), size (bin_size each) or auto (a quarter of the ATR)."""
    keep = valid(bars)
    edge = keep.groupBy("symbol").agg(F.min("low").alias("lo0"), F.max("high").alias("hi0"))
    pad = F.when(F.col("hi0") <= F.col("lo0"), F.abs("lo0") * 1e-6 + 1e-9).otherwise(0.0)
    edge = edge.select("symbol", (F.col("lo0") - pad).alias("lo"), (F.col("hi0") + pad).alias("hi"))
    if mode == "count":
        return edge.select("symbol", "lo", ((F.col("hi") - F.col("lo")) / n_bins).alias("size"), F.lit(n_bins).alias("n"))
    if mode == "size":
        n = F.greatest(F.ceil((F.col("hi") - F.col("lo")) / bin_size), F.lit(1))
        n = n + F.when(F.col("lo") + bin_size * n < F.col("hi"), 1).otherwise(0)
        return edge.select("symbol", "lo", F.lit(float(bin_size)).alias("size"), n.cast("int").alias("n"))
    recent = Window.partitionBy("symbol").orderBy(F.col("bar_no").desc())
    tr = ind.with_true_range(keep).withColumn("nth", F.row_number().over(recent)).where("nth <= 14")
    atr = tr.groupBy("symbol").agg(F.avg("tr").alias("atr"))
    n = F.when(F.col("atr") > 0, F.greatest(F.lit(20.0), F.least(F.lit(500.0), F.bround((F.col("hi") - F.col("lo")) / (0.25 * F.col("atr")))))).otherwise(float(n_bins)).cast("int")
    return edge.join(atr, "symbol").withColumn("n", n).select("symbol", "lo", ((F.col("hi") - F.col("lo")) / F.col("n")).alias("size"), "n")


def spread(bars: DataFrame, edges: DataFrame, weight: str = "volume", how: str = "uniform", flat: float = 0.0) -> DataFrame:
    """(symbol, bin, amount): each bar's weight over the bins it overlaps, or at its typical price.

    Only overlapped bins are made; sums are combined before the shuffle on (symbol, bin).
    """
    rows = valid(bars).join(edges, "symbol")
    top = F.col("n") - 1

    def at(price):
        return F.least(top, F.greatest(F.lit(0), F.floor((price - F.col("lo")) / F.col("size")).cast("int")))

    h, lo, w = F.col("high"), F.col("low"), F.col(weight)
    if how == "typical":
        out = rows.select("symbol", at((h + lo + F.col("close")) / 3).alias("bin"), w.alias("amount"))
    else:
        thin = h - lo <= flat
        rows = rows.withColumn("bin", F.explode(F.when(thin, F.array(at(lo))).otherwise(F.sequence(at(lo), at(h)))))
        left, right = F.col("lo") + F.col("bin") * F.col("size"), F.col("lo") + (F.col("bin") + 1) * F.col("size")
        share = F.greatest(F.lit(0.0), F.least(h, right) - F.greatest(lo, left)) / (h - lo)
        out = rows.select("symbol", "bin", F.when(thin, w).otherwise(w * share).alias("amount"))
    return out.groupBy("symbol", "bin").agg(F.sum("amount").alias("amount"))


def histogram(bars: DataFrame, edges: DataFrame, weight: str = "volume", how: str = "uniform") -> DataFrame:
    """(symbol, bin, price, volume) with a row for every bin; price is the bin's centre."""
    every = edges.select("symbol", "lo", "size", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"))
    got = spread(bars, edges, weight, how)
    out = every.join(got, ["symbol", "bin"], "left")
    return out.select("symbol", "bin", (F.col("lo") + (F.col("bin") + 0.5) * F.col("size")).alias("price"), F.coalesce("amount", F.lit(0.0)).alias("volume"))


def point_of_control(hist: DataFrame) -> DataFrame:
    """The first bin of greatest volume (compared to 6 places) of each symbol: symbol, poc_bin, poc."""
    best = F.min(F.struct((-F.round("volume", 6)).alias("v"), "bin", "price")).alias("b")
    return hist.groupBy("symbol").agg(best).select("symbol", F.col("b.bin").alias("poc_bin"), F.col("b.price").alias("poc"))


def value_area(hist: DataFrame, share: float = 0.70) -> DataFrame:
    """From the point of control outwards by pairs of bins, the heavier side first (ties up), until `share` is inside.

    A fold over one array per symbol: symbol, poc_bin, val_bin, vah_bin, inside, total.
    """
    rows = hist.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("bin", F.round("volume", 6).alias("v")))).alias("b"))
    rows = rows.select("symbol", F.transform("b", lambda x: x["v"]).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    poc = (F.array_position("v", F.array_max("v")) - 1).cast("int")
    rows = rows.withColumns({"total": total, "poc_bin": poc, "n": F.size("v")})
    state = "named_struct('a', poc_bin, 'z', poc_bin, 'inside', v[poc_bin])"
    up = "(if(s.z + 1 < n, v[s.z + 1], 0D) + if(s.z + 2 < n, v[s.z + 2], 0D))"
    down = "(if(s.a >= 1, v[s.a - 1], 0D) + if(s.a >= 2, v[s.a - 2], 0D))"
    step = f"""CASE WHEN s.inside >= {share} * total OR (s.a = 0 AND s.z = n - 1) THEN s
      WHEN s.z < n - 1 AND (s.a = 0 OR {up} >= {down}) THEN named_struct('a', s.a, 'z', least(n - 1, s.z + 2), 'inside', s.inside + {up})
      ELSE named_struct('a', greatest(0, s.a - 2), 'z', s.z, 'inside', s.inside + {down}) END"""
    rows = rows.withColumn("s", F.expr(f"aggregate(sequence(1, n), {state}, (s, i) -> {step})"))
    return rows.select("symbol", "poc_bin", F.col("s.a").alias("val_bin"), F.col("s.z").alias("vah_bin"), F.round("s.inside", 4).alias("inside"), F.round("total", 4).alias("total"))


def flagged(hist: DataFrame, area: DataFrame) -> DataFrame:
    """The histogram with volume_pct, in_value_area and is_poc."""
    rows = hist.join(area.select("symbol", "poc_bin", "val_bin", "vah_bin", "total"), "symbol")
    return rows.select("symbol", "bin", "price", "volume", (F.col("volume") / F.col("total")).alias("volume_pct"), F.col("bin").between(F.col("val_bin"), F.col("vah_bin")).alias("in_value_area"), (F.col("bin") == F.col("poc_bin")).alias("is_poc"))


def moments(hist: DataFrame) -> DataFrame:
    """Volume-weighted mean, sd, skew and Pearson kurtosis of price; a spike gives (mean, 0, 0, 3)."""
    w = F.col("volume")
    first = hist.groupBy("symbol").agg((F.sum(w * F.col("price")) / F.sum(w)).alias("mean"), F.sum(w).alias("w"))
    d = F.col("price") - F.col("mean")
    two = hist.join(first, "symbol").groupBy("symbol").agg(F.first("mean").alias("mean"), *[(F.sum(w * F.pow(d, F.lit(k))) / F.sum(w)).alias(f"m{k}") for k in (2, 3, 4)])
    sd = F.sqrt("m2")
    spike = F.col("m2") <= 1e-18
    return two.select("symbol", "mean", F.when(spike, 0.0).otherwise(sd).alias("sd"), F.when(spike, 0.0).otherwise(F.col("m3") / (sd * sd * sd)).alias("skew"), F.when(spike, 3.0).otherwise(F.col("m4") / (F.col("m2") * F.col("m2"))).alias("kurtosis"))


def ledges(hist: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Bins whose volume jumps from the bin below by more than `sigmas` standard deviations of all such jumps."""
    by = Window.partitionBy("symbol").orderBy("bin")
    d = hist.withColumn("jump", F.col("volume") - F.lag("volume").over(by)).where("jump is not null")
    sd = d.groupBy("symbol").agg(F.stddev_pop("jump").alias("sd"), F.count(F.lit(1)).alias("k"))
    return d.join(sd, "symbol").where((F.abs("jump") > sigmas * F.col("sd")) & (F.col("k") >= 3)).select("symbol", "bin", "jump")


def poor_extremes(hist: DataFrame, share: float = 0.02) -> DataFrame:
    """poor_high and poor_low: the outermost bins hold more than half of the mean bin."""
    n = hist.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("volume").alias("mean"))
    k = F.greatest(F.lit(1.0), F.bround(share * F.col("n")))
    rows = hist.join(n, "symbol").withColumn("k", k)
    out = rows.groupBy("symbol").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.avg(F.when(F.col("bin") >= F.col("n") - F.col("k"), F.col("volume"))).alias("top"), F.avg(F.when(F.col("bin") < F.col("k"), F.col("volume"))).alias("low"))
    enough = F.col("n") >= 5
    return out.select("symbol", (enough & (F.col("top") > 0.5 * F.col("mean"))).alias("poor_high"), (enough & (F.col("low") > 0.5 * F.col("mean"))).alias("poor_low"))


def delta_stats(bars: DataFrame, edges: DataFrame, poc: DataFrame) -> DataFrame:
    """Net synthetic delta over all bins and at the point of control, as shares of volume clipped to 1."""
    signed = valid(bars).withColumn("delta", F.col("volume") * ind.close_location())
    d = spread(signed, edges, "delta", flat=1e-12).withColumnRenamed("amount", "delta")
    v = spread(bars, edges).withColumnRenamed("amount", "volume")
    both = v.join(d, ["symbol", "bin"]).join(poc, "symbol")

    def clip(x):
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))

    at = F.col("bin") == F.col("poc_bin")
    agg = both.groupBy("symbol").agg(F.sum("delta").alias("d"), F.sum("volume").alias("v"), F.sum(F.when(at, F.col("delta"))).alias("pd"), F.sum(F.when(at, F.col("volume"))).alias("pv"))
    return agg.select("symbol", clip(F.try_divide("d", "v")).alias("net_delta"), clip(F.try_divide("pd", "pv")).alias("poc_delta"))


def decayed_poc(bars: DataFrame, edges: DataFrame, half_life: float = 21.0) -> DataFrame:
    """Point of control under weights that halve every `half_life` bars."""
    end = bars.groupBy("symbol").agg(F.max("bar_no").alias("end"))
    aged = bars.join(end, "symbol").withColumn("aged", F.col("volume") * F.pow(F.lit(0.5), (F.col("end") - F.col("bar_no")) / half_life)).drop("end")
    return point_of_control(histogram(aged, edges, "aged"))
