"""Quiet phases and volume patterns: per-bar flags, then runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquarry.operators import indicators as ind
from barquarry.operators.indicators import in_order


def quiet_frame(bars: DataFrame, window: int = 20, baseline: int = 100, threshold: float = 60.0) -> DataFrame:
    """Volatility, volume and range of each bar, ranked over the baseline; quiet_score = 100 * mean(1 - rank)."""
    out = ind.with_atr_wilder(bars)
    out = out.withColumn("volume_ma", ind.mean(F.col("volume"), window, window // 2)).withColumn("bandwidth", ind.bandwidth(F.col("close"), window))
    for c, name in (("atr", "atr_rank"), ("volume_ma", "volume_rank"), ("bandwidth", "range_rank")):
        out = out.withColumn(name, ind.percentile_rank(F.col(c), baseline, baseline // 4))
    score = 100 * ((1 - F.col("atr_rank")) + (1 - F.col("volume_rank")) + (1 - F.col("range_rank"))) / 3
    out = out.withColumn("quiet_score", score).withColumn("is_quiet", F.coalesce(score >= threshold, F.lit(False)))
    return out.withColumn("volume_falling", F.coalesce(ind.falling(F.col("volume_ma"), window), F.lit(False)))


def latest(frame: DataFrame) -> DataFrame:
    """Each symbol's last bar."""
    last = frame.groupBy("symbol").agg(F.max("bar_no").alias("bar_no"))
    return frame.join(last, ["symbol", "bar_no"])


def _events(flagged: DataFrame, least: int, order, kind, direction, strength) -> DataFrame:
    """Runs of `flag` of at least `least` bars as events anchored at the bar that `order` puts first."""
    held = ind.with_runs(flagged, "flag").where("flag")
    row = F.min(F.struct(order.alias("o"), "bar_no", direction.alias("direction"), strength.alias("strength"))).alias("a")
    out = held.groupBy("symbol", "run_id").agg(F.min("bar_no").alias("start"), F.max("bar_no").alias("end"), F.count(F.lit(1)).alias("n_bars"), row)
    return out.where(F.col("n_bars") >= least).select("symbol", F.lit(kind).alias("kind"), F.col("a.direction").alias("direction"), F.col("a.bar_no").alias("anchor"), "start", "end", "n_bars", F.col("a.strength").alias("strength"))


def dry_ups(bars: DataFrame, factor: float = 0.5, least: int = 3) -> DataFrame:
    """Volume's 20-bar mean at most `factor` of its 60-bar mean; anchored at the least ratio."""
    v = F.col("volume")
    out = bars.withColumn("ratio", ind.mean(v, 20, 10) / F.nullif(ind.mean(v, 60, 30), F.lit(0.0)))
    out = out.withColumn("flag", F.coalesce(F.col("ratio") <= factor, F.lit(False)))
    return _events(out, least, F.col("ratio"), "dry_up", F.lit("neutral"), 1 - F.col("ratio"))


def climaxes(bars: DataFrame, volume_factor: float = 2.5, range_factor: float = 1.5) -> DataFrame:
    """Volume of `volume_factor` means on a bar of `range_factor` ATRs; a rising bar is bearish, a falling one bullish."""
    out = ind.with_atr_wilder(bars).withColumn("ratio", F.col("volume") / F.nullif(ind.mean(F.col("volume"), 20, 10), F.lit(0.0)))
    wide = (F.col("high") - F.col("low")) / F.nullif(F.col("atr"), F.lit(0.0)) >= range_factor
    out = out.withColumn("flag", F.coalesce((F.col("ratio") >= volume_factor) & wide, F.lit(False)))
    return _events(out, 1, -F.col("ratio"), "climax", F.when(F.col("close") >= F.col("open"), "bearish").otherwise("bullish"), F.col("ratio"))


def divergences(bars: DataFrame, window: int = 20, eps: float = 5e-4, least: int = 3) -> DataFrame:
    """Price trends while volume falls: rising price bearish, falling price bullish; anchored at the run's end."""
    c, v = F.col("close"), F.col("volume")
    out = bars.withColumn("ps", ind.slope(c, window, window) / F.nullif(ind.mean(c, window), F.lit(0.0))).withColumn("vs", ind.slope(v, window, window) / F.nullif(ind.mean(v, window), F.lit(0.0)))
    kinds = []
    for name, hit in (("bearish", F.col("ps") > eps), ("bullish", F.col("ps") < -eps)):
        f = out.withColumn("flag", F.coalesce(hit & (F.col("vs") < -eps), F.lit(False)))
        kinds.append(_events(f, least, -F.col("bar_no"), "divergence", F.lit(name), F.abs("vs") / eps))
    return kinds[0].unionByName(kinds[1])


def accumulations(bars: DataFrame, flat: float = 2.0, least: int = 5) -> DataFrame:
    """Price within `flat` ATRs of 20 bars ago, range under its own 60-bar median and volume under its 60-bar mean."""
    out = ind.with_atr_wilder(bars)
    span = (F.max("high").over(ind.last(20)) - F.min("low").over(ind.last(20))) / F.nullif(F.col("close"), F.lit(0.0))
    out = out.withColumn("span", F.when(F.col("bar_no") >= 19, span))
    out = out.withColumn("mid", ind.enough(F.col("span"), F.percentile("span", 0.5).over(ind.last(60)), 60, 60))
    ma, base = ind.mean(F.col("volume"), 20), ind.mean(F.col("volume"), 60)
    still = F.abs(F.col("close") - F.lag("close", 20).over(in_order())) < flat * F.col("atr")
    out = out.withColumn("strength", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ma / F.nullif(base, F.lit(0.0)))), F.lit(0.5)))
    out = out.withColumn("flag", F.coalesce(still & (F.col("span") < F.col("mid")) & (ma < base), F.lit(False)))
    return _events(out, least, -F.col("bar_no"), "accumulation", F.lit("bullish"), F.col("strength"))
