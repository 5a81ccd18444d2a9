"""Confluence of a symbol's last bar, and the trade plan that follows from it.

Everything is an expression over joins on symbol: a profile's levels and nodes, the quiet
score and the events of the last bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquarry.operators import indicators as ind
from barquarry.operators import nodes, profile, regime

#: Weights of the components.
WEIGHTS = {"value_area": 1.0, "key_level": 1.0, "quiet": 1.5, "patterns": 1.5}


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def value_area_part(price: Column, val: Column, vah: Column) -> tuple[Column, Column]:
    """(strength, direction): towards the middle of the value area, stronger at its edges and beyond."""
    loc = (price - val) / F.greatest(vah - val, F.lit(1e-9))
    out = F.when(loc < 0, -loc).when(loc > 1, loc - 1)
    strength = F.when(out.isNotNull(), F.least(F.lit(0.98), 0.9 + 0.25 * out)).otherwise(0.2 + 0.7 * F.abs(2 * loc - 1))
    return strength, F.when(loc <= 0.45, 1).when(loc >= 0.55, -1).otherwise(0)


def key_level_part(price: Column, hvn: Column, lvn: Column, tolerance: Column) -> tuple[Column, Column]:
    """Near a heavy node: off it, up from above and down from below; near an empty one: no direction; else weak."""
    far = F.lit(float("inf"))
    high, low = F.coalesce(F.abs(price - hvn), far), F.coalesce(F.abs(price - lvn), far)
    near = F.least(high, low) <= tolerance
    strength = F.when(near & (high <= low), 0.3 + 0.6 * (1 - high / tolerance)).when(near, 0.3 + 0.5 * (1 - low / tolerance)).otherwise(0.1)
    return strength, F.when(near & (high <= low), F.when(price >= hvn, 1).otherwise(-1)).otherwise(0)


def patterns_part(events: DataFrame, ends: DataFrame, recency: int = 10) -> DataFrame:
    """(symbol, p_strength, p_dir) of the events anchored in the last `recency` bars; those of today count whole."""
    s = F.coalesce(F.when(~F.isnan("strength"), F.col("strength")), F.lit(0.0))
    kind, way = F.col("kind"), F.when(F.col("direction") == "bullish", 1).otherwise(-1)
    force = F.when(kind == "accumulation", clip(s, 0.4)).when(kind == "dry_up", clip(s, 0.3)).when(kind == "divergence", 0.6).when(kind == "climax", clip((s - 1) / 3, 0.3)).otherwise(0.0)
    sign = F.when(kind == "accumulation", 1).when(kind.isin("divergence", "climax"), way).otherwise(0)
    rows = events.join(ends.select("symbol", F.col("bar_no").alias("end_bar")), "symbol").where(F.col("anchor") >= F.col("end_bar") - recency)
    rows = rows.withColumn("w", force * clip(1 - (F.col("end_bar") - F.col("anchor")) / max(recency, 1))).withColumn("signed", F.col("w") * sign)
    out = rows.groupBy("symbol").agg(F.sum("w").alias("total"), F.sum("signed").alias("signed"), F.max("w").alias("peak"))
    ratio = F.round(F.try_divide("signed", "total"), 9)
    return out.select("symbol", clip(F.col("peak")).alias("p_strength"), F.when(ratio > 0.15, 1).when(ratio < -0.15, -1).otherwise(0).alias("p_dir"))


def confluence(bars: DataFrame, events: DataFrame | None = None, node_tolerance: float = 0.5, band: float = 10.0) -> DataFrame:
    """One row per symbol, judged at its last bar: the components, setup_quality, bias_score, bias, and the levels they rest on.

    The ATR falls back on the mean range of 14 bars, then on the bin size.
    """
    edges = profile.bins(bars)
    hist = profile.histogram(bars, edges)
    places = nodes.levels(hist, edges, profile.value_area(hist))
    found = nodes.nodes(hist)
    if events is None:
        events = regime.dry_ups(bars).unionByName(regime.climaxes(bars)).unionByName(regime.divergences(bars)).unionByName(regime.accumulations(bars))
    frame = regime.quiet_frame(bars).withColumn("span", F.avg(F.col("high") - F.col("low")).over(ind.last(14)))
    ends = regime.latest(frame).select("symbol", "bar_no", F.col("close").alias("price"), "atr", "span", F.coalesce("quiet_score", F.lit(0.0)).alias("quiet_score"))
    out = ends.join(places, "symbol")
    atr = F.when(F.col("atr") > 0, F.col("atr")).when(F.col("span") > 0, F.col("span")).otherwise(F.greatest(F.col("bin_size"), F.lit(1e-9)))
    out = out.withColumn("atr", atr).drop("span")
    near = nodes.nearest_node(found, out.select("symbol", F.col("price").alias("x"))).select("symbol", "hvn", "lvn")
    heavy = found.where("kind = 'HVN'").groupBy("symbol").agg(F.sort_array(F.collect_list("price")).alias("heavy"))
    out = out.join(near, "symbol", "left").join(heavy, "symbol", "left").join(patterns_part(events, ends), "symbol", "left").fillna({"p_strength": 0.0, "p_dir": 0})
    price = F.col("price")
    va, va_dir = value_area_part(price, F.col("val"), F.col("vah"))
    key, key_dir = key_level_part(price, F.col("hvn"), F.col("lvn"), node_tolerance * F.col("atr"))
    out = out.withColumns({"va_strength": va, "va_dir": va_dir, "key_strength": key, "key_dir": key_dir, "quiet_strength": clip(F.col("quiet_score") / 100)})
    total = sum(WEIGHTS.values())
    parts = {"value_area": ("va_strength", "va_dir"), "key_level": ("key_strength", "key_dir"), "quiet": ("quiet_strength", None), "patterns": ("p_strength", "p_dir")}
    quality = sum((F.col(s) * WEIGHTS[k] for k, (s, _) in parts.items()), F.lit(0.0)) * 100 / total
    lean = sum((F.col(s) * F.col(d) * WEIGHTS[k] for k, (s, d) in parts.items() if d), F.lit(0.0)) * 100 / total
    bias = F.when(lean > band, "bullish").when(lean < -band, "bearish").otherwise("neutral")
    return out.withColumns({"setup_quality": F.bround(quality, 2), "bias_score": F.bround(lean, 2), "bias": bias})


def trade_plan(scores: DataFrame, style: str = "reversion", min_quality: float = 55.0, min_bias: float = 15.0, min_quiet: float | None = None, min_rr: float = 1.5, stop_atrs: float = 1.5, buffer_atrs: float = 0.25, trigger_atrs: float = 0.10, target_rr: float = 2.0, risk_share: float = 0.01, equity: float = 10_000.0) -> DataFrame:
    """(symbol, action, reason, entry, stop, targets, risk, risk_reward, size): long, short or no_trade with the first reason.

    reversion enters at the price, stops behind the nearest level and aims at the point of control and the far edge
    of value; breakout enters beyond the nearest level and aims at the one after it.  Without a target: target_rr risks.
    """
    if style not in ("reversion", "breakout"):
        raise ValueError("style is reversion or breakout")
    way = F.when(F.col("bias") == "bullish", 1).when(F.col("bias") == "bearish", -1).otherwise(0)
    out = scores.withColumns({"way": way, "eps": 0.05 * F.col("atr"), "sig": F.expr("array_distinct(concat(array(poc, vah, val), coalesce(heavy, cast(array() as array<double>))))")})
    ahead = F.expr("array_min(transform(filter(sig, y -> way * (y - price) > eps), y -> way * y)) * way")
    behind = F.expr("array_max(transform(filter(sig, y -> way * (y - price) < -eps), y -> way * y)) * way")
    out = out.withColumns({"ahead": ahead, "behind": behind})
    atr, w = F.col("atr"), F.col("way")
    if style == "reversion":
        entry = F.col("price")
        stop = F.coalesce(F.col("behind") - w * buffer_atrs * atr, entry - w * stop_atrs * atr)
        aims = F.expr("array(poc, if(way > 0, vah, val))")
    else:
        entry = F.coalesce(F.col("ahead"), F.col("price")) + w * trigger_atrs * atr
        stop = entry - w * stop_atrs * atr
        aims = F.expr("slice(transform(array_sort(transform(filter(sig, y -> way * (y - entry) > eps), y -> way * y)), y -> way * y), 1, 1)")
    out = out.withColumn("entry", entry).withColumn("stop", stop)
    out = out.withColumn("stop", F.when(w * (F.col("entry") - F.col("stop")) <= 0, F.col("entry") - w * stop_atrs * atr).otherwise(F.col("stop")))
    out = out.withColumn("aims", aims).withColumn("risk", F.abs(F.col("entry") - F.col("stop")))
    good = "array_distinct(transform(array_sort(transform(filter(aims, y -> way * (y - entry) > eps), y -> way * y)), y -> way * y))"
    out = out.withColumn("aims", F.expr(f"slice({good}, 1, 2)")).withColumn("aims", F.expr(f"if(size(aims) > 0, aims, array(entry + way * risk * {target_rr}D))"))
    out = out.withColumn("rr", F.try_divide(F.abs(F.expr("get(aims, 0)") - F.col("entry")), F.col("risk"))).withColumn("size", F.floor(F.try_divide(F.lit(equity * risk_share), F.col("risk"))).cast("double"))
    reason = F.when(F.col("way") == 0, "no directional bias").when(F.col("setup_quality") < min_quality, "setup quality").when(F.abs("bias_score") < min_bias, "directional conviction")
    if min_quiet is not None:
        reason = reason.when(F.col("quiet_score") < min_quiet, "not a quiet phase")
    reason = reason.when(F.col("risk") <= 0, "degenerate stop").when(F.col("rr") < min_rr, "risk:reward").when(F.col("size") < 1, "risk budget")
    out = out.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    action = F.when(~ok, "no_trade").when(F.col("way") > 0, "long").otherwise("short")
    kept = {c: F.when(ok, x) for c, x in {"entry": F.round("entry", 6), "stop": F.round("stop", 6), "target": F.round(F.expr("get(aims, 0)"), 6), "final_target": F.round(F.element_at("aims", -1), 6), "risk": F.round("risk", 6), "risk_reward": F.round("rr", 3), "size": F.col("size")}.items()}
    return out.select("symbol", action.alias("action"), "reason", *[x.alias(c) for c, x in kept.items()])
