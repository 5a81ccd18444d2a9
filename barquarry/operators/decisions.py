"""What can be decided at each sampled bar, from the bars up to it and no later one.

A decision needs the `lookback` bars that end at it.  Bars are dealt to blocks of BLOCK
bars of a symbol, each with the lookback - 1 bars before it: one shuffle by (symbol, block),
groups of at most BLOCK + lookback - 1 rows however long a history is, and no symbol is
bound to one task.  Inside a block all windows are worked on together (kernels.py).

Defined results: bars without a whole window, and windows without a valid bar, give no row;
a symbol's bars are numbered from 0 without gaps in `bar_no`; empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquarry.operators import indicators as ind
from barquarry.operators import kernels as k
from barquarry.operators.labels import triple_barrier_at

BLOCK = 512
OHLCV = ["open", "high", "low", "close", "volume"]
EVENT = "struct<kind:string,direction:string,anchor:bigint,price:double,volume:double,strength:double,start:bigint,end:bigint,level:string,text:string>"
DECISION = f"""symbol {{symbol}}, bar_no long, price double, atr double, poc double, vah double, val double, bin_size double, n_bins int, hvn array<double>, lvn array<double>,
quiet_score double, is_quiet boolean, quiet_text string, s_value double, d_value int, s_level double, d_level int, s_quiet double, s_patterns double, d_patterns int,
quality double, bias_score double, bias string, rationale string, events array<{EVENT}>"""
PLAN = "action string, reason string, side int, entry double, stop double, targets array<double>, risk double, rr double, size double"


def blocks(bars: DataFrame, lookback: int, size: int = BLOCK) -> DataFrame:
    """The bars with a block number: that of each block in which a bar is needed."""
    own = F.expr(f"bar_no div {size}")
    last = F.expr(f"(bar_no + {lookback - 1}) div {size}")
    return bars.select("symbol", "bar_no", *[F.col(c).cast("double").alias(c) for c in OHLCV], F.explode(F.sequence(own, last)).alias("block"))


def _arrays(table: pa.Table) -> tuple[int, object, np.ndarray, list[np.ndarray]]:
    """(block, symbol, bar numbers, open, high, low, close and volume) in order."""
    order = np.argsort(table.column("bar_no").to_numpy())
    columns = [np.array(table.column(c).to_numpy(), float)[order] for c in OHLCV]
    return table.column("block")[0].as_py(), table.column("symbol")[0].as_py(), table.column("bar_no").to_numpy()[order], columns


def _ends(bar_no: np.ndarray, block: int, size: int, lookback: int, stride: int) -> np.ndarray:
    """Rows of the block's own sampled bars that have a whole window."""
    good = (bar_no // size == block) & (bar_no >= lookback - 1) & ((bar_no - (lookback - 1)) % stride == 0)
    return np.flatnonzero(good & (np.arange(len(bar_no)) >= lookback - 1))


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def _schema(df: DataFrame, ddl: str) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = ddl.replace("{symbol}", df.schema["symbol"].dataType.simpleString())
    return ddl, to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


def decide(lookback: int, stride: int, schema: pa.Schema, styles: list[str], mode: str, size: int, recency: int | None, gate: dict):
    """applyInArrow function over a block of bars: a row for each decision and, with styles, for each decision and style."""

    def run(table: pa.Table) -> pa.Table:
        block, symbol, bar_no, (o, h, lo, c, v) = _arrays(table)
        ends = _ends(bar_no, block, size, lookback, stride)
        if not len(ends):
            return _table([], schema)
        w = k.Windows(o, h, lo, c, v, ends, lookback)
        quiet, events, out = w.quiet(), w.events(recency), []
        for i, end in enumerate(ends.tolist()):
            p = k.profile(w.high[i], w.low[i], w.close[i], w.volume[i], mode)
            if p is None:
                continue
            price, atr = float(c[end]), float(w.atr[i, -1])
            if not np.isfinite(atr) or atr <= 0:
                atr = float((w.high[i] - w.low[i])[-14:].mean())
            atr = atr if atr > 0 else max(p.size, 1e-9)
            for e in events[i]:
                e["level"] = None if e["kind"] == "divergence" else k.nearest_level(e["price"], p, 0.5 * e["atr"])
                e["text"] = k.explain_event(e, e["level"])
            active = [e for e in events[i] if e["anchor"] >= lookback - 1 - k.RECENCY]
            score, is_quiet = float(quiet["score"][i]), bool(quiet["quiet"][i])
            parts = [k.value_part(price, p), k.level_part(price, p, atr), k.quiet_part(score, is_quiet), k.pattern_part(active, lookback)]
            quality, lean, bias, rationale = k.confluence(parts)
            first = int(bar_no[end]) - lookback + 1
            row = {
                "symbol": symbol, "bar_no": int(bar_no[end]), "price": price, "atr": atr, "poc": p.poc, "vah": p.vah, "val": p.val, "bin_size": p.size, "n_bins": len(p.hist),
                "hvn": [x for x, _ in p.hvn], "lvn": [x for x, _ in p.lvn], "quiet_score": score, "is_quiet": is_quiet,
                "quiet_text": k.explain_quiet(quiet["ranks"][i], score, is_quiet, bool(quiet["falling"][i])),
                "s_value": parts[0].strength, "d_value": parts[0].direction, "s_level": parts[1].strength, "d_level": parts[1].direction, "s_quiet": parts[2].strength,
                "s_patterns": parts[3].strength, "d_patterns": parts[3].direction, "quality": quality, "bias_score": lean, "bias": bias, "rationale": rationale,
                "events": [{**{x: e[x] for x in ("kind", "direction", "price", "volume", "strength", "level", "text")}, **{x: e[x] + first for x in ("anchor", "start", "end")}} for e in events[i]],
            }
            if not styles:
                out.append(row)
            for style in styles:
                own = k.signal(price, atr, p, quality, lean, bias, rationale, score, style, **gate)
                out.append({x: row[x] for x in ("symbol", "bar_no", "price", "atr", "quality", "bias", "bias_score", "quiet_score")} | {"style": style} | own)
        return _table(out, schema)

    return run


def decisions(bars: DataFrame, lookback: int = 120, stride: int = 1, mode: str = "auto", recency: int | None = 10, size: int = BLOCK) -> DataFrame:
    """Profile, quiet phase, events and confluence at every stride-th bar from the first whole window on.

    recency: events whose anchor is at most so many bars old, None for all in the window.
    """
    ddl, schema = _schema(bars, DECISION)
    return blocks(bars, lookback, size).groupBy("symbol", "block").applyInArrow(decide(lookback, stride, schema, [], mode, size, recency, {}), ddl)


def signals(bars: DataFrame, styles: list[str] | None = None, lookback: int = 120, stride: int = 1, mode: str = "auto", size: int = BLOCK, **gate) -> DataFrame:
    """The trade plan of every decision and style, or the first reason against one. gate: see kernels.signal."""
    ddl, schema = _schema(bars, f"symbol {{symbol}}, bar_no long, style string, price double, atr double, quality double, bias string, bias_score double, quiet_score double, {PLAN}")
    run = decide(lookback, stride, schema, styles or ["reversion"], mode, size, 10, gate)
    return blocks(bars, lookback, size).groupBy("symbol", "block").applyInArrow(run, ddl)


# ---- datasets ----

FACTORS = ["value_area", "key_level", "quiet", "patterns"]
ENRICHED = [*FACTORS, "mom_20", "mom_60", "mom_120_20", "vol_20", "atr_frac", "vol_trend", "poc_dist"]
META = [*FACTORS, "quality_share", "bias_share"]
STRUCTURE = ["delta_net", "delta_poc", "skew", "kurtosis", "poc_loc", "vacr_z", "poc_slope", "cost_basis_migration", "n_ledges", "poor_high", "is_p_shape", "is_b_shape", "is_double"]
MIXTURE = [f"gmm_{x}" for x in k.MIXTURE]


def _signed(found: DataFrame) -> DataFrame:
    c = F.col
    return found.withColumns({"value_area": c("s_value") * c("d_value"), "key_level": c("s_level") * c("d_level"), "quiet": c("s_quiet"), "patterns": c("s_patterns") * c("d_patterns")})


def _forward(bars: DataFrame, horizon: int) -> DataFrame:
    """symbol, bar_no and the return over the next `horizon` bars, where there are so many."""
    ahead = F.lead("close", horizon).over(ind.in_order()) / F.col("close") - 1
    return bars.select("symbol", "bar_no", "ts", ahead.alias("y")).where("y is not null")


def factor_dataset(bars: DataFrame, found: DataFrame, horizon: int = 20) -> DataFrame:
    """Decisions as four signed factors with the forward return y and the score itself as baseline."""
    out = _signed(found).join(_forward(bars, horizon), ["symbol", "bar_no"])
    return out.select("symbol", "bar_no", "ts", *FACTORS, "y", F.col("bias_score").alias("baseline"))


def enriched_dataset(bars: DataFrame, found: DataFrame, horizon: int = 20) -> DataFrame:
    """The four factors and seven of momentum, volatility and volume; rows with a missing one go."""
    c, close = F.col, F.col("close")
    more = ind.with_atr_wilder(bars).withColumn("ret", ind.change(close))
    more = more.withColumns({
        "mom_20": ind.change(close, 20), "mom_60": ind.change(close, 60), "mom_120_20": ind.change(close, 120, 20), "vol_20": ind.realised_vol(c("ret"), 20),
        "atr_frac": c("atr") / close, "vol_trend": ind.mean(c("volume"), 10) / F.nullif(ind.mean(c("volume"), 60), F.lit(0.0)) - 1, "y": F.lead("close", horizon).over(ind.in_order()) / close - 1,
    })
    more = more.select("symbol", "bar_no", "ts", c("atr").alias("whole_atr"), *ENRICHED[4:10], "y").dropna()
    out = _signed(found).join(more, ["symbol", "bar_no"])
    atr = F.when(c("whole_atr") > 0, c("whole_atr")).otherwise(F.greatest("bin_size", F.lit(1e-9)))
    return out.withColumn("poc_dist", (c("price") - c("poc")) / atr).select("symbol", "bar_no", "ts", *ENRICHED, "y", c("bias_score").alias("baseline"))


def meta_dataset(bars: DataFrame, found: DataFrame, horizon: int = 20, profit: float = 2.0, stop: float = 2.0, least_bias: float = 10.0) -> DataFrame:
    """Decisions that lean, as bets in their direction: six features, side, and what the triple barrier makes of them."""
    c = F.col
    out = _signed(found).where(F.abs("bias_score") >= least_bias)
    out = out.select("symbol", "bar_no", *FACTORS, (c("quality") / 100).alias("quality_share"), (F.abs("bias_score") / 100).alias("bias_share"), F.signum("bias_score").cast("int").alias("side"))
    return _with_labels(bars, out, horizon, profit, stop)


def _with_labels(bars: DataFrame, rows: DataFrame, horizon: int, profit: float, stop: float) -> DataFrame:
    whole = bars.groupBy("symbol").agg(F.max("bar_no").alias("last"))
    rows = rows.join(whole, "symbol").where(F.col("bar_no") <= F.col("last") - horizon).drop("last")
    every = ind.with_atr_wilder(bars)
    share = F.col("atr") / F.col("close")
    bets = rows.select("symbol", "bar_no", "side").join(every.select("symbol", "bar_no", F.col("close").alias("price"), F.when(share > 0, share).otherwise(0.01).alias("v")), ["symbol", "bar_no"])
    labelled = triple_barrier_at(bars, bets, horizon, profit, stop)
    return rows.join(labelled.drop("side"), ["symbol", "bar_no"])


def structural(lookback: int, stride: int, schema: pa.Schema, size: int, half_life: float, with_mixture: bool):
    """applyInArrow function over a block of bars: what each sampled window's profile tells by itself."""

    def run(table: pa.Table) -> pa.Table:
        block, symbol, bar_no, (_, h, lo, c, v) = _arrays(table)
        out, profiles = [], []
        for end in _ends(bar_no, block, size, lookback, stride).tolist():
            own = slice(end - lookback + 1, end + 1)
            p = k.profile(h[own], lo[own], c[own], v[own])
            if p is None:
                continue
            profiles.append(p)
            row = {"symbol": symbol, "bar_no": int(bar_no[end]), "close": float(c[end]), "poc": p.poc, "vacr": (p.vah - p.val) / c[end] if c[end] > k.TINY else 0.0, "bin_size": p.size}
            row |= k.structure(h[own], lo[own], c[own], v[own], p, half_life)
            out.append(row)
        if with_mixture:
            for row, found in zip(out, k.mixture_rows(profiles, [r["close"] for r in out])):
                row |= dict(zip(MIXTURE, found))
        return _table(out, schema)

    return run


def structural_walk(bars: DataFrame, lookback: int = 120, stride: int = 3, window: int = 20, pocs: int = 5, half_life: float = 21.0, with_mixture: bool = False, size: int = BLOCK) -> DataFrame:
    """Thirteen structural features at each sampled bar (STRUCTURE), with poc and vacr; from the window-th sample on.

    The width of the value area is judged by the `window` samples before it, the drift of the point of control by the
    last `pocs` samples.  Samples count whether or not their forward bars exist.
    """
    c = F.col
    names = ["delta_net", "delta_poc", "skew", "kurtosis", "poc_loc", "n_ledges", "poor_high"]
    ddl = "symbol {symbol}, bar_no long, close double, poc double, vacr double, bin_size double, shape int, aged_poc double, " + ", ".join(f"{x} double" for x in [*names, *MIXTURE * with_mixture])
    ddl, schema = _schema(bars, ddl)
    rows = blocks(bars, lookback, size).groupBy("symbol", "block").applyInArrow(structural(lookback, stride, schema, size, half_life, with_mixture), ddl)
    rows = rows.join(ind.with_atr_wilder(bars).select("symbol", "bar_no", "ts", "atr"), ["symbol", "bar_no"])
    order = Window.partitionBy("symbol").orderBy("bar_no")
    before, near = order.rowsBetween(-window, -1), order.rowsBetween(-(pocs - 1), 0)
    rows = rows.withColumns({"nth": F.row_number().over(order), "m": F.avg("vacr").over(before), "s": F.stddev_pop("vacr").over(before)})
    rows = rows.withColumn("drift", F.regr_slope(c("poc"), c("nth").cast("double")).over(near))
    atr = F.when(c("atr") > 0, c("atr")).otherwise(F.greatest("bin_size", F.lit(k.TINY)))
    rows = rows.withColumns({
        "vacr_z": F.when(c("s") > k.TINY, (c("vacr") - c("m")) / c("s")).otherwise(0.0), "poc_slope": F.when(c("close") > k.TINY, F.coalesce("drift", F.lit(0.0)) / c("close")).otherwise(0.0),
        "cost_basis_migration": (c("aged_poc") - c("poc")) / atr, **{x: (c("shape") == i).cast("double") for x, i in zip(STRUCTURE[-3:], (1, 2, 4))},
    })
    finite = " and ".join(f"not isnan({x}) and abs({x}) < double('infinity')" for x in STRUCTURE)
    out = rows.where(c("nth") > max(window, pocs - 1)).where(finite)
    return out.select("symbol", "bar_no", "ts", *STRUCTURE, "shape", "poc", "vacr", *MIXTURE * with_mixture)


def structural_dataset(bars: DataFrame, walk: DataFrame, horizon: int = 20) -> DataFrame:
    """The walk's features with the forward return y; the delta at the point of control is the baseline."""
    out = walk.drop("ts").join(_forward(bars, horizon), ["symbol", "bar_no"])
    return out.select("symbol", "bar_no", "ts", *STRUCTURE, "y", F.col("delta_poc").alias("baseline"))


def structural_meta_dataset(bars: DataFrame, walk: DataFrame, horizon: int = 20, profit: float = 2.0, stop: float = 2.0, side: int = 1) -> DataFrame:
    """The walk's features as bets on one side, with what the triple barrier makes of them."""
    return _with_labels(bars, walk.select("symbol", "bar_no", *STRUCTURE, F.lit(side).alias("side")), horizon, profit, stop)


def mixture_dataset(bars: DataFrame, lookback: int = 120, stride: int = 3, horizon: int = 20, size: int = BLOCK) -> DataFrame:
    """Seven mixture features of each sampled window's profile, with the forward return y; the baseline is 0."""

    ddl, schema = _schema(bars, "symbol {symbol}, bar_no long, " + ", ".join(f"{x} double" for x in MIXTURE))

    def run(table: pa.Table) -> pa.Table:
        block, symbol, bar_no, (_, h, lo, c, v) = _arrays(table)
        ends = _ends(bar_no, block, size, lookback, stride).tolist()
        found = [k.profile(h[e - lookback + 1 : e + 1], lo[e - lookback + 1 : e + 1], c[e - lookback + 1 : e + 1], v[e - lookback + 1 : e + 1]) for e in ends]
        good = [(e, p) for e, p in zip(ends, found) if p is not None]
        rows = k.mixture_rows([p for _, p in good], [float(c[e]) for e, _ in good])
        return _table([{"symbol": symbol, "bar_no": int(bar_no[e])} | dict(zip(MIXTURE, r)) for (e, _), r in zip(good, rows)], schema)

    found = blocks(bars, lookback, size).groupBy("symbol", "block").applyInArrow(run, ddl)
    return found.join(_forward(bars, horizon), ["symbol", "bar_no"]).withColumn("baseline", F.lit(0.0))


def aligned(*datasets: tuple[DataFrame, list[str]]) -> DataFrame:
    """Features of several datasets at the bars (symbol, bar_no) that all of them have, with the first one's y; rows with a null go."""
    first, names = datasets[0]
    out = first.select("symbol", "bar_no", "y", *names)
    for df, more in datasets[1:]:
        out = out.join(df.select("symbol", "bar_no", *more), ["symbol", "bar_no"])
    return out.dropna()


def baselines(bars: DataFrame, lookback: int = 120) -> DataFrame:
    """The two plain features that others are measured against: momentum over 20 bars and the distance from the window's average price."""
    return bars.select("symbol", "bar_no", ind.change(F.col("close"), 20).alias("mom"), ind.vwap_distance(lookback).alias("vwap_dist")).dropna()
