"""The walk-forward backtest: signals are known for all bars at once; what is left is one ordered fold per key.

A key is a symbol with whatever it is combined with (style, group of a split).  Rows are
dealt by key and sorted; a Python worker keeps one position, one pending order and the
cash, whatever the length of the history.

Each bar, in this order: a pending order is filled at the bar's open; an open position is
checked for its exit; if there is neither, the bar's signal becomes pending; the account is
valued at the close.  What is open at the end is closed at the raw last close.

Defined results: keys of fewer than lookback + 2 bars have no backtest; an order is dropped
if its open is at or beyond its stop, or the cash does not buy one unit; empty tables give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquarry.operators.backtest import BARS_PER_YEAR

TRADE = "side int, entry_bar long, exit_bar long, entry_price double, exit_price double, size double, stop double, target double, pnl double, return_pct double, r_multiple double, exit_reason string, bars_held long"
EQUITY = "bar_no long, equity double"
NAMES = [x.split()[0] for x in (EQUITY + ", " + TRADE).split(", ")]


@dataclass(frozen=True)
class Account:
    """How a backtest trades. Costs in basis points; max_hold None: no time stop."""

    equity: float = 10_000.0
    risk_fraction: float = 0.01
    max_hold: int | None = None
    slippage_bps: float = 5.0
    spread_bps: float = 0.0
    commission_bps: float = 0.0
    commission_per_share: float = 0.0

    def __post_init__(self):
        if self.equity <= 0 or not 0 < self.risk_fraction <= 1 or (self.max_hold is not None and self.max_hold < 1):
            raise ValueError("equity and max_hold must be above 0, risk_fraction in (0, 1]")
        if min(self.slippage_bps, self.spread_bps, self.commission_bps, self.commission_per_share) < 0:
            raise ValueError("costs must not be below 0")

    def fill(self, price: float, side: int) -> float:
        return price * (1 + side * (self.slippage_bps + self.spread_bps / 2) / 1e4)

    def fee(self, price: float, shares: float) -> float:
        return shares * price * self.commission_bps / 1e4 + shares * self.commission_per_share


class Walk:
    """One key's backtest, bar by bar."""

    def __init__(self, account: Account):
        self.account, self.cash = account, account.equity
        self.position: dict | None = None
        self.pending: tuple | None = None

    def bar(self, at: int, o: float, h: float, lo: float, c: float, order: tuple | None) -> tuple[float, dict | None]:
        """(value of the account at the close, the trade that ended here). order: (side, stop, target, risk)."""
        trade = None
        if self.position is None and self.pending is not None:
            self.position, self.pending = self._opened(at, o), None
        if self.position is not None:
            found = self._exit(at, o, h, lo, c)
            if found is not None:
                trade = self._closed(at, *found)
        if self.position is None and self.pending is None and order is not None and self.cash * self.account.risk_fraction >= order[3]:
            self.pending = order  # at least one unit can be sized
        p = self.position
        return self.cash + (p["side"] * (c - p["entry_price"]) * p["size"] if p else 0.0), trade

    def _opened(self, at: int, o: float) -> dict | None:
        side, stop, target, _ = self.pending
        entry = self.account.fill(o, side)
        risk = side * (entry - stop)
        if risk <= 0:
            return None
        size = min(math.floor(self.cash * self.account.risk_fraction / risk), math.floor(self.cash / entry))
        return {"side": side, "entry_bar": at, "entry_price": entry, "size": float(size), "stop": stop, "target": target} if size > 0 else None

    def _exit(self, at: int, o: float, h: float, lo: float, c: float) -> tuple[float, str] | None:
        p = self.position
        side, fill = p["side"], self.account.fill
        worst, best = (lo, h) if side > 0 else (h, lo)

        def beyond(price: float, level: float, way: int) -> bool:
            return way * side * (price - level) >= 0

        if at > p["entry_bar"]:  # the bar may open beyond a level
            if beyond(o, p["stop"], -1):
                return fill(o, -side), "stop"
            if beyond(o, p["target"], 1):
                return fill(o, -side), "target"
        if beyond(worst, p["stop"], -1):
            return fill(p["stop"], -side), "stop"
        if beyond(best, p["target"], 1):
            return fill(p["target"], -side), "target"
        if self.account.max_hold is not None and at - p["entry_bar"] >= self.account.max_hold:
            return fill(c, -side), "time"
        return None

    def _closed(self, at: int, price: float, reason: str) -> dict:
        p, self.position = self.position, None
        pnl = p["side"] * (price - p["entry_price"]) * p["size"] - self.account.fee(p["entry_price"], p["size"]) - self.account.fee(price, p["size"])
        self.cash += pnl
        value, risk = p["entry_price"] * p["size"], abs(p["entry_price"] - p["stop"]) * p["size"]
        return p | {"exit_bar": at, "exit_price": price, "pnl": pnl, "return_pct": pnl / value * 100 if value else 0.0, "r_multiple": pnl / risk if risk else 0.0, "exit_reason": reason, "bars_held": at - p["entry_bar"]}

    def end(self, at: int, c: float) -> dict | None:
        return self._closed(at, c, "end") if self.position else None


def _walks(keys: list[str], account: Account, schema: pa.Schema):
    """mapInArrow function over rows sorted by key and bar: a row for each bar's equity and each trade."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walk, last = None, None, None  # last: the key's latest bar, held back as its value may still change
        for batch in batches:
            out: list[dict] = []

            def finish() -> None:
                if walk is None:
                    return
                row, at, c = last
                trade = walk.end(at, c)
                if trade:
                    row["equity"] = walk.cash
                    out.append(dict(zip(keys, now)) | trade)
                out.append(row)

            data = {c: batch.column(c).to_pylist() for c in [*keys, "bar_no", "open", "high", "low", "close", "side", "stop", "target", "risk"]}
            for *key, at, o, h, lo, c, side, stop, target, risk in zip(*data.values()):
                if key != now:
                    finish()
                    now, walk, last = key, Walk(account), None
                elif last is not None:
                    out.append(last[0])
                value, trade = walk.bar(at, o, h, lo, c, None if side is None else (side, stop, target, risk))
                if trade:
                    out.append(dict(zip(keys, key)) | trade)
                last = (dict(zip(keys, key)) | {"bar_no": at, "equity": value}, at, c)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if walk is not None:
            out = []
            row, at, c = last
            trade = walk.end(at, c)
            if trade:
                row["equity"] = walk.cash
                out.append(dict(zip(keys, now)) | trade)
            yield pa.RecordBatch.from_pylist([*out, row], schema)

    return run


def backtest(bars: DataFrame, plans: DataFrame, lookback: int = 120, account: Account | None = None, keys: list[str] | None = None) -> DataFrame:
    """Bars (keys, bar_no, open, high, low, close) under plans (keys, bar_no, action, side, stop, targets, risk; see decisions.signals,
    whose budget must not bind): rows of equity (bar_no set) and of trades (entry_bar set), both with the keys.

    bars must begin at the first decision's bar: bar lookback - 1 of the history, or of a slice of it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = keys or ["symbol"]
    orders = plans.where("action in ('LONG', 'SHORT')").select(*keys, "bar_no", "side", "stop", F.col("targets")[0].alias("target"), "risk")
    rows = bars.select(*keys, "bar_no", "open", "high", "low", "close").join(orders, [*keys, "bar_no"], "left")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "bar_no")
    ddl = ", ".join(f"{x} {bars.schema[x].dataType.simpleString()}" for x in keys) + f", {EQUITY}, {TRADE}"
    schema = to_arrow_schema(bars.sparkSession.createDataFrame([], ddl).schema)
    return rows.mapInArrow(_walks(keys, account or Account(), schema), ddl)


def history(bars: DataFrame, lookback: int = 120) -> DataFrame:
    """The bars that a backtest of each symbol walks: from the first decision on, if there are lookback + 2 bars."""
    whole = bars.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    return whole.where((F.col("n") >= lookback + 2) & (F.col("bar_no") >= lookback - 1)).drop("n")


def trades(found: DataFrame) -> DataFrame:
    return found.where("entry_bar is not null").drop("bar_no", "equity")


def curves(found: DataFrame) -> DataFrame:
    return found.where("bar_no is not null").select(*[c for c in found.columns if c not in NAMES or c in ("bar_no", "equity")])


def results(found: DataFrame, account: Account | None = None, keys: list[str] | None = None, interval: str = "1d") -> DataFrame:
    """A row per key: n_trades, win_rate, profit_factor (infinite without losses), expectancy, avg_r, total_return_pct, max_drawdown_pct, sharpe."""
    keys, start = keys or ["symbol"], (account or Account()).equity
    order = Window.partitionBy(*keys).orderBy("bar_no")
    rows = curves(found).withColumn("dd", F.col("equity") / F.max("equity").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    rows = rows.withColumn("ret", F.col("equity") / F.lag("equity").over(order) - 1)
    by = rows.groupBy(*keys).agg(F.max_by("equity", "bar_no").alias("final_equity"), F.min("dd").alias("dd"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.count(F.lit(1)).alias("n_bars"))
    p = F.col("pnl")
    won, lost = F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)), -F.coalesce(F.sum(F.when(p < 0, p)), F.lit(0.0))
    closed = trades(found).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg((p > 0).cast("double")).alias("win_rate"), F.avg(p).alias("expectancy"), F.avg("r_multiple").alias("avg_r"),
        F.when(lost > 0, won / lost).when(won > 0, float("inf")).otherwise(0.0).alias("profit_factor"),
    )
    scale = math.sqrt(BARS_PER_YEAR.get(interval.lower(), 252))
    sharpe = F.when((F.col("n_bars") >= 3) & (F.col("s") > 0), F.col("m") / F.col("s") * scale).otherwise(0.0)
    out = by.join(closed, keys, "left").na.fill(0)
    return out.select(*keys, "final_equity", ((F.col("final_equity") / start - 1) * 100).alias("total_return_pct"), "n_trades", "win_rate", "profit_factor", (F.col("dd") * 100).alias("max_drawdown_pct"), "expectancy", "avg_r", sharpe.alias("sharpe"))


# ---- split into groups, styles and sectors ----


def group_slices(bars: DataFrame, groups: int = 6, lookback: int = 120) -> DataFrame:
    """The bars that each group's own backtest walks, with `grp`: the group's and the one before it, as its first decision's.

    Groups without a lookback of bars before them have no slice.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    small, extra = F.floor(F.col("n") / groups), F.col("n") % groups
    begin = [F.lit(g) * small + F.least(F.lit(g), extra) for g in range(groups + 1)]
    ranges = F.array(*[F.struct(F.lit(g).alias("grp"), begin[g].alias("a"), begin[g + 1].alias("z")) for g in range(groups)])
    own = F.filter(ranges, lambda r: (F.col("bar_no") >= r["a"] - 1) & (F.col("bar_no") < r["z"]) & (r["a"] >= lookback) & (r["z"] > r["a"] + 1))
    rows = bars.withColumn("n", n).withColumn("r", F.explode(own))
    return rows.select("symbol", F.col("r.grp").alias("grp"), "bar_no", "open", "high", "low", "close")


def paths(by_group: DataFrame, groups: int = 6, tests: int = 2) -> DataFrame:
    """Every combination of `tests` groups that all have a backtest: symbol, path, return_pct and sharpe as means over its groups."""
    chosen = [(i, g) for i, own in enumerate(combinations(range(groups), tests)) for g in own]
    table = by_group.sparkSession.createDataFrame(chosen, "path int, grp int")
    rows = by_group.join(F.broadcast(table), "grp")
    out = rows.groupBy("symbol", "path").agg(F.count(F.lit(1)).alias("k"), F.avg("total_return_pct").alias("return_pct"), F.avg("sharpe").alias("sharpe"))
    return out.where(F.col("k") == tests).drop("k")


def path_summary(found: DataFrame) -> DataFrame:
    """Per symbol the distribution of its paths' returns and Sharpe ratios."""
    r = F.col("return_pct")
    return found.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_paths"), F.avg(r).alias("return_mean"), F.percentile(r, 0.5).alias("return_median"), F.stddev_pop(r).alias("return_std"), F.min(r).alias("return_min"), F.max(r).alias("return_max"),
        (F.avg((r > 0).cast("double")) * 100).alias("pct_profitable"), F.avg("sharpe").alias("sharpe_mean"), F.percentile("sharpe", 0.5).alias("sharpe_median"),
    )


def sweep_report(found: DataFrame, sectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results (symbol, style, ...) with sectors(symbol, sector): returns by symbol and style, aggregates by style, and mean returns by sector and style."""
    r = F.round("total_return_pct", 1)
    rows = found.join(sectors, "symbol").withColumn("r", r)
    wide = rows.groupBy("sector", "symbol").pivot("style", ["breakout", "reversion"]).agg(F.first("r"))
    by_style = rows.groupBy("style").agg(
        F.round(F.avg("r"), 2).alias("mean_return_pct"), F.round(F.percentile("r", 0.5), 2).alias("median_return_pct"), F.round(F.avg((F.col("r") > 0).cast("double")) * 100, 1).alias("pct_profitable"),
        F.round(F.avg(F.round("sharpe", 2)), 2).alias("mean_sharpe"), F.sum("n_trades").alias("total_trades"),
    )
    return wide, by_style, rows.groupBy("style", "sector").agg(F.round(F.avg("r"), 2).alias("mean_return_pct"))
