"""Ridge factor weights, their out-of-sample scores, rank correlations, t statistics and the paper ledger."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barquarry.operators.labels import average_rank
from barquarry.operators.validation import correlation, cpcv


def ridge_weights(samples: DataFrame, by: list[str], xs: list[str], y: str, alpha: float = 1.0) -> DataFrame:
    """Per group the ridge weights of standardised factors (population sigma, 0 counts as 1) and centred y: by, n, weights.

    Only sums and products leave the aggregation: one row a group, whatever its size, is solved in Python.
    Rows with a null among the factors or y take no part.
    """
    rows = samples.dropna(subset=[*xs, y])
    d = len(xs)
    stats = [F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)]
    stats += [F.covar_pop(xs[i], xs[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    stats += [F.covar_pop(x, y).alias(f"y{i}") for i, x in enumerate(xs)]
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *stats)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema if f.name in by)

    def solve(batches):
        for p in batches:
            out = []
            for r in p.to_dict("records"):
                cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float)
                sd = np.sqrt(np.maximum(np.diag(cov), 0))
                sd[sd == 0] = 1
                right = np.array([r[f"y{i}"] for i in range(d)], float) / sd
                out.append(np.linalg.solve(r["n"] * cov / np.outer(sd, sd) + alpha * np.eye(d), r["n"] * right).tolist())
            yield pd.DataFrame({**{b: p[b] for b in by}, "n": p["n"], "weights": out})

    return sums.mapInPandas(solve, f"{kinds}, n long, weights array<double>")


def _signals(members: DataFrame, x: str | list[str], y: str, alpha: float) -> DataFrame:
    """Test rows of splits of at least max(10, factors + 2) train rows, with n_train and the signal of the ridge fitted on those."""
    if not isinstance(x, str):
        return _joint_signals(members, x, y, alpha)
    train = members.where("role = 'train'").groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("n_train"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.covar_pop(x, y).alias("c"))
    s = F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    k = F.when(F.col("s") > 0, 1.0).otherwise(0.0)
    weight = F.col("n_train") * F.col("c") / s / (F.col("n_train") * k + alpha)
    train = train.where("n_train >= 10").select("symbol", "split", "n_train", "m", s.alias("s"), weight.alias("w"))
    return members.where("role = 'test'").join(train, ["symbol", "split"]).withColumn("signal", (F.col(x) - F.col("m")) / F.col("s") * F.col("w"))


def _joint_signals(members: DataFrame, xs: list[str], y: str, alpha: float) -> DataFrame:
    """As _signals, for several factors: weights come from one aggregate per symbol and split, signals are an expression."""
    keys = ["symbol", "split"]
    train = members.where("role = 'train'")
    weights = ridge_weights(train, keys, xs, y, alpha).where(F.col("n") >= max(10, len(xs) + 2)).withColumnRenamed("n", "n_train")
    stats = train.groupBy(*keys).agg(*[F.avg(x).alias(f"_m{i}") for i, x in enumerate(xs)], *[F.stddev_pop(x).alias(f"_s{i}") for i, x in enumerate(xs)])
    terms = [(F.col(x) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0) * F.col("weights")[i] for i, x in enumerate(xs)]
    fitted = weights.join(stats, keys)
    out = members.where("role = 'test'").join(fitted, keys).withColumn("signal", sum(terms[1:], terms[0]))
    return out.drop("weights", *[f"_{k}{i}" for k in "ms" for i in range(len(xs))])


def factor_eval(members: DataFrame, x: str | list[str], y: str, alpha: float = 1.0) -> DataFrame:
    """One or several factors' ridge signal per symbol and split: IC on test rows, share of right signs, mean of sign times y.

    Splits of under 10 train or 3 test rows are left out; without spread in the signal or y, IC and the rest are null.
    """
    test = _signals(members, x, y, alpha)
    right = F.when(F.signum("signal") == F.signum(y), 1.0).otherwise(0.0)
    out = test.groupBy("symbol", "split", "n_train").agg(
        F.count(F.lit(1)).alias("n_test"), correlation("signal", y).alias("corr"), F.stddev_pop("signal").alias("ss"), F.stddev_pop(y).alias("sy"), F.avg(right).alias("right"), F.avg(F.signum("signal") * F.col(y)).alias("long_short")
    )
    good = (F.col("ss") > 0) & (F.col("sy") > 0)
    kept = {"ic": "corr", "accuracy": "right", "long_short": "long_short"}
    return out.where("n_test >= 3").select("symbol", "split", "n_train", "n_test", *[F.when(good, F.col(c)).alias(name) for name, c in kept.items()])


def factor_buckets(members: DataFrame, x: str | list[str], y: str, alpha: float = 1.0, buckets: int = 5, cost_bps: float = 10.0) -> DataFrame:
    """Mean y by quantile of one or several factors' out-of-sample signal, a row per symbol; returns are shares, not percent.

    The test signals of factor_eval's splits are standardised within their split and pooled.  A row's bucket is the number
    of quantile edges that do not exceed its signal.  means: per bucket, null for an empty one; spread: top less bottom;
    spearman: of the bucket number and the rank of its mean; in_market: share of rows in the outer buckets; always_on: mean
    of raw sign times y; costs are paid once by long_only_net and twice by long_short_net.  Symbols of under 3 pooled rows
    a bucket or without spread in the signal are left out.
    """
    test = _signals(members, x, y, alpha)
    split = Window.partitionBy("symbol", "split")
    test = test.withColumns({"k": F.count(F.lit(1)).over(split), "mid": F.avg("signal").over(split), "sd": F.stddev_pop("signal").over(split)}).where("k >= 3")
    gap = F.col("signal") - F.col("mid")
    test = test.select("symbol", F.col(y).alias("y"), F.signum("signal").alias("sign"), F.when(F.col("sd") > 0, gap / F.col("sd")).otherwise(gap).alias("z"))
    every = test.groupBy("symbol").agg(F.percentile("z", [k / buckets for k in range(1, buckets)]).alias("edges"), F.count(F.lit(1)).alias("n"), F.avg(F.col("sign") * F.col("y")).alias("always_on"), (F.max("z") > F.min("z")).alias("spreads"))
    every = every.where((F.col("n") >= 3 * buckets) & F.col("spreads"))
    rows = test.join(every.select("symbol", "edges"), "symbol").withColumn("bucket", F.size(F.filter("edges", lambda e: e <= F.col("z"))))
    outer = F.avg(F.when(F.col("bucket").isin(0, buckets - 1), 1.0).otherwise(0.0)).alias("in_market")
    by = rows.groupBy("symbol").agg(outer, F.array(*[F.avg(F.when(F.col("bucket") == k, F.col("y"))) for k in range(buckets)]).alias("means"))
    # ordinal ranks of the means: an empty bucket counts as largest, of equal ones the lower bucket comes first
    placed = F.array_sort(F.array(*[F.struct(F.col("means")[k].isNull().alias("none"), F.coalesce(F.col("means")[k], F.lit(0.0)).alias("mean"), F.lit(k).alias("bucket")) for k in range(buckets)]))
    by = by.withColumn("placed", F.transform(placed, lambda p: p["bucket"]))
    apart = sum((F.pow(F.element_at("placed", k + 1) - k, F.lit(2.0)) for k in range(buckets)), F.lit(0.0))
    spread, cost = F.col("means")[buckets - 1] - F.col("means")[0], cost_bps / 1e4
    out = by.join(every, "symbol").withColumns({"spread": spread, "spearman": 1 - 6 * apart / (buckets * (buckets * buckets - 1.0))})
    return out.select("symbol", "n", "means", "spread", "spearman", "in_market", "always_on", (F.col("means")[buckets - 1] - cost).alias("long_only_net"), (F.col("spread") - 2 * cost).alias("long_short_net"))


def date_split_ridge(panel: DataFrame, xs: list[str], y: str, purge: int = 4, embargo: float = 0.01, alpha: float = 1.0) -> DataFrame:
    """A ridge over a panel's names fitted on train dates, scored by rank correlation on each test date: one row.

    Dates are split as cpcv splits rows; a date counts once for each split that tests it.  Splits of under max(20, factors
    + 2) train rows, dates of under 3 names and dates without spread in signal or y are left out.
    """
    dates = panel.select("ts").distinct().select(F.lit(0).alias("symbol"), "ts", (F.row_number().over(Window.orderBy("ts")) - 1).alias("row_no"))
    roles = cpcv(dates, purge=purge, embargo=embargo).select("ts", "split", "role")
    rows = panel.dropna(subset=[*xs, y]).select("ts", *xs, y).join(roles, "ts")
    train = rows.where("role = 'train'")
    weights = ridge_weights(train, ["split"], xs, y, alpha).where(F.col("n") >= max(20, len(xs) + 2)).withColumnRenamed("n", "n_train")
    stats = train.groupBy("split").agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(xs)])
    fitted = F.broadcast(weights.join(stats, "split"))  # a row for each split
    signal = sum(((F.col(x) - F.col(f"m{i}")) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0) * F.col("weights")[i] for i, x in enumerate(xs)), F.lit(0.0))
    test = rows.where("role = 'test'").join(fitted, "split").select("split", "ts", signal.alias("signal"), F.col(y).alias("y"))
    test = test.select("split", "ts", average_rank("signal", ["split", "ts"]).alias("rx"), average_rank("y", ["split", "ts"]).alias("ry"))
    ics = test.groupBy("split", "ts").agg(F.count(F.lit(1)).alias("k"), correlation("rx", "ry").alias("ic")).where("k >= 3 and ic is not null")
    mean = [F.avg(F.col("weights")[i]) for i in range(len(xs))]
    scored = ics.agg(F.count(F.lit(1)).alias("n_dates"), F.avg("ic").alias("mean_ic"), F.percentile("ic", 0.5).alias("median_ic"), F.stddev_pop("ic").alias("sd_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"))
    return scored.crossJoin(weights.agg(F.count(F.lit(1)).alias("n_splits"), F.array(*mean).alias("weights")))


def spearman_matrix(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Per group and pair of columns (a before b), the correlation of average ranks over rows that have all columns."""
    ranked = rows.dropna(subset=columns)
    ranked = ranked.select(by, *[average_rank(x, [by]).alias(x) for x in columns])
    pairs = list(combinations(columns, 2))
    wide = ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("rho")) for a, b in pairs]))
    return wide.select(by, "n", cells.alias("cell")).select(by, "cell.a", "cell.b", "n", "cell.rho")


def partial_corr(rows: DataFrame, by: str, x: str, y: str, given: str) -> DataFrame:
    """Per group the correlation of x and y once both are freed of `given` by least squares; null if nothing is left."""
    out = rows.dropna(subset=[x, y, given]).groupBy(by).agg(F.count(F.lit(1)).alias("n"), correlation(x, y).alias("xy"), correlation(x, given).alias("xz"), correlation(y, given).alias("yz"))
    left = (1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))
    return out.select(by, "n", F.when(left > 0, (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt(left)).alias("partial"))


def t_statistic(rows: DataFrame, by: str, x: str) -> DataFrame:
    """Per group the one-sample t statistic of the non-null x against 0; null for under two values or no spread."""
    out = rows.groupBy(by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    return out.select(by, "n", "mean", F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt("n"))).alias("t"))


def upsert(ledger: DataFrame, orders: DataFrame) -> DataFrame:
    """The ledger and those orders whose (symbol, decision) it lacks; of repeated new ones any one."""
    keys = ["symbol", "decision"]
    return ledger.unionByName(orders.dropDuplicates(keys).join(ledger.select(*keys), keys, "left_anti").select(*ledger.columns))


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """Per status: orders, mean and sum of finite R multiples, share of them above 0."""
    r = F.when(F.abs("r_multiple") < float("inf"), F.col("r_multiple"))
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean_r"), F.sum(r).alias("sum_r"), F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0)).alias("positive"))
