"""Evaluation of several factors and of meta labels on purged splits, with permutation tests.

A symbol's samples are one numpy matrix (rows times factors); splits are index sets made
from their number alone.  Shuffles are dealt to chunks, so that a symbol's test is spread
over tasks; each chunk holds that symbol's matrix and no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splits(n: int, groups: int = 6, tests: int = 2, purge: int = 0, embargo: float = 0.01) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(train, test) rows of every combination of test groups; train rows near a block of test rows are left out."""
    own = np.array_split(np.arange(n), groups)
    for chosen in combinations(range(groups), tests):
        test = np.zeros(n, bool)
        for g in chosen:
            test[own[g]] = True
        edge = np.diff(test.astype(np.int8), prepend=0, append=0)
        near = test.copy()
        for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            near[max(0, a - purge) : z + math.ceil(embargo * n)] = True
        yield np.flatnonzero(~near), np.flatnonzero(test)


def correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Pearson's; nan for under three values or without spread."""
    if len(x) < 3 or x.std() == 0 or y.std() == 0:
        return math.nan
    return float(np.corrcoef(x, y)[0, 1])


def standardised(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m, s = train.mean(0), train.std(0)
    s = np.where(s == 0, 1.0, s)
    return (train - m) / s, (test - m) / s


def ridge_ics(x: np.ndarray, ys: np.ndarray, purge: int, alpha: float = 1.0, **cv) -> np.ndarray:
    """Out-of-sample correlations of the ridge's signal with each column of ys: (splits, columns), nan where there is none."""
    out = []
    for train, test in splits(len(x), purge=purge, **cv):
        if len(train) < max(10, x.shape[1] + 2) or len(test) < 3:
            continue
        a, b = standardised(x[train], x[test])
        y = ys[train] - ys[train].mean(0)
        signal = b @ np.linalg.solve(a.T @ a + alpha * np.eye(x.shape[1]), a.T @ y)
        s, t = signal - signal.mean(0), ys[test] - ys[test].mean(0)
        norm = np.sqrt((s * s).sum(0) * (t * t).sum(0))
        out.append(np.where(norm > 0, (s * t).sum(0) / np.where(norm > 0, norm, 1), np.nan))
    return np.array(out).reshape(-1, ys.shape[1])


def _chunked(samples: DataFrame, n: int, chunk: int) -> DataFrame:
    """The samples, once for each chunk of shuffles; chunk 0 also holds the labels as they are."""
    return samples.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(max(0, (n - 1) // chunk)))))


def _shuffles(rows: int, n: int, chunk: int, at: int, seed: int) -> list[np.ndarray]:
    return [np.random.default_rng([seed, k]).permutation(rows) for k in range(at * chunk, min(n, (at + 1) * chunk))]


def permutations(samples: DataFrame, xs: list[str], y: str, purge: int, n: int = 200, alpha: float = 1.0, seed: int = 0, chunk: int = 25) -> DataFrame:
    """symbol, perm (-1: the labels as they are), ics (sum over splits), folds: the ridge on each shuffle of y, on the same splits."""
    kind = samples.schema["symbol"].dataType.simpleString()

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.dropna(subset=[*xs, y]).sort_values("bar_no")
        x, at = df[xs].to_numpy(float), int(df["chunk"].iloc[0]) if len(df) else 0
        orders = _shuffles(len(df), n, chunk, at, seed)
        names = list(range(at * chunk, at * chunk + len(orders)))
        if at == 0:
            orders, names = [np.arange(len(df)), *orders], [-1, *names]
        if not len(df) or not orders:
            return pd.DataFrame({"symbol": [], "perm": [], "ics": [], "folds": []})
        values = df[y].to_numpy(float)
        ics = ridge_ics(x, np.stack([values[o] for o in orders], 1), purge, alpha)
        return pd.DataFrame({"symbol": df["symbol"].iloc[0], "perm": names, "ics": np.nansum(ics, 0), "folds": (~np.isnan(ics)).sum(0)})

    rows = _chunked(samples.select("symbol", "bar_no", *xs, y), n, chunk)
    return rows.groupBy("symbol", "chunk").applyInPandas(run, f"symbol {kind}, perm int, ics double, folds long")


def significance(perms: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The mean IC over folds, that of the shuffles, and the share of shuffles (one added) that reach it; pooled over symbols unless by says so."""
    by = by or []
    each = perms.groupBy(*by, "perm").agg(F.sum("ics").alias("s"), F.sum("folds").alias("k")).where("k > 0").withColumn("ic", F.col("s") / F.col("k"))
    real = each.where("perm < 0").select(*by, F.col("ic").alias("real"))
    both = each.where("perm >= 0")
    both = both.join(F.broadcast(real), by) if by else both.crossJoin(F.broadcast(real))  # one row
    reach = F.sum((F.col("ic") >= F.col("real")).cast("long"))
    return both.groupBy(*by, "real").agg(F.avg("ic").alias("null_ic"), ((reach + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.count(F.lit(1)).alias("n")).withColumnRenamed("real", "ic")


def evaluated(evals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Folds of models.factor_eval in one row (per `by`): mean, median, spread of ICs, share above 0, accuracy, long-short return."""
    return evals.where("ic is not null").groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("ic").alias("ic_mean"), F.percentile("ic", 0.5).alias("ic_median"), F.stddev_pop("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"),
        F.avg("accuracy").alias("accuracy"), F.avg("long_short").alias("long_short"),
    )


# ---- meta labels ----


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, ys: np.ndarray, l2: float = 1.0, rate: float = 0.5, rounds: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """(weights, biases) by column of ys, of standardised x: full-batch gradient descent from the base rate; a single class keeps that."""
    n = len(x)
    base = np.clip(ys.mean(0), 1e-6, 1 - 1e-6)
    w, b = np.zeros((x.shape[1], ys.shape[1])), np.log(base / (1 - base))
    live = ys.std(0) > 0
    for _ in range(rounds):
        miss = (sigmoid(x @ w + b) - ys) * live
        w -= rate * (x.T @ miss + l2 * w) / n
        b = b - rate * miss.mean(0)
    return w, b


def area(label: np.ndarray, score: np.ndarray) -> float:
    """Area under the ROC curve, ties counting half; nan for a single class."""
    yes = int(label.sum())
    if not 0 < yes < len(label):
        return math.nan
    rank = pd.Series(score).rank().to_numpy()
    return float((rank[label == 1].sum() - yes * (yes + 1) / 2) / (yes * (len(label) - yes)))


def meta_folds(x, wins: np.ndarray, returns: np.ndarray, purge: int, threshold: float = 0.5, l2: float = 1.0, cost_bps: float = 0.0, top: float | None = None) -> Iterator[tuple[int, int, dict]]:
    """(column, split, figures) of a rater of bets fitted on train rows: what the bets it takes earn, beside all of them."""
    for number, (train, test) in enumerate(splits(len(x), purge=purge)):
        if len(train) < max(20, x.shape[1] + 2) or len(test) < 5:
            continue
        a, b = standardised(x[train], x[test])
        w, bias = logistic(a, wins[train], l2)
        odds = sigmoid(b @ w + bias)
        net = returns[test] - cost_bps / 1e4
        for j in range(wins.shape[1]):
            p, label, r = odds[:, j], wins[test, j], net[:, j]
            taken = p >= (threshold if top is None else np.quantile(p, 1 - top))
            some = bool(taken.any())
            meta, primary = (float(r[taken].mean()) if some else 0.0), float(r.mean())
            yield j, number, {"n_train": len(train), "n_test": len(test), "auc": area(label, p), "precision": float(label[taken].mean()) if some else math.nan, "primary_return": primary, "meta_return": meta, "lift": meta - primary, "taken": float(taken.mean())}


FOLD = "split int, n_train long, n_test long, auc double, precision double, primary_return double, meta_return double, lift double, taken double"


def meta_eval(samples: DataFrame, xs: list[str], purge: int, **how) -> DataFrame:
    """Per symbol and split what meta_folds says of its bets (columns xs, win, ret, bar_no)."""
    kind = samples.schema["symbol"].dataType.simpleString()

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.dropna(subset=[*xs, "win", "ret"]).sort_values("bar_no")
        rows = [{"symbol": df["symbol"].iloc[0], "split": s, **f} for _, s, f in meta_folds(df[xs].to_numpy(float), df[["win"]].to_numpy(float), df[["ret"]].to_numpy(float), purge, **how)] if len(df) else []
        return pd.DataFrame(rows, columns=["symbol", *[x.split()[0] for x in FOLD.split(", ")]])

    return samples.select("symbol", "bar_no", *xs, "win", "ret").groupBy("symbol").applyInPandas(run, f"symbol {kind}, {FOLD}")


def meta_summary(folds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Folds in one row (per `by`); precision and AUC over the folds that have them."""

    def real(c):
        return F.avg(F.when(~F.isnan(c), F.col(c)))

    return folds.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_folds"), real("auc").alias("auc"), real("precision").alias("precision"), F.avg("primary_return").alias("primary_return"), F.avg("meta_return").alias("meta_return"),
        F.avg("lift").alias("lift"), F.avg((F.col("lift") > 0).cast("double")).alias("folds_beaten"), F.avg("taken").alias("taken"),
    )


def meta_permutations(samples: DataFrame, xs: list[str], purge: int, n: int = 200, threshold: float = 0.55, seed: int = 0, chunk: int = 25, **how) -> DataFrame:
    """Per symbol: AUC and lift of the rater, those of shuffles of (win, ret) together, and the shares of shuffles that reach them."""
    kind = samples.schema["symbol"].dataType.simpleString()

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.dropna(subset=[*xs, "win", "ret"]).sort_values("bar_no")
        at = int(df["chunk"].iloc[0]) if len(df) else 0
        orders = _shuffles(len(df), n, chunk, at, seed)
        names = list(range(at * chunk, at * chunk + len(orders)))
        if at == 0:
            orders, names = [np.arange(len(df)), *orders], [-1, *names]
        out: dict[int, list] = {}
        if len(df) and orders:
            wins, returns = (np.stack([df[c].to_numpy(float)[o] for o in orders], 1) for c in ("win", "ret"))
            for j, _, f in meta_folds(df[xs].to_numpy(float), wins, returns, purge, threshold, **how):
                out.setdefault(names[j], []).append((f["auc"], f["lift"]))
        rows = [(df["symbol"].iloc[0], k, float(np.nanmean([a for a, _ in v])) if any(a == a for a, _ in v) else None, float(np.mean([b for _, b in v]))) for k, v in out.items()]
        return pd.DataFrame(rows, columns=["symbol", "perm", "auc", "lift"])

    rows = _chunked(samples.select("symbol", "bar_no", *xs, "win", "ret"), n, chunk).groupBy("symbol", "chunk").applyInPandas(run, f"symbol {kind}, perm int, auc double, lift double")
    real = rows.where("perm < 0").select("symbol", F.col("auc").alias("real_auc"), F.col("lift").alias("real_lift"))
    both = rows.where("perm >= 0").join(real, "symbol")

    def reached(c):
        return (F.sum((F.col(c) >= F.col(f"real_{c}")).cast("long")) + 1) / (F.count(c) + 1)

    return both.groupBy("symbol", "real_auc", "real_lift").agg(F.avg("auc").alias("null_auc"), F.avg("lift").alias("null_lift"), reached("auc").alias("p_auc"), reached("lift").alias("p_lift"), F.count(F.lit(1)).alias("n"))


def swing_ratings(samples: DataFrame, xs: list[str], rr: float, purge: int, share: float = 0.7, l2: float = 1.0) -> DataFrame:
    """Bets rated by a model of the first `share` of a symbol's bets, from `purge` bets later on: P(win), expected R and whether to take it."""
    kind = samples.schema["symbol"].dataType.simpleString()

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.dropna(subset=[*xs, "win"]).sort_values("bar_no")
        cut = int(len(df) * share)
        late = df.iloc[cut + purge :]
        if cut < 2 or not len(late):
            return pd.DataFrame({"symbol": [], "bar_no": [], "p_win": [], "expected_r": [], "take": [], "win": [], "holding": []})
        a, b = standardised(df[xs].to_numpy(float)[:cut], late[xs].to_numpy(float))
        w, bias = logistic(a, df[["win"]].to_numpy(float)[:cut], l2)
        p = sigmoid(b @ w + bias)[:, 0]
        return pd.DataFrame({"symbol": late["symbol"], "bar_no": late["bar_no"], "p_win": p, "expected_r": (1 + rr) * p - 1, "take": (1 + rr) * p > 1, "win": late["win"], "holding": late["holding"]})

    return samples.select("symbol", "bar_no", *xs, "win", "holding").groupBy("symbol").applyInPandas(run, f"symbol {kind}, bar_no long, p_win double, expected_r double, take boolean, win int, holding long")


# ---- the cross-section ----


def panel_permutations(panel: DataFrame, xs: list[str], y: str, purge: int = 4, embargo: float = 0.01, n: int = 200, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """Shuffles of y among the names of a date (perm -1: none), each scored by the ridge of train dates on test dates: perm, ics, folds.

    Two passes over the dates, a date to a group: sums of products by date and shuffle, from which each split's and
    shuffle's weights follow (splits * n rows of len(xs) numbers, whatever the panel's size), then rank correlations.
    """
    spark = panel.sparkSession
    panel = panel.dropna(subset=[*xs, y]).select("ts", "symbol", *xs, y)
    dates = sorted(r["ts"] for r in panel.select("ts").distinct().collect())  # a value for each date
    number = {t: i for i, t in enumerate(dates)}
    sets = [(set(train.tolist()), set(test.tolist())) for train, test in splits(len(dates), purge=purge, embargo=embargo)]
    d, perms = len(xs), [-1, *range(n)]

    def order(df: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
        df = df.sort_values("symbol")
        at, values = number[df["ts"].iloc[0]], df[y].to_numpy(float)
        shuffled = [values if k < 0 else values[np.random.default_rng([seed, k, at]).permutation(len(df))] for k in perms]
        return at, df[xs].to_numpy(float), np.stack(shuffled, 1)

    def sums(df: pd.DataFrame) -> pd.DataFrame:
        at, x, ys = order(df)
        return pd.DataFrame({"at": [at], "n": [len(x)], "x": [x.sum(0)], "xx": [(x.T @ x).ravel()], "y": [ys.sum(0)], "xy": [(x.T @ ys).ravel()]})

    by_date = panel.groupBy("ts").applyInPandas(sums, "at int, n long, x array<double>, xx array<double>, y array<double>, xy array<double>")
    # a split's sums are added up on the executors; what comes to the driver is a row for each split
    chosen = spark.createDataFrame([(t, s) for s, (train, _) in enumerate(sets) for t in sorted(train)], "at int, split int")
    names = ["x", "xx", "y", "xy"]

    def add(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"split": [df["split"].iloc[0]], "n": [df["n"].sum()], **{c: [np.sum(np.stack(df[c].to_list()), 0)] for c in names}})

    joined = by_date.join(F.broadcast(chosen), "at")
    totals = joined.groupBy("split").applyInPandas(add, "split int, n long, x array<double>, xx array<double>, y array<double>, xy array<double>").collect()
    fitted: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for r in totals:
        m = r["n"]
        if m < max(20, d + 2):
            continue
        mean, cov = np.array(r["x"]) / m, np.array(r["xx"]).reshape(d, d) / m
        cov = cov - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        sd = np.where(sd < 1e-12, 1.0, sd)
        right = (np.array(r["xy"]).reshape(d, len(perms)) - np.outer(mean, np.array(r["y"]))) / sd[:, None]
        fitted[r["split"]] = (mean, sd, np.linalg.solve(m * cov / np.outer(sd, sd) + alpha * np.eye(d), right))

    def scored(df: pd.DataFrame) -> pd.DataFrame:
        at, x, ys = order(df)
        total, count = np.zeros(len(perms)), np.zeros(len(perms), np.int64)
        if len(x) >= 3:
            ranks = pd.DataFrame(ys).rank().to_numpy()
            for s, (mean, sd, w) in fitted.items():
                if at in sets[s][1]:
                    found = pd.DataFrame(np.round((x - mean) / sd @ w, 12)).rank().to_numpy()
                    a, b = found - found.mean(0), ranks - ranks.mean(0)
                    norm = np.sqrt((a * a).sum(0) * (b * b).sum(0))
                    good = norm > 0
                    total += np.where(good, (a * b).sum(0) / np.where(good, norm, 1), 0)
                    count += good
        return pd.DataFrame({"perm": perms, "ics": total, "folds": count})

    found = panel.groupBy("ts").applyInPandas(scored, "perm int, ics double, folds long")
    return found.groupBy("perm").agg(F.sum("ics").alias("ics"), F.sum("folds").alias("folds"))


def clusters(names: list[str], rho: dict[tuple[str, str], float], threshold: float = 0.7) -> dict[str, int]:
    """Average linkage on 1 - |rho|, cut at 1 - threshold: the cluster number of each name, from 1 by first member.

    Merges the nearest two clusters until none are near enough; the number of features bounds the work.
    """
    far = {(a, b): 1 - abs(rho.get((a, b), rho.get((b, a), 0.0)) or 0.0) for a in names for b in names if a != b}
    groups = [[x] for x in names]
    while len(groups) > 1:
        gap, i, j = min((float(np.mean([far[a, b] for a in g for b in h])), i, i + 1 + j) for i, g in enumerate(groups) for j, h in enumerate(groups[i + 1 :]))
        if gap > 1 - threshold + 1e-12:
            break
        groups[i] = groups[i] + groups.pop(j)
    groups.sort(key=lambda g: min(names.index(x) for x in g))
    return {x: k for k, g in enumerate(groups, 1) for x in g}


def purge_report(names: list[str], rho: dict[tuple[str, str], float], ics: dict[str, float], threshold: float = 0.7, least: float = 0.05) -> list[dict]:
    """A row per feature: its cluster, its IC, whether it stands for the cluster (largest |IC|) and whether it clears `least`."""
    of = clusters(names, rho, threshold)
    best = {k: max((x for x in names if of[x] == k), key=lambda x: abs(ics.get(x) or 0.0)) for k in set(of.values())}
    return [{"feature": x, "cluster": of[x], "ic": ics.get(x), "representative": best[of[x]] == x, "clears": abs(ics.get(x) or 0.0) >= least} for x in names]


def survivorship(perms: DataFrame, dead: DataFrame, rates: list[float]) -> DataFrame:
    """significance() of the living symbols together with the first round(rate * living / (1 - rate)) dead ones, per rate.

    perms: permutations() over all symbols; dead: (symbol, rank from 0). A symbol is evaluated once, whatever the rates.
    """
    spark = perms.sparkSession
    table = spark.createDataFrame([(float(r),) for r in rates], "rate double")
    living = perms.join(F.broadcast(dead), "symbol", "left_anti").agg(F.countDistinct("symbol").alias("living"))
    marked = perms.join(F.broadcast(dead), "symbol", "left")
    bound = table.crossJoin(living).withColumn("most", F.round(F.col("rate") * F.col("living") / (1 - F.col("rate"))))
    rows = marked.crossJoin(F.broadcast(bound)).where("rank is null or rank < most")  # a row for each rate
    return significance(rows, ["rate", "most"])
