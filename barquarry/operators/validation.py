"""Out-of-sample evaluation: purged splits, information coefficients, ranks, buckets, permutations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barquarry.operators.labels import average_rank


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of the rows that have both; null without spread, where the built-in one fails in ANSI mode."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    sx, sy = F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    return F.when((sx > 0) & (sy > 0), F.try_divide(F.covar_pop(x, y), sx * sy))


def split_table(spark: SparkSession, groups: int = 6, tests: int = 2) -> DataFrame:
    """(split, grp): the test groups of every combination; C(groups, tests) * tests rows."""
    if not 1 <= tests < groups:
        raise ValueError("tests must be at least 1 and below groups")
    rows = [(k, g) for k, chosen in enumerate(combinations(range(groups), tests)) for g in chosen]
    return spark.createDataFrame(rows, "split int, grp int")


def cpcv(samples: DataFrame, groups: int = 6, tests: int = 2, purge: int = 0, embargo: float = 0.0) -> DataFrame:
    """samples(symbol, row_no, ...) times splits with role: test, train or purged.

    A train row is purged if it lies within `purge` rows before a block of test rows, or within
    ceil(embargo * n) rows after it; adjacent test groups are one block.
    """
    spark = samples.sparkSession
    by = Window.partitionBy("symbol").orderBy("row_no")
    rows = samples.withColumn("grp", F.ntile(groups).over(by) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    chosen = split_table(spark, groups, tests)
    ends = rows.groupBy("symbol", "grp").agg(F.min("row_no").alias("a"), F.max("row_no").alias("b"), F.first("n").alias("n"))
    blocks = ends.join(F.broadcast(chosen), "grp")  # a row for each symbol, split and test group
    follow = Window.partitionBy("symbol", "split").orderBy("grp")
    blocks = blocks.withColumn("island", F.col("grp") - F.row_number().over(follow))
    blocks = blocks.groupBy("symbol", "split", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.first("n").alias("n"))
    blocks = blocks.groupBy("symbol", "split").agg(F.collect_list(F.struct("a", "b")).alias("blocks"))  # at most `tests` of them
    out = rows.join(blocks, "symbol")
    after = F.ceil(F.col("n") * embargo)
    r = F.col("row_no")
    test = F.exists("blocks", lambda x: r.between(x["a"], x["b"]))
    near = F.exists("blocks", lambda x: ((r >= x["a"] - purge) & (r < x["a"])) | ((r > x["b"]) & (r <= x["b"] + after)))
    return out.withColumn("role", F.when(test, "test").when(near, "purged").otherwise("train")).drop("blocks", "n")


def single_factor_ic(members: DataFrame, x: str, y: str) -> DataFrame:
    """Per symbol and split: the sign of the train covariance times the test correlation."""
    train, test = F.col("role") == "train", F.col("role") == "test"

    def on(who, c):
        return F.when(who, F.col(c))

    out = members.groupBy("symbol", "split").agg(
        F.covar_pop(on(train, x), on(train, y)).alias("cov"), correlation(on(test, x), on(test, y)).alias("corr"), F.count(on(test, x)).alias("n_test"), F.stddev_pop(on(test, x)).alias("sx"), F.stddev_pop(on(test, y)).alias("sy")
    )
    good = (F.col("n_test") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0)
    return out.select("symbol", "split", "n_test", F.when(good, F.signum("cov") * F.col("corr")).alias("ic"))


def rank_ic(panel: DataFrame, x: str, y: str = "forward") -> DataFrame:
    """Spearman correlation of a factor with the forward return by date, for dates of three names and more."""
    r = panel.withColumn("rx", average_rank(x, ["ts"])).withColumn("ry", average_rank(y, ["ts"]))
    out = r.groupBy("ts").agg(correlation("rx", "ry").alias("ic"), F.count(F.lit(1)).alias("n"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))
    return out.where("n >= 3").select("ts", "n", F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.col("ic")).alias("ic"))


def auc(scored: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by Mann-Whitney ranks, ties counting half."""
    r = scored.withColumn("r", average_rank(score, [by]))
    hit = F.col(label) == 1
    out = r.groupBy(by).agg(F.sum(F.when(hit, F.col("r"))).alias("sum"), F.sum(hit.cast("long")).alias("pos"), F.sum((~hit).cast("long")).alias("neg"))
    area = (F.col("sum") - F.col("pos") * (F.col("pos") + 1) / 2.0) / (F.col("pos") * F.col("neg"))
    return out.select(by, "pos", "neg", F.when((F.col("pos") > 0) & (F.col("neg") > 0), area).alias("auc"))


def bucket_returns(samples: DataFrame, x: str, y: str, n: int = 5) -> DataFrame:
    """Mean y of the rows between the quantile edges of x, by symbol and bucket (0 is lowest)."""
    edges = samples.groupBy("symbol").agg(F.percentile(x, [k / n for k in range(1, n)]).alias("edges"))
    rows = samples.join(edges, "symbol").withColumn("bucket", F.size(F.filter("edges", lambda e: e <= F.col(x))))
    return rows.groupBy("symbol", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"))


def permutation_ic(members: DataFrame, x: str, y: str, n: int = 200, seed: int = 0) -> DataFrame:
    """Label-shuffle test of one factor's out-of-sample IC over cpcv's members: symbol, ic, null_ic, p_value, n.

    Each of n shuffles of y (within a symbol, by hash) is evaluated on the same purged splits as y itself: a ridge fitted
    on train rows, the IC of its signal on test rows, the mean over splits.  With one factor that IC is the sign of the
    train covariance times the test correlation.  Splits of under 10 train or 3 test rows, or without spread, are left out;
    a shuffle without any split left does not count in n.  p is (shuffles that reach the real IC + 1) / (n + 1).

    Rows that have the same role in every split are summed once per shuffle; splits only add those sums up.
    """
    role = F.sort_array(F.collect_list(F.struct("split", "role")))
    rows = members.groupBy("symbol", "row_no").agg(role.alias("roles"), F.first(x).alias("x"), F.first(y).alias("y"))
    whole = Window.partitionBy("symbol")  # sums of squares lose little when they are taken about the mean
    rows = rows.select("symbol", "row_no", "roles", *[(F.col(c) - F.avg(c).over(whole)).alias(c) for c in ("x", "y")])
    rows = rows.withColumn("at", F.row_number().over(whole.orderBy("row_no")))
    perms = members.sparkSession.range(n).select(F.col("id").cast("int").alias("perm"))
    order = Window.partitionBy("symbol", "perm").orderBy(F.xxhash64(F.lit(seed), "perm", "row_no"), "row_no")
    dealt = rows.select("symbol", "row_no", "y").crossJoin(F.broadcast(perms)).select("symbol", "perm", "y", F.row_number().over(order).alias("at"))
    dealt = dealt.unionByName(rows.select("symbol", F.lit(-1).alias("perm"), "y", "at"))
    both = dealt.join(rows.select("symbol", "at", "roles", "x"), ["symbol", "at"])
    sums = {"n": F.lit(1), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y")}
    ends = {f"{f}_{c}": getattr(F, f)(c) for f in ("min", "max") for c in ("x", "y")}
    parts = both.groupBy("symbol", "perm", "roles").agg(*[F.sum(v).alias(f"s_{k}") for k, v in sums.items()], *[v.alias(k) for k, v in ends.items()])
    parts = parts.select("symbol", "perm", F.explode("roles").alias("r"), *[f"s_{k}" for k in sums], *ends).where("r.role != 'purged'")
    total = [F.sum(f"s_{k}").alias(k) for k in sums]
    spread = [(F.max(f"max_{c}") > F.min(f"min_{c}")).alias(f"{c}_spread") for c in ("x", "y")]
    by = parts.groupBy("symbol", "perm", F.col("r.split").alias("split"), F.col("r.role").alias("role")).agg(*total, *spread)
    by = by.withColumn("cov", F.col("n") * F.col("xy") - F.col("x") * F.col("y")).withColumn("good", F.col("x_spread") & F.col("y_spread"))
    by = by.withColumn("var", (F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y")))
    train, test = F.col("role") == "train", F.col("role") == "test"
    sign = F.max(F.when(train & F.col("good") & (F.col("n") >= 10) & (F.col("cov") != 0), F.signum("cov")))
    corr = F.max(F.when(test & F.col("good") & (F.col("n") >= 3) & (F.col("var") > 0), F.col("cov") / F.sqrt(F.when(F.col("var") > 0, F.col("var")))))
    ics = by.groupBy("symbol", "perm", "split").agg((sign * corr).alias("ic")).groupBy("symbol", "perm").agg(F.avg("ic").alias("ic"))
    real = ics.where("perm = -1").select("symbol", F.col("ic").alias("real"))
    null = F.when(F.col("perm") >= 0, F.col("ic"))
    out = ics.join(real, "symbol").groupBy("symbol", "real").agg(F.sum((null >= F.col("real")).cast("int")).alias("k"), F.count(null).alias("n"), F.avg(null).alias("null_ic"))
    p = F.when(F.col("real").isNotNull(), (F.coalesce("k", F.lit(0)) + 1) / (F.col("n") + 1.0))
    return out.select("symbol", F.col("real").alias("ic"), "null_ic", p.alias("p_value"), "n")
