"""Registered queries over factor models and the paper ledger, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquarry.operators import labels, models, validation
from barquarry.plans import queries as q
from barquarry.plans.queries import register, rounded

COLUMNS = ["r_mom", "r_mom_long", "r_vol", "r_trend", "forward"]


def _ledger(s: SparkSession, d: str) -> DataFrame:
    orders = q._resolved(s, d)
    return models.upsert(orders.where("decision % 50 = 0"), orders)


def _factor_ics(s: SparkSession, d: str) -> DataFrame:
    """Each factor's mean rank IC over dates."""
    p = labels.panel(q.daily(s, d), least=5)
    tall = p.unpivot(["ts", "forward"], COLUMNS[:4], "factor", "x")
    tall = tall.withColumn("rx", labels.average_rank("x", ["ts", "factor"])).withColumn("ry", labels.average_rank("forward", ["ts", "factor"]))
    by = tall.groupBy("ts", "factor").agg(F.round(validation.correlation("rx", "ry"), 9).alias("ic"))
    return by.groupBy("factor").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"))


CHECKED = """tr0 AS (SELECT symbol, split, count(*) AS n_train, avg(x) AS m, stddev_pop(x) AS s, covar_pop(y, x) AS c FROM mem WHERE role = 'train' GROUP BY 1, 2),
tw AS (SELECT symbol, split, n_train, m, CASE WHEN s > 0 THEN s ELSE 1 END AS s, n_train * c / (CASE WHEN s > 0 THEN s ELSE 1 END) / (n_train * (CASE WHEN s > 0 THEN 1 ELSE 0 END) + 1) AS w FROM tr0 WHERE n_train >= 10),
sg AS (SELECT symbol, split, n_train, y, (x - m) / s * w AS g FROM mem JOIN tw USING (symbol, split) WHERE role = 'test')"""
EVAL = f"""WITH {q.BARS}, {q.CPCV}, {CHECKED} SELECT symbol, split::INTEGER AS split, n_train, count(*) AS n_test, round(corr(g, y), 6) AS ic,
  round(avg(CASE WHEN sign(g) = sign(y) THEN 1::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(sign(g) * y), 6) AS long_short FROM sg GROUP BY 1, 2, 3"""
register("v05_factor_eval", lambda s, d: rounded(models.factor_eval(q._members(s, d), "x", "y"), "ic", "accuracy", "long_short"), EVAL)
register("v07_factor_buckets", lambda s, d: rounded(models.factor_buckets(q._members(s, d, 1), "x", "y"), "spread", "spearman", "in_market", "always_on", "long_only_net", "long_short_net").withColumn("means", F.transform("means", lambda m: F.round(m, 6))))
register("v14_date_split_ridge", lambda s, d: rounded(models.date_split_ridge(labels.panel(q.daily(s, d)), COLUMNS[:4], "forward"), "mean_ic", "median_ic", "sd_ic", "positive").withColumn("weights", F.transform("weights", lambda w: F.round(w, 6))))
register("v03_ridge_weights", lambda s, d: models.ridge_weights(labels.panel(q.daily(s, d)), ["symbol"], COLUMNS[:4], "forward"))
RANKED = ", ".join(f"rank() OVER (PARTITION BY symbol ORDER BY {x}) + (count(*) OVER (PARTITION BY symbol, {x}) - 1) / 2.0::DOUBLE AS {x}" for x in COLUMNS)
CELLS = " UNION ALL ".join(f"SELECT symbol, '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS rho FROM rk GROUP BY symbol" for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :])
PANEL9 = f"pr AS (SELECT symbol, {', '.join(f'round({x}, 9) AS {x}' for x in COLUMNS)} FROM panel)"
register("v16_spearman_matrix", lambda s, d: rounded(models.spearman_matrix(rounded(labels.panel(q.daily(s, d)), *COLUMNS, places=9), "symbol", COLUMNS), "rho"),
         f"WITH {q.BARS}, {q.PANEL}, {PANEL9}, rk AS (SELECT symbol, {RANKED} FROM pr) {CELLS}")
register("v17_partial_corr", lambda s, d: rounded(models.partial_corr(labels.panel(q.daily(s, d)), "symbol", "r_mom", "forward", "r_vol"), "partial"),
         f"WITH {q.BARS}, {q.PANEL}, k AS (SELECT symbol, count(*) AS n, corr(r_mom, forward) AS xy, corr(r_mom, r_vol) AS xz, corr(forward, r_vol) AS yz FROM panel GROUP BY symbol) SELECT symbol, n, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM k")
register("v19_t_statistic", lambda s, d: rounded(models.t_statistic(q._samples(s, d), "symbol", "y"), "mean", "t"),
         f"WITH {q.BARS}, {q.SAMPLES} SELECT symbol, count(*) AS n, round(avg(y), 6) AS mean, round(avg(y) / (stddev_samp(y) / sqrt(count(*))), 6) AS t FROM sm GROUP BY symbol")
FACTORS = " UNION ALL ".join(f"SELECT ts, '{x}' AS factor, {x} AS x, forward FROM panel" for x in COLUMNS[:4])
register("v14_factor_ics", lambda s, d: rounded(_factor_ics(s, d), "mean_ic", "positive"),
         f"""WITH {q.BARS}, {q.PANEL}, tall AS ({FACTORS}), r AS (SELECT ts, factor, rank() OVER (PARTITION BY ts, factor ORDER BY x) + (count(*) OVER (PARTITION BY ts, factor, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY ts, factor ORDER BY forward) + (count(*) OVER (PARTITION BY ts, factor, forward) - 1) / 2.0::DOUBLE AS ry FROM tall), i AS (SELECT ts, factor, round(corr(rx, ry), 9) AS ic FROM r GROUP BY 1, 2)
SELECT factor, count(ic) AS n, round(avg(ic), 6) AS mean_ic, round(avg((ic > 0)::INTEGER::DOUBLE), 6) AS positive FROM i GROUP BY factor""")  # fmt: skip
register("w03_ledger_upsert", lambda s, d: _ledger(s, d).select("symbol", "decision", "status"),
         f"WITH {q.BARS}, {q.PAPER} SELECT symbol, decision, status FROM paper")
register("w04_ledger_summary", lambda s, d: rounded(models.ledger_summary(_ledger(s, d)), "mean_r", "sum_r", "positive", places=4),
         f"WITH {q.BARS}, {q.PAPER} SELECT status, count(*) AS n, round(avg(r), 4) AS mean_r, round(sum(r), 4) AS sum_r, round(avg(CASE WHEN r > 0 THEN 1::DOUBLE WHEN r IS NOT NULL THEN 0 END), 4) AS positive FROM paper GROUP BY status")
