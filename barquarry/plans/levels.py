"""Registered queries over nodes, shape, confluence and trade plans, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquarry.operators import nodes, profile, regime, scoring
from barquarry.plans import queries as q
from barquarry.plans.queries import register, rounded

KERNEL = ", ".join(f"{x!r}::DOUBLE" for x in nodes.weights())
SMOOTH = f"""sm AS (SELECT *, list_max(s) AS top FROM (SELECT symbol, v, n, list_transform(range(0, n), lambda i: round(list_sum(list_transform(range(-4, 5), lambda k:
  [{KERNEL}][k + 5] * v[(CASE WHEN (i + k + 2 * n) % (2 * n) < n THEN (i + k + 2 * n) % (2 * n) ELSE 2 * n - 1 - (i + k + 2 * n) % (2 * n) END) + 1])), 6)) AS s FROM v))"""


def peaks_sql(name: str, signal: str, share: float) -> str:
    return f"""{name}1 AS (SELECT symbol, n, top, x, unnest(list_filter(range(1, n - 1), lambda i: x[i] < x[i + 1] AND x[i + 2] <= x[i + 1])) AS i FROM (SELECT *, {signal} AS x FROM sm)),
{name}2 AS (SELECT *, x[i + 1] AS h, list_min(list_filter(range(i + 1, n), lambda j: x[j + 1] <> x[i + 1])) AS j FROM {name}1),
{name}3 AS (SELECT *, (i + j - 1) // 2 AS bin, coalesce(list_max(list_filter(range(0, i), lambda k: x[k + 1] > h)), -1) AS l, coalesce(list_min(list_filter(range(j, n), lambda k: x[k + 1] > h)), n) AS r FROM {name}2 WHERE x[j + 1] < h),
{name} AS (SELECT symbol, bin::INTEGER AS bin FROM {name}3 WHERE round(h - greatest(list_min(x[l + 2:bin + 1]), list_min(x[bin + 1:r])), 6) >= round({share}::DOUBLE * top, 6))"""


NODES = f"""{SMOOTH}, {peaks_sql('hp', 's', 0.1)}, {peaks_sql('lp', 'list_transform(s, lambda y: round(top - y, 6))', 0.1)},
nd AS (SELECT symbol, 'HVN' AS kind, bin FROM hp UNION SELECT symbol, 'HVN', poc_bin FROM poc UNION SELECT symbol, 'LVN', bin FROM lp),
nodes AS (SELECT symbol, kind, row_number() OVER (PARTITION BY symbol, kind ORDER BY CASE WHEN kind = 'HVN' THEN -v[bin + 1] ELSE v[bin + 1] END, bin)::INTEGER AS rank, bin, price, v[bin + 1] AS vol, 100 * v[bin + 1] / list_sum(v) AS pct
  FROM nd JOIN v USING (symbol) JOIN hist USING (symbol, bin) QUALIFY rank <= 5)"""
LEVELS = """lev AS (SELECT symbol, lo + (poc_bin + 0.5) * size AS poc, lo + (val_bin + 0.5) * size AS val, lo + (vah_bin + 0.5) * size AS vah, size, (poc_bin + 0.5) / e.n AS poc_location FROM area JOIN poc USING (symbol) JOIN e USING (symbol))"""


def _profiled(s: SparkSession, d: str, symbol: str = "l_linenumber") -> tuple[DataFrame, DataFrame, DataFrame]:
    b = q.daily(s, d, symbol)
    e = profile.bins(b)
    return b, e, profile.histogram(b, e)


def _levels(s: SparkSession, d: str) -> DataFrame:
    _, e, h = _profiled(s, d)
    return nodes.levels(h, e, profile.value_area(h))


def _nearest(s: SparkSession, d: str) -> DataFrame:
    b, _, h = _profiled(s, d)
    return nodes.nearest_node(nodes.nodes(h), regime.latest(b).select("symbol", F.col("close").alias("x")))


def _shape(s: SparkSession, d: str) -> DataFrame:
    _, e, h = _profiled(s, d)
    return nodes.shape(h, nodes.levels(h, e, profile.value_area(h)))


def _table(s: SparkSession, d: str) -> DataFrame:
    h = _profiled(s, d)[2]
    return nodes.with_nodes(h, nodes.nodes(h)).select("symbol", "bin", "is_hvn", "is_lvn")


AREA = f"WITH RECURSIVE {q.SHAPE}, {q.AREA}"
register("p07_nodes", lambda s, d: rounded(rounded(nodes.nodes(_profiled(s, d)[2]), "volume", "volume_pct", places=4), "price"),
         f"{AREA}, {NODES} SELECT symbol, kind, rank, bin, round(price, 6) AS price, round(vol, 4) AS volume, round(pct, 4) AS volume_pct FROM nodes")
register("p10_node_flags", _table,
         f"{AREA}, {NODES} SELECT h.symbol, h.bin, coalesce(bool_or(kind = 'HVN'), false) AS is_hvn, coalesce(bool_or(kind = 'LVN'), false) AS is_lvn FROM hist h LEFT JOIN nodes k ON k.symbol = h.symbol AND k.bin = h.bin GROUP BY 1, 2")
register("p08_levels", lambda s, d: rounded(_levels(s, d), "poc", "val", "vah", "width", "bin_size", "poc_location", "compression"),
         f"{AREA}, {LEVELS} SELECT symbol, round(poc, 6) AS poc, round(val, 6) AS val, round(vah, 6) AS vah, round(vah - val, 6) AS width, round(size, 6) AS bin_size, round(poc_location, 6) AS poc_location, round((vah - val) / abs(poc), 6) AS compression FROM lev")
NEAR = "nn AS (SELECT symbol, any_value(x) AS x, arg_min(kind, (round(abs(price - x), 9), kind, rank)) AS kind, arg_min(price, (round(abs(price - x), 9), kind, rank)) AS price, arg_min(price, (round(abs(price - x), 9), rank)) FILTER (kind = 'HVN') AS hvn, arg_min(price, (round(abs(price - x), 9), rank)) FILTER (kind = 'LVN') AS lvn FROM nodes JOIN ends USING (symbol) GROUP BY symbol)"
register("p09_nearest_node", lambda s, d: rounded(_nearest(s, d), "x", "price", "hvn", "lvn"),
         f"{AREA}, {NODES}, ends AS (SELECT symbol, arg_max(close, bar_no) AS x FROM bars GROUP BY symbol), {NEAR} SELECT symbol, round(x, 6) AS x, kind, round(price, 6) AS price, round(hvn, 6) AS hvn, round(lvn, 6) AS lvn FROM nn")
register("t08_shape", lambda s, d: rounded(_shape(s, d), "valley_ratio", places=4),
         f"""{AREA}, {SMOOTH}, {peaks_sql('dp', 's', 0.15)}, {LEVELS}, m1 AS (SELECT symbol, sum(volume * price) / sum(volume) AS mean FROM hist GROUP BY symbol),
mo AS (SELECT symbol, sum(volume * (price - mean)^3) / sum(volume) / sqrt(sum(volume * (price - mean)^2) / sum(volume))^3 AS skew FROM hist JOIN m1 USING (symbol) GROUP BY symbol),
pp AS (SELECT symbol, count(*) AS n_peaks, list_sort(list({{'w': v[bin + 1], 'bin': bin}}), 'DESC')[1:2] AS p FROM dp JOIN v USING (symbol) GROUP BY symbol),
k AS (SELECT v.symbol, coalesce(n_peaks, 0) AS n_peaks, skew, poc_location, coalesce(CASE WHEN n_peaks >= 2 THEN list_min(v[least(p[1].bin, p[2].bin) + 1:greatest(p[1].bin, p[2].bin) + 1]) / (list_sum(v) / n) END, 1) AS ratio FROM v JOIN mo USING (symbol) JOIN lev USING (symbol) LEFT JOIN pp ON pp.symbol = v.symbol)
SELECT symbol, n_peaks, n_peaks = 2 AND ratio < 0.2 AS is_double, round(ratio, 4) AS valley_ratio, CASE WHEN n_peaks = 2 AND ratio < 0.2 THEN 4 WHEN skew < -0.5 AND poc_location > 0.7 THEN 1 WHEN skew > 0.5 AND poc_location < 0.3 THEN 2 WHEN abs(skew) < 0.5 THEN 3 ELSE 0 END AS shape FROM k""")  # fmt: skip

# confluence and plans, on the universe of suppliers
UNIVERSE = "l_suppkey"


def _events(b: DataFrame) -> DataFrame:
    out = regime.dry_ups(b, 0.8).unionByName(regime.climaxes(b, 1.6, 1.0)).unionByName(regime.divergences(b)).unionByName(regime.accumulations(b))
    return rounded(out, "strength")


def _scores(s: SparkSession, d: str) -> DataFrame:
    b = q.daily(s, d, UNIVERSE).persist()  # profile, gauges and events all read it: one scan and one shuffle instead of one for each
    return scoring.confluence(b, _events(b))


EVENTS = " UNION ALL ".join(f"SELECT * FROM (WITH {cte} {body})" for cte, body in (
    (f"y AS (SELECT *, {q.MA} / CASE WHEN count(volume) {q.frame(60)} >= 30 THEN avg(volume) {q.frame(60)} END AS ratio FROM bars)", q._events_sql("y", "ratio <= 0.8", 3, "ratio", "dry_up", "'neutral'", "1 - ratio")),
    (f"y AS (SELECT *, volume / ({q.MA}) AS ratio FROM atr)", q._events_sql("y", "ratio >= 1.6 AND (high - low) / atr >= 1.0", 1, "-ratio", "climax", "CASE WHEN close >= open THEN 'bearish' ELSE 'bullish' END", "ratio")),
    (q.DIV, " UNION ALL ".join(q._events_sql("y", f"{hit} AND vs < -5e-4::DOUBLE", 3, "-bar_no", "divergence", f"'{name}'", "abs(vs) / 5e-4::DOUBLE") for name, hit in (("bearish", "ps > 5e-4::DOUBLE"), ("bullish", "ps < -5e-4::DOUBLE")))),
    (q.ACC.split(f"{q.ATR}, ", 1)[1], q._events_sql("y", "moved < 2 * atr AND span < mid AND m20 < m60", 5, "-bar_no", "accumulation", "'bullish'", "coalesce(greatest(0, least(1, 1 - m20 / m60)), 0.5)")),
))
SCORES = f"""WITH RECURSIVE {q.SHAPE.replace(q.BARS, q.bars_sql(UNIVERSE))}, {q.AREA}, {NODES}, {LEVELS}, {q.QUIET}, ev AS ({EVENTS}),
fin AS (SELECT symbol, bar_no, close AS x, atr, avg(high - low) {q.frame(14)} AS span, coalesce(quiet_score, 0) AS quiet_score FROM quiet QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_no DESC) = 1),
ends AS (SELECT symbol, bar_no, x, CASE WHEN atr > 0 THEN atr WHEN span > 0 THEN span ELSE greatest(size, 1e-9) END AS atr, quiet_score, poc, val, vah FROM fin JOIN lev USING (symbol)), {NEAR},
hv AS (SELECT symbol, list(price) AS heavy FROM nodes WHERE kind = 'HVN' GROUP BY symbol),
pw AS (SELECT ev.symbol, CASE kind WHEN 'accumulation' THEN greatest(0.4, least(1, strength)) WHEN 'dry_up' THEN greatest(0.3, least(1, strength)) WHEN 'divergence' THEN 0.6 ELSE greatest(0.3, least(1, (strength - 1) / 3)) END * (1 - (bar_no - anchor) / 10.0::DOUBLE) AS w,
  CASE WHEN kind = 'accumulation' THEN 1 WHEN kind = 'dry_up' THEN 0 WHEN direction = 'bullish' THEN 1 ELSE -1 END AS sg FROM ev JOIN fin USING (symbol) WHERE anchor >= bar_no - 10),
pt AS (SELECT symbol, max(w) AS p_strength, round(sum(w * sg) / nullif(sum(w), 0), 9) AS ratio FROM pw GROUP BY symbol),
c0 AS (SELECT ends.*, heavy, (ends.x - val) / greatest(vah - val, 1e-9) AS loc, coalesce(abs(ends.x - hvn), 'inf'::DOUBLE) AS dh, coalesce(abs(ends.x - lvn), 'inf'::DOUBLE) AS dl, hvn, 0.5 * atr AS tol, coalesce(p_strength, 0) AS p_strength, CASE WHEN ratio > 0.15 THEN 1 WHEN ratio < -0.15 THEN -1 ELSE 0 END AS p_dir
  FROM ends JOIN nn ON nn.symbol = ends.symbol LEFT JOIN hv ON hv.symbol = ends.symbol LEFT JOIN pt ON pt.symbol = ends.symbol),
c1 AS (SELECT *, CASE WHEN loc < 0 THEN least(0.98::DOUBLE, 0.9 - 0.25 * loc) WHEN loc > 1 THEN least(0.98::DOUBLE, 0.9 + 0.25 * (loc - 1)) ELSE 0.2 + 0.7 * abs(2 * loc - 1) END AS va_strength, CASE WHEN loc <= 0.45 THEN 1 WHEN loc >= 0.55 THEN -1 ELSE 0 END AS va_dir,
  CASE WHEN least(dh, dl) > tol THEN 0.1 WHEN dh <= dl THEN 0.3 + 0.6 * (1 - dh / tol) ELSE 0.3 + 0.5 * (1 - dl / tol) END AS key_strength, CASE WHEN least(dh, dl) > tol OR dh > dl THEN 0 WHEN x >= hvn THEN 1 ELSE -1 END AS key_dir, greatest(0, least(1, quiet_score / 100)) AS quiet_strength FROM c0),
c2 AS (SELECT *, 100 * (va_strength + key_strength + 1.5 * quiet_strength + 1.5 * p_strength) / 5 AS quality, 100 * (va_strength * va_dir + key_strength * key_dir + 1.5 * p_strength * p_dir) / 5 AS lean FROM c1),
sc AS (SELECT *, round_even(quality, 2) AS setup_quality, round_even(lean, 2) AS bias_score, CASE WHEN lean > 10 THEN 'bullish' WHEN lean < -10 THEN 'bearish' ELSE 'neutral' END AS bias FROM c2)"""
STRENGTHS = ("va_strength", "key_strength", "quiet_strength", "p_strength")
register("c01_confluence", lambda s, d: rounded(_scores(s, d), "price", *STRENGTHS, places=4).select("symbol", "price", *STRENGTHS, "va_dir", "key_dir", "p_dir", "setup_quality", "bias_score", "bias"),
         f"{SCORES} SELECT symbol, round(x, 4) AS price, {', '.join(f'round({k}, 4) AS {k}' for k in STRENGTHS)}, va_dir, key_dir, p_dir, setup_quality, bias_score, bias FROM sc")


def _plan_sql(style: str) -> str:
    if style == "reversion":
        at = "x AS entry, coalesce(behind - way * 0.25 * atr, x - way * 1.5 * atr) AS stop0"
        aims = "[poc, CASE WHEN way > 0 THEN vah ELSE val END]"
    else:
        at = "coalesce(ahead, x) + way * 0.1 * atr AS entry, coalesce(ahead, x) + way * 0.1 * atr - way * 1.5 * atr AS stop0"
        aims = "list_transform(list_sort(list_transform(list_filter(sig, lambda y: way * (y - entry) > eps), lambda y: way * y))[1:1], lambda y: way * y)"
    return f"""{SCORES}, g0 AS (SELECT *, CASE bias WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END AS way, 0.05 * atr AS eps, list_distinct(list_concat([poc, vah, val], coalesce(heavy, []))) AS sig FROM sc),
g1 AS (SELECT *, list_min(list_transform(list_filter(sig, lambda y: way * (y - x) > eps), lambda y: way * y)) * way AS ahead, list_max(list_transform(list_filter(sig, lambda y: way * (y - x) < -eps), lambda y: way * y)) * way AS behind FROM g0),
g2 AS (SELECT *, {at} FROM g1), g3 AS (SELECT *, CASE WHEN way * (entry - stop0) <= 0 THEN entry - way * 1.5 * atr ELSE stop0 END AS stop FROM g2),
g4 AS (SELECT *, abs(entry - stop) AS risk, {aims} AS aims0 FROM g3), g5 AS (SELECT *, list_transform(list_sort(list_distinct(list_transform(list_filter(aims0, lambda y: way * (y - entry) > eps), lambda y: way * y)))[1:2], lambda y: way * y) AS aims1 FROM g4),
g6 AS (SELECT *, CASE WHEN len(aims1) > 0 THEN aims1 ELSE [entry + way * risk * 2.0] END AS aims FROM g5), g7 AS (SELECT *, CASE WHEN risk > 0 THEN abs(aims[1] - entry) / risk END AS rr, CASE WHEN risk > 0 THEN floor(100.0::DOUBLE / risk) END AS size FROM g6),
g8 AS (SELECT *, CASE WHEN way = 0 THEN 'no directional bias' WHEN setup_quality < 35 THEN 'setup quality' WHEN abs(bias_score) < 15 THEN 'directional conviction' WHEN risk <= 0 THEN 'degenerate stop' WHEN rr < 0.5 THEN 'risk:reward' WHEN size < 1 THEN 'risk budget' END AS reason FROM g7)
SELECT symbol, CASE WHEN reason IS NOT NULL THEN 'no_trade' WHEN way > 0 THEN 'long' ELSE 'short' END AS action, reason, {', '.join(f'CASE WHEN reason IS NULL THEN {x} END AS {k}' for k, x in (('entry', 'round(entry, 6)'), ('stop', 'round(stop, 6)'), ('target', 'round(aims[1], 6)'), ('final_target', 'round(aims[-1], 6)'), ('risk', 'round(risk, 6)'), ('risk_reward', 'round(rr, 3)'), ('size', 'size')))} FROM g8"""


for _style in ("reversion", "breakout"):
    register(f"g01_plan_{_style}", lambda s, d, k=_style: scoring.trade_plan(_scores(s, d), k, min_quality=35.0, min_rr=0.5), _plan_sql(_style))
