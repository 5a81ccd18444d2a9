import pytest
from pyspark.sql import functions as F

from barquarry.operators import nodes, scoring


def hist(spark, volumes, symbol="a"):
    return spark.createDataFrame([(symbol, i, float(i), float(v)) for i, v in enumerate(volumes)], "symbol string, bin int, price double, volume double")


def test_peaks_valley_and_heaviest_bin(spark):
    h = hist(spark, [0, 1, 8, 20, 8, 1, 0, 0, 1, 6, 14, 6, 1, 0])
    got = {(r["kind"], r["rank"]): r["bin"] for r in nodes.nodes(h).collect()}
    assert got[("HVN", 1)] == 3 and got[("HVN", 2)] == 10
    assert 5 <= got[("LVN", 1)] <= 8


def test_flat_top_counts_once_and_ends_do_not(spark):
    rows = nodes.arrays(hist(spark, [5, 0, 3, 3, 3, 0, 9]))
    found = nodes.peaks(rows, "v", 0.0).collect()
    assert [r["bin"] for r in found] == [3]


def test_few_bins_have_only_the_point_of_control(spark):
    assert [(r["kind"], r["bin"]) for r in nodes.nodes(hist(spark, [1, 4])).collect()] == [("HVN", 1)]
    assert nodes.nodes(hist(spark, [])).count() == 0


def test_nearest_node_ties_go_to_heavy_ones(spark):
    found = spark.createDataFrame([("a", "HVN", 1, 1, 10.0), ("a", "LVN", 1, 3, 14.0)], "symbol string, kind string, rank int, bin int, price double")
    one = nodes.nearest_node(found, spark.createDataFrame([("a", 12.0)], "symbol string, x double")).first()
    assert one["kind"] == "HVN" and one["lvn"] == 14.0


def test_two_peaks_are_a_double_distribution(spark):
    h = hist(spark, [0, 2, 30, 2, 0, 0, 0, 0, 2, 28, 2, 0])
    place = spark.createDataFrame([("a", 0.5)], "symbol string, poc_location double")
    row = nodes.shape(h, place).first()
    assert row["n_peaks"] == 2 and row["is_double"] and row["shape"] == nodes.DOUBLE


def test_value_area_part(spark):
    b = spark.createDataFrame([(p,) for p in (90.0, 100.0, 105.0, 110.0, 200.0)], "p double")
    s, d = scoring.value_area_part(F.col("p"), F.lit(100.0), F.lit(110.0))
    got = [(round(r[0], 6), r[1]) for r in b.select(s, d).collect()]
    assert got == [(0.98, 1), (0.9, 1), (0.2, 0), (0.9, -1), (0.98, -1)]


COLUMNS = "symbol string, price double, poc double, vah double, val double, heavy array<double>, atr double, bias string, setup_quality double, bias_score double, quiet_score double"


@pytest.mark.parametrize("style, entry, stop, target", [("reversion", 100.0, 94.5, 106.0), ("breakout", 106.2, 103.2, 112.0)])
def test_plan_levels(spark, style, entry, stop, target):
    row = ("a", 100.0, 106.0, 112.0, 95.0, [95.0], 2.0, "bullish", 80.0, 40.0, 0.0)
    got = scoring.trade_plan(spark.createDataFrame([row], COLUMNS), style, min_rr=1.0).first()
    assert (got["action"], got["entry"], got["stop"], got["target"]) == ("long", pytest.approx(entry), pytest.approx(stop), pytest.approx(target))


def test_plan_reasons_and_measured_move(spark):
    rows = [("a", 100.0, 100.0, 100.0, 100.0, None, 2.0, "bullish", 80.0, 40.0, 0.0), ("b", 100.0, 100.0, 100.0, 100.0, None, 2.0, "neutral", 80.0, 4.0, 0.0), ("c", 100.0, 100.0, 100.0, 100.0, None, 2.0, "bearish", 20.0, -40.0, 0.0)]
    got = {r["symbol"]: r for r in scoring.trade_plan(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got["a"]["action"] == "long" and got["a"]["risk_reward"] == 2.0 and got["a"]["target"] == 106.0
    assert got["b"]["reason"] == "no directional bias" and got["c"]["reason"] == "setup quality"
