import numpy as np
import pytest

from barquarry.operators import models, validation


def test_ridge_equals_plain_solution(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    y = x @ [0.5, -1.0] + rng.normal(size=60)
    rows = spark.createDataFrame([("a", float(a), float(b), 7.0, float(c)) for (a, b), c in zip(x, y)] + [("a", None, 1.0, 7.0, 1.0)], "symbol string, p double, q double, flat double, y double")
    got = models.ridge_weights(rows, ["symbol"], ["p", "q", "flat"], "y").first()
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.zeros(60)])
    assert got["n"] == 60
    assert got["weights"] == pytest.approx(np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean())).tolist())


def test_factor_eval_skips_short_splits_and_flat_signals(spark):
    rows = [("a", 0, "train", float(i), 2.0 * i) for i in range(12)] + [("a", 0, "test", float(i), 3.0 * i - 4) for i in range(4)]
    rows += [("b", 0, "train", 1.0, 1.0)] * 12 + [("b", 0, "test", 1.0, float(i)) for i in range(4)]
    rows += [("c", 0, "train", 1.0, 1.0)] * 9 + [("c", 0, "test", 1.0, float(i)) for i in range(4)]
    got = {r["symbol"]: r for r in models.factor_eval(spark.createDataFrame(rows, "symbol string, split int, role string, x double, y double"), "x", "y").collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["ic"] == pytest.approx(1.0) and got["b"]["ic"] is None and got["b"]["accuracy"] is None


def test_spearman_partial_and_t(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0, 5.0), ("a", 2.0, 2.0, 1.0), ("a", 4.0, 9.0, 4.0), ("a", 8.0, 11.0, 2.0), ("a", None, 1.0, 1.0)], "g string, x double, y double, z double")
    rho = {(r["a"], r["b"]): (r["n"], r["rho"]) for r in models.spearman_matrix(rows, "g", ["x", "y", "z"]).collect()}
    assert rho[("x", "y")] == (4, pytest.approx(np.corrcoef([1, 2, 3, 4], [1.5, 1.5, 3, 4])[0, 1]))
    x, y, z = np.array([1.0, 2, 4, 8]), np.array([2.0, 2, 9, 11]), np.array([5.0, 1, 4, 2])
    by = np.column_stack([z, np.ones(4)])
    left = [v - by @ np.linalg.lstsq(by, v, rcond=None)[0] for v in (x, y)]
    assert models.partial_corr(rows, "g", "x", "y", "z").first()["partial"] == pytest.approx(np.corrcoef(*left)[0, 1])
    t = models.t_statistic(rows, "g", "x").first()
    assert t["n"] == 4 and t["t"] == pytest.approx(x.mean() / (x.std(ddof=1) / 2))


def test_ledger_keeps_what_it_has(spark):
    kind = "symbol string, decision int, status string, r_multiple double"
    old = spark.createDataFrame([("a", 1, "open", None)], kind)
    new = spark.createDataFrame([("a", 1, "win", 2.0), ("a", 2, "loss", -1.0), ("a", 2, "loss", -1.0)], kind)
    both = models.upsert(old, new)
    assert sorted((r["decision"], r["status"]) for r in both.collect()) == [(1, "open"), (2, "loss")]
    assert models.upsert(both, new).count() == 2
    assert {r["status"]: (r["n"], r["sum_r"]) for r in models.ledger_summary(both).collect()} == {"open": (1, None), "loss": (1, -1.0)}


def _fold_ics(x, y, roles):
    """Mean IC over splits by a plain ridge fit; roles: (splits, rows)."""
    out = []
    for own in roles:
        tr, te = own == "train", own == "test"
        sd = x[tr].std() or 1.0
        z = (x[tr] - x[tr].mean()) / sd
        signal = (x[te] - x[tr].mean()) / sd * (z @ (y[tr] - y[tr].mean()) / (z @ z + 1))
        if tr.sum() >= 10 and te.sum() >= 3 and signal.std() > 0 and y[te].std() > 0:
            out.append(np.corrcoef(signal, y[te])[0, 1])
    return np.mean(out) if out else None


def test_permutation_evaluates_the_purged_splits(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=120)
    y = 0.9 * x + rng.normal(size=120)
    rows = [("a", i, float(x[i]), float(y[i])) for i in range(120)] + [("b", i, float(x[i]), float(y[-1 - i])) for i in range(90)] + [("flat", i, 1.0, float(y[i])) for i in range(60)]
    members = validation.cpcv(spark.createDataFrame(rows, "symbol string, row_no int, x double, y double"), purge=4, embargo=0.01).cache()
    got = {r["symbol"]: r for r in validation.permutation_ic(members, "x", "y").collect()}
    for symbol, many in (("a", 120), ("b", 90)):
        roles = np.empty((15, many), object)
        for r in members.where(f"symbol = '{symbol}'").collect():
            roles[r["split"], r["row_no"]] = r["role"]
        u, v = (np.array([r[k] for r in rows if r[0] == symbol]) for k in (2, 3))
        real = _fold_ics(u, v, roles)
        assert got[symbol]["ic"] == pytest.approx(real) and got[symbol]["n"] == 200
        null = np.array([_fold_ics(u, rng.permutation(v), roles) for _ in range(400)])
        assert got[symbol]["null_ic"] == pytest.approx(null.mean(), abs=4 * null.std() / 200**0.5)
        assert got[symbol]["p_value"] == pytest.approx((null >= real).mean(), abs=0.12)
    assert got["a"]["p_value"] == pytest.approx(1 / 201)
    assert got["flat"]["ic"] is None and got["flat"]["p_value"] is None and got["flat"]["n"] == 0


def test_factor_buckets_pool_out_of_sample_signals(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=150), rng.normal(size=150)
    y += 0.5 * x
    rows = [("a", i, float(x[i]), float(y[i])) for i in range(150)] + [("flat", i, 1.0, float(y[i])) for i in range(60)]
    members = validation.cpcv(spark.createDataFrame(rows, "symbol string, row_no int, x double, y double"), purge=4, embargo=0.01)
    roles = np.empty((15, 150), object)
    for r in members.where("symbol = 'a'").collect():
        roles[r["split"], r["row_no"]] = r["role"]
    z, pooled, signs = [], [], []
    for own in roles:
        tr, te = own == "train", own == "test"
        u = (x[tr] - x[tr].mean()) / x[tr].std()
        s = (x[te] - x[tr].mean()) / x[tr].std() * (u @ (y[tr] - y[tr].mean()) / (u @ u + 1))
        signs += (np.sign(s) * y[te]).tolist()
        z += ((s - s.mean()) / s.std()).tolist()
        pooled += y[te].tolist()
    at = np.digitize(z, np.quantile(z, [0.2, 0.4, 0.6, 0.8]))
    means = np.array([np.array(pooled)[at == k].mean() for k in range(5)])
    got = models.factor_buckets(members, "x", "y").collect()
    assert [r["symbol"] for r in got] == ["a"]
    r = got[0]
    assert r["n"] == len(z) and r["means"] == pytest.approx(means.tolist())
    assert r["spread"] == pytest.approx(means[4] - means[0]) and r["in_market"] == pytest.approx(np.isin(at, [0, 4]).mean())
    assert r["spearman"] == pytest.approx(np.corrcoef(np.arange(5), np.argsort(np.argsort(means)))[0, 1])
    assert r["always_on"] == pytest.approx(np.mean(signs))
    assert (r["long_only_net"], r["long_short_net"]) == pytest.approx((means[4] - 0.001, means[4] - means[0] - 0.002))


def test_date_split_ridge_scores_test_dates(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 6, 2))
    y = x @ [0.3, -0.2] + rng.normal(size=(60, 6))
    rows = [(d, f"n{k}", float(x[d, k, 0]), float(x[d, k, 1]), float(y[d, k])) for d in range(60) for k in range(6)]
    panel = spark.createDataFrame(rows, "ts int, symbol string, p double, q double, forward double")
    roles = np.empty((15, 60), object)
    for r in validation.cpcv(spark.createDataFrame([(0, d) for d in range(60)], "symbol int, row_no int"), purge=4, embargo=0.01).collect():
        roles[r["split"], r["row_no"]] = r["role"]
    ics, weights = [], []
    for own in roles:
        u, v = x[own == "train"].reshape(-1, 2), y[own == "train"].ravel()
        z = (u - u.mean(0)) / u.std(0)
        w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (v - v.mean()))
        weights.append(w)
        for d in np.flatnonzero(own == "test"):
            s = ((x[d] - u.mean(0)) / u.std(0)) @ w
            ics.append(np.corrcoef(np.argsort(np.argsort(s)), np.argsort(np.argsort(y[d])))[0, 1])
    got = models.date_split_ridge(panel, ["p", "q"], "forward").collect()
    assert len(got) == 1 and (got[0]["n_dates"], got[0]["n_splits"]) == (len(ics), 15)
    assert [got[0][c] for c in ("mean_ic", "median_ic", "sd_ic", "positive")] == pytest.approx([np.mean(ics), np.median(ics), np.std(ics), np.mean(np.array(ics) > 0)])
    assert got[0]["weights"] == pytest.approx(np.mean(weights, 0).tolist())
