"""Drift operators against a plain numpy restatement."""

from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorate.operators import detectors as de
from quorate.operators import drift as dr
from quorate.operators import reports as rs
from quorate.operators import scores as sc
from quorate.operators.scores import ModelDims

DIMS = ModelDims([("Va", "surface"), ("Va", "surface"), ("Vb", "structure"), ("Vc", "structure"), ("Vd", "global")])
K, VIEWS, LEVELS = 5, ["Va", "Vb", "Vc", "Vd"], ["surface", "structure", "global"]
MEMBER = np.array([[.5, .5, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 1, 0], [0, 0, 0, 0, 1.0]])
UP = np.array([[1, 0, 0, 0], [0, .5, .5, 0], [0, 0, 0, 1.0]])


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = []
    for p in range(1, 9):
        base = rng.random((300, 1))
        s = np.clip(base + rng.normal(0, 0.08 + 0.004 * p, (300, K)), 0, 1)
        if p == 7:
            s[:, 2:4] = rng.random((300, 2))
        if p == 8:
            s[:, 0] = rng.random(300)
        y = (base[:, 0] > 0.5).astype(int)
        rows += [(p * 1000 + i, p, int(y[i]), [float(x) for x in s[i]]) for i in range(300)]
    df = spark.createDataFrame(rows, "sample_id bigint, period int, y int, scores array<double>").cache()
    return {p: np.array([r[3] for r in rows if r[1] == p]) for p in range(1, 9)}, df


def matrix(s):
    p = s > 0.5
    d = 0.6 * np.abs(s[:, :, None] - s[:, None, :]).mean(0) + 0.4 * (p[:, :, None] != p[:, None, :]).mean(0)
    np.fill_diagonal(d, 0)
    return d


def loads(a, tau):
    w, v = np.linalg.eigh(a)
    w, v = w[::-1], v[:, ::-1]
    n = max((w > tau).sum(), 1)
    view = MEMBER @ ((v[:, :n] ** 2) * np.maximum(w[:n], 0)).sum(1)
    return w, v, view, UP @ view


def restated(data):
    mats = {p: matrix(s) for p, s in data.items()}
    cal = np.stack([mats[p] for p in range(1, 7)])
    mu, sd = cal.mean(0), cal.std(0, ddof=1)
    sd = np.where(sd > 1e-10, sd, np.median(sd[sd > 1e-10]))
    a = {p: np.where(np.eye(K) > 0, 0, (m - mu) / sd) for p, m in mats.items()}
    tau = np.percentile([np.linalg.eigvalsh(a[p])[-1] for p in range(1, 7)], 95)
    null = [loads(a[p], tau) for p in range(1, 7)]
    lv = np.array([x[3] for x in null])
    return a, tau, null, lv


def test_calibration(spark, data):
    arrays, df = data
    a, tau, null, lv = restated(arrays)
    c = rs.frozen_calibration(sc.disagreement(df.where("period <= 6"), K, ["period"]), DIMS)[1].first()
    assert c["tau"] == pytest.approx(tau)
    assert np.allclose(c["level_mu"], lv.mean(0)) and np.allclose(c["level_sd"], lv.std(0, ddof=1))
    z = NormalDist().inv_cdf(1 - 0.05 / 3)
    assert np.allclose(c["level_tau"], lv.mean(0) + z * lv.std(0, ddof=1))
    vv = np.array([x[2] for x in null])
    assert np.allclose(c["view_mu"], vv.mean(0)) and np.allclose(c["view_sd"], vv.std(0))
    share = lv / (lv.sum(1, keepdims=True) + 1e-10)
    assert np.allclose(c["class_tau"], np.minimum(share.max(0) + 0.05, 1 / 3 + 0.15))
    az = np.abs((lv - lv.mean(0)) / lv.std(0, ddof=1))
    assert c["cusum_k"] == pytest.approx(np.percentile(az, 80) + 0.3)
    assert c["sample_z"] == pytest.approx(max(np.percentile(az, 97.5), 1.5))
    sines = [np.sqrt(max(1 - (x @ y / np.linalg.norm(x) / np.linalg.norm(y)) ** 2, 0)) for i, x in enumerate(vv) for y in vv[i + 1:]]
    assert c["eta"] == pytest.approx(max(np.percentile(sines, 95), 0.2))


def test_detection(spark, data):
    arrays, df = data
    a, tau, null, lv = restated(arrays)
    d = sc.disagreement(df, K, ["period"])
    base, calib = rs.frozen_calibration(d.where("period <= 6"), DIMS)
    got = {r["period"]: r for r in rs.detect_periods(d.where("period >= 7"), base, calib, DIMS).collect()}
    vv = np.array([x[2] for x in null])
    for p in (7, 8):
        w, v, view, level = loads(a[p], tau)
        r = int((w > tau).sum())
        g = got[p]
        assert g["drift_detected"] and g["r"] == r
        assert np.allclose(g["eigenvalues"], w) and np.allclose(g["view_loadings"], view) and np.allclose(g["level_loadings"], level)
        assert g["spectral_gap"] == pytest.approx(w[0] / w[1] if r >= 2 else w[0] / tau)
        assert g["affected_views"] == [n for n, x, m, s in zip(VIEWS, view, vv.mean(0), vv.std(0)) if x > m + 3 * s]
    assert "Vb" in got[7]["affected_views"] and "Va" in got[8]["affected_views"]
    assert got[7]["drift_type"] == "structural"


def test_novelty_waits_for_history(spark):
    rows = [(p, True, [1.0, 0.0, 0.0, 0.0] if p < 6 else [0.0, 1.0, 0.0, 0.0]) for p in range(1, 7)]
    df = spark.createDataFrame(rows, "period int, drift_detected boolean, view_loadings array<double>")
    got = {r["period"]: r["novelty"] for r in dr.novelty(df, DIMS).collect()}
    assert got[4] == 0.0 and got[5] == pytest.approx(0.0, abs=1e-9) and got[6] == pytest.approx(1.0)


def test_cusum_closed_form(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 60)
    rows = [("x", i // 25, i, float(v)) for i, v in enumerate(z)]
    got = dr.cusum(spark.createDataFrame(rows, "level string, epoch int, period int, z double"), 0.4, ["level"]).orderBy("period").toPandas()["cusum"]
    s, want = 0.0, []
    for i, v in enumerate(z):
        s = 0.0 if i % 25 == 0 else s
        s = max(0.0, s + max(v, 0) - 0.4)
        want.append(s)
    assert np.allclose(got, want)


def test_reweight_uniform_and_differential(spark):
    df = spark.createDataFrame([(1, True, [1.0, 1.0, 1.0, 1.0]), (2, True, [1.0, 0.0, 0.0, 0.0]), (3, False, [1.0, 0.0, 0.0, 0.0])], "i int, det boolean, v array<double>")
    w = {r["i"]: r["weights"] for r in dr.reweight(df, F.col("det"), F.col("v"), DIMS).collect()}
    assert np.allclose(w[1], 0.2) and np.allclose(w[3], 0.2)
    # both models of the first view carry the whole impact; the spread over used impacts is zero, so weights stay equal
    assert np.allclose(w[2], 0.2)
    df = spark.createDataFrame([(1, True, [1.0, 0.1, 0.0, 0.0])], "i int, det boolean, v array<double>")
    raw = np.array([0.6, 0.6, 1 - 0.4 * np.sqrt(0.1), 1, 1])
    assert np.allclose(dr.reweight(df, F.col("det"), F.col("v"), DIMS).first()["weights"], raw / raw.sum())


def test_conformal_small(spark):
    rng = np.random.default_rng(5)
    cs, y = rng.random((10, K)), rng.integers(0, 2, 10)
    ts = rng.random((5, K))
    cal = spark.createDataFrame([(int(a), [float(x) for x in s]) for a, s in zip(y, cs)], "y int, scores array<double>")
    test = spark.createDataFrame([(1, 1, [float(x) for x in s]) for s in ts], "period int, y int, scores array<double>")
    healthy = spark.createDataFrame([(1, [0, 1, 2])], "period int, healthy_models array<int>")
    got = dr.conformal(cal, test, healthy, K).first()
    ce, te = cs[:, :3].mean(1), ts[:, :3].mean(1)
    lw = -0.5 * ((ce - te.mean()) / te.std()) ** 2 + 0.5 * ((ce - ce.mean()) / ce.std()) ** 2
    w = np.clip(np.exp(lw - lw.max()), 0.01, 100)
    nc = np.abs(ce - y)
    o = np.argsort(nc)
    q = nc[o][min(np.searchsorted(np.cumsum(w[o] / w.sum()), min(0.9 * 1.1, 1)), 9)]
    sets = [{v for v in (0, 1) if abs(s - v) <= q} or {int(round(s))} for s in te]
    assert got["quantile"] == pytest.approx(q) and got["mean_set_size"] == pytest.approx(np.mean([len(s) for s in sets]))
    assert got["coverage"] == pytest.approx(np.mean([1 in s for s in sets]))
    assert got["bound"] == pytest.approx(max(0, 0.9 - w.max() / w.min() / 11))


def test_reconstruction_matches_projection(spark, data):
    arrays, df = data
    cal, test = df.where("period <= 6"), df.where("period = 7")
    got = de.reconstruction(cal, test, K).first()
    x = np.concatenate([arrays[p] for p in range(1, 7)])
    mu = x.mean(0)
    _, _, vt = np.linalg.svd(x - mu, full_matrices=False)
    v = vt[:2]
    err = lambda m: np.sqrt((((m - mu) - (m - mu) @ v.T @ v) ** 2).sum(1))
    base = err(x)
    assert got["outlier_ratio"] == pytest.approx((err(arrays[7]) > np.percentile(base, 95)).mean())
    assert got["shift"] == pytest.approx((err(arrays[7]).mean() - base.mean()) / base.std())


def test_mask_variance_is_the_spread_over_masks(spark, data):
    arrays, df = data
    got = df.where("period = 1").select("sample_id", de.mask_variance_of(df, K, 42).alias("v")).orderBy("sample_id").toPandas()["v"]
    w = np.array(de.mask_weights(K, 42))
    assert np.allclose(got, (arrays[1] @ w.T).var(1))


def test_missing_model_is_not_half(spark):
    df = spark.createDataFrame([(1, 1, [0.9, None, 0.7]), (2, 0, [None, None, None])], "sample_id int, y int, scores array<double>")
    got = {r["sample_id"]: r["e"] for r in sc.ensemble(df, 3, name="e").collect()}
    assert got[1] == pytest.approx(0.8) and got[2] is None


def test_weighted_ensemble_falls_back_to_equal(spark):
    df = spark.createDataFrame([([0.2, 0.6, None],)], "scores array<double>")
    assert sc.ensemble(df, 3, [0.0, 0.0, 1.0], "e").first()["e"] == pytest.approx(0.4)


def test_disagreement_equals_pair_rows(spark, data):
    _, df = data
    got = sc.disagreement(df, K, ["period"]).orderBy("period", "mi", "mj").toPandas()
    want = sc.model_pairs(df, K, ["period"]).groupBy("period", "mi", "mj").agg(F.avg("gap").alias("g"), F.avg("differ").alias("p")).orderBy("period", "mi", "mj").toPandas()
    assert np.allclose(got["score_gap"], want["g"]) and np.allclose(got["pred_gap"], want["p"])


def test_adaptive_report_rolls_forward(spark, data):
    _, df = data
    got = {r["period"]: r for r in rs.adaptive_report(df, DIMS, [1, 2, 3, 4, 5], [6, 7], 7).collect()}
    assert set(got) == {6, 7} and got[7]["drift_detected"]


def test_period_report(spark, data):
    _, df = data
    got = {r["period"]: r for r in rs.period_report(df, DIMS, [1, 2, 3, 4, 5, 6], [7, 8]).collect()}
    assert got[7]["drift_detected"] and got[7]["n"] == 300
    assert 0 <= got[7]["coverage_adaptive"] <= 1 and got[7]["det_disagreement"]
    assert got[7]["coverage_gain"] == pytest.approx(got[7]["coverage_adaptive"] - got[7]["coverage_plain"])


def test_ablations(spark, data):
    _, df = data
    w = rs.ablate_weights(df, DIMS, [1, 2, 3, 4, 5, 6], [7], [(1.0, 0.0), (0.6, 0.4)]).toPandas()
    assert len(w) == 2 and w["drift_detected"].all()
    v = rs.ablate_views(df, DIMS, [1, 2, 3, 4, 5, 6], [7], {"all": VIEWS, "less": VIEWS[:3], "one": ["Vd"]}).toPandas()
    assert set(v["config"]) == {"all", "less"}
    b = rs.ablate_batch(df, DIMS, [1, 2, 3, 4, 5, 6], [7], [100, 200], 3).toPandas()
    assert (b["detection_rate"] == 1.0).all() and b["false_alarm_rate"].between(0, 1).all()
    assert dr.separability(DIMS) == 0.0
    assert pd.notna(b["mean_r"]).all()


def test_batch_ablation_never_brings_a_side_to_one_task(spark, data):
    import re
    _, df = data
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = rs.ablate_batch(df, DIMS, [1, 2, 3, 4, 5, 6], [7], [100, 200], 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # only the two counts are dealt by side
    assert len(re.findall(r"hashpartitioning\(side#\d+, \d+\)", plan)) == 1


def test_exploded_weights_are_computed_once(spark):
    df = dr.reweight(spark.range(10), F.col("id") % 2 == 0, F.array(*[(F.col("id") % (i + 2)).cast("double") for i in range(len(DIMS.views))]), DIMS)
    rows = df.select("id", F.posexplode("weights"))
    assert rows.count() == 10 * DIMS.size
    # no derived filter repeats the steps
    filters = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in line]
    assert not any("transform(" in line for line in filters)


def test_detector_measures_are_computed_once_per_row(spark, monkeypatch):
    written, keep = [], de.reliable_table
    monkeypatch.setattr(de, "reliable_table", lambda df: written.append(df.columns) or keep(df))
    rows = [(i, i % 6 + 1, i % 2, [(i * p % 97) / 97 for p in (3, 5, 7, 11)]) for i in range(300)]
    df = spark.createDataFrame(rows, "sample_id long, period int, y int, scores array<double>")
    cal, test = df.where("period <= 4"), df.where("period >= 5")
    for fn, name in ((de.reconstruction, "error"), (de.mask_variance, "v"), (de.centroid, "z")):
        written.clear()
        assert fn(cal, test, 4).count() == 2
        assert [name] in written
