"""Composed drift reports and ablations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.functions.columns import elements, mean_present
from quorate.functions.rows import literal_rows
from quorate.operators import detectors as dt
from quorate.operators import drift as dr
from quorate.operators import ordering
from quorate.operators import scores as sc
from quorate.operators.scores import ModelDims
from quorate.session import reliable_table


def period_disagreement(scores: DataFrame, dims: ModelDims) -> DataFrame:
    """Disagreement per period, aggregated once from all samples and written to the shared folder."""
    return reliable_table(sc.disagreement(scores, dims.size, ["period"]))


def frozen_calibration(d_train: DataFrame, dims: ModelDims, by: list[str] = [], alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(cell baseline, null distribution) from the disagreement of the calibration periods.

    Both are small and read by every later step, so they are written once to the shared folder.
    """
    base = reliable_table(dr.drift_baseline(d_train, by))
    spec = reliable_table(dr.spectrum(dr.standardise(d_train, base, by), dims.size, [*by, "period"]))
    return base, reliable_table(dr.calibrate_drift(spec, dims, alpha, by))


def detect_periods(d: DataFrame, base: DataFrame, calib: DataFrame, dims: ModelDims, by: list[str] = []) -> DataFrame:
    spec = reliable_table(dr.spectrum(dr.standardise(d, base, by), dims.size, [*by, "period"]))
    return dr.classify_drift(dr.novelty(dr.detect_drift(spec, calib, dims, by), dims, by), dims)


def period_report(scores: DataFrame, dims: ModelDims, train: list[int], evaluation: list[int]) -> DataFrame:
    """Monthly evaluation with one frozen calibration: every evaluation period is independent of the others."""
    k = dims.size
    # the only pass over all model pairs; a few numbers per period afterwards
    d = period_disagreement(scores, dims)
    base, calib = frozen_calibration(d.where(F.col("period").isin(train)), dims)
    det = detect_periods(d.where(F.col("period").isin(evaluation)), base, calib, dims)
    cal, test = scores.where(F.col("period").isin(train)), scores.where(F.col("period").isin(evaluation))
    # one small row per period feeds several joins below
    det = reliable_table(dr.reweight(det, F.col("drift_detected"), F.col("view_loadings"), dims))
    s = elements("scores", k)
    # one small row of weights per period
    w = test.join(det.select("period", "weights", "healthy_models"), "period")
    num = sum((F.coalesce(c, F.lit(0.0)) * F.get("weights", F.lit(i)) for i, c in enumerate(s)), F.lit(0.0))
    den = sum((F.when(c.isNotNull(), F.get("weights", F.lit(i))).otherwise(0.0) for i, c in enumerate(s)), F.lit(0.0))
    e = w.select("period", "y", mean_present(s).alias("e"), (num / den).alias("e2"))
    m1 = sc.confusion(e, ["period"], "e", "y").select("period", "n", "f1").join(ordering.auc(e, ["period"], "e", "y"), "period")
    m2 = sc.confusion(e, ["period"], "e2", "y").select("period", F.col("f1").alias("f1_reweighted")).join(ordering.auc(e, ["period"], "e2", "y", "auc_reweighted"), "period")
    adaptive = dr.conformal(cal, test, det.select("period", "healthy_models"), k).select("period", F.col("coverage").alias("coverage_adaptive"), F.col("mean_set_size").alias("set_size"))
    plain = dr.conformal(cal, test, literal_rows(scores.sparkSession, [(p,) for p in evaluation], "period int").withColumn("healthy_models", F.array().cast("array<int>")), k) \
        .select("period", F.col("coverage").alias("coverage_plain"))
    cand = dr.score_samples(dr.view_dispersion(test, dims), dr.calibrate_samples(dr.view_dispersion(cal, dims), dims).crossJoin(calib.select("class_tau", "sample_z")), dims)
    cand = cand.groupBy("period").agg(F.sum(F.col("is_candidate").cast("bigint")).alias("n_candidates"))
    out = det.select("period", "drift_detected", "r", "drift_type", "spectral_gap", "strategy", "label_budget", "confidence", "novelty", "affected_views", "healthy_models")
    # every part is one row per period; finishing them one by one keeps each plan small
    pseudo = dr.pseudo_by_period(test, det, k).select("period", F.col("kept").alias("pseudo_kept"), F.col("rate").alias("pseudo_rate"), F.col("accuracy").alias("pseudo_accuracy"))
    for part in (m1, m2, adaptive, plain, cand, pseudo, dt.run_all(cal, test, k)):
        out = out.join(reliable_table(part), "period", "left")
    return out.withColumn("coverage_gain", F.col("coverage_adaptive") - F.col("coverage_plain"))


def adaptive_report(scores: DataFrame, dims: ModelDims, train: list[int], evaluation: list[int], window: int) -> DataFrame:
    """Periods in order, the baseline rolling forward after clean periods only.

    The N-row disagreement is aggregated once and written to the shared folder; each step then works on K(K-1)/2 rows a period.
    """
    d = period_disagreement(scores, dims)
    history, out = list(train), None
    for p in evaluation:
        base, calib = frozen_calibration(d.where(F.col("period").isin(history[-window:])), dims)
        # drift vectors seen so far feed the novelty of this step
        row = dr.detect_drift(dr.spectrum(dr.standardise(d.where(F.col("period") == p), base), dims.size, ["period"]), calib, dims)
        row = reliable_table(row)
        out = row if out is None else out.unionByName(row)
        if not row.where("drift_detected").limit(1).count():
            history.append(p)
    return dr.classify_drift(dr.novelty(out, dims), dims)


def ablation_period(det: DataFrame, rows: DataFrame, min_rows: int = 50) -> DataFrame:
    """The period that ablations use: the drifted one of at least ``min_rows`` rows with the widest spectral gap, else the last one.

    ``det`` has one row (period, drift_detected, spectral_gap) per evaluation period, ``rows`` its (period, n).  Of equal gaps the
    earlier period counts.  Returns one row (period, spectral_gap, drifted).
    """
    j = det.select("period", "drift_detected", "spectral_gap").join(rows.select("period", "n"), "period", "left")
    fit = F.coalesce(F.col("drift_detected") & (F.col("n") >= min_rows) & F.col("spectral_gap").isNotNull(), F.lit(False))
    best = F.max(F.when(fit, F.struct("spectral_gap", (-F.col("period")).alias("early"))))
    a = j.agg(best.alias("b"), F.max(F.struct("period", "spectral_gap")).alias("last"))
    return a.select(F.coalesce(-F.col("b.early"), F.col("last.period")).alias("period"), F.when(F.col("b").isNotNull(), F.col("b.spectral_gap")).otherwise(F.col("last.spectral_gap")).alias("spectral_gap"), F.col("b").isNotNull().alias("drifted"))


def ablate_weights(scores: DataFrame, dims: ModelDims, train: list[int], evaluation: list[int], grid: list[tuple[float, float]]) -> DataFrame:
    """Detection under different (score, decision) weights.  The two gap averages are computed once; the grid only recombines them."""
    d = period_disagreement(scores, dims)
    arms = F.array(*[F.struct(F.lit(f"{ws}:{wr}").alias("config"), (F.col("score_gap") * ws + F.col("pred_gap") * wr).alias("d")) for ws, wr in grid])
    long = d.select("period", "mi", "mj", F.inline(arms))
    return _by_config(long, dims, train, evaluation)


def _by_config(long: DataFrame, dims: ModelDims, train, evaluation) -> DataFrame:
    base, calib = frozen_calibration(long.where(F.col("period").isin(train)), dims, ["config"])
    det = detect_periods(long.where(F.col("period").isin(evaluation)), base, calib, dims, ["config"])
    return det.select("config", "period", "drift_detected", "r", "spectral_gap", "confidence", "drift_type")


def ablate_views(scores: DataFrame, dims: ModelDims, train: list[int], evaluation: list[int], configs: dict[str, list[str]]) -> DataFrame:
    """Detection with fewer views; pairs are aggregated once and filtered per configuration."""
    d = period_disagreement(scores, dims)
    out = None
    for name, views in configs.items():
        keep = [i for i, v in enumerate(dims.views_of) if v in views]
        if len(keep) < 2:
            continue
        pos = {old: new for new, old in enumerate(keep)}
        remap = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in pos.items() for x in kv]), F.col(c))
        sub = ModelDims([(dims.views_of[i], dims.levels_of[i]) for i in keep])
        part = d.where(F.col("mi").isin(keep) & F.col("mj").isin(keep)).withColumns({"mi": remap("mi"), "mj": remap("mj")})
        base, calib = frozen_calibration(part.where(F.col("period").isin(train)), sub)
        spec = dr.spectrum(dr.standardise(part.where(F.col("period").isin(evaluation)), base), sub.size, ["period"])
        det = dr.detect_drift(spec, calib, sub).select(F.lit(name).alias("config"), F.lit(sub.size).alias("models"), "period", "drift_detected", "r", "spectral_gap", "confidence")
        out = det if out is None else out.unionByName(det)
    return out


def ablate_batch(scores: DataFrame, dims: ModelDims, train: list[int], evaluation: list[int], sizes: list[int], repeats: int, key: str = "sample_id") -> DataFrame:
    """Detection and false-alarm rates on seeded sub-samples of ``sizes`` rows, against the full calibration.

    Every (size, repeat) arm draws rows by hash with the matching probability, so all arms come from one pass over the scores.
    """
    d = period_disagreement(scores, dims)
    base, calib = frozen_calibration(d.where(F.col("period").isin(train)), dims)
    side = F.when(F.col("period").isin(evaluation), "test").otherwise("clean")
    n = scores.withColumn("side", side).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    # a row is repeated only for the arms that drew it; the two counts go to the rows, whose side would bring half of them to one task
    rows = scores.withColumn("side", side).join(F.broadcast(n), "side")
    u = lambda a: F.pmod(F.xxhash64(F.col(key), a["size"], a["rep"]), F.lit(1 << 30)).cast("double") / float(1 << 30)
    arms = F.filter(F.array(*[F.struct(F.lit(s).alias("size"), F.lit(r).alias("rep")) for s in sizes for r in range(repeats)]), lambda a: u(a) < a["size"] / F.col("n"))
    picked = rows.select("side", F.explode(arms).alias("arm"), "scores").select("side", "arm.size", "arm.rep", "scores")
    arm_d = sc.disagreement(picked, dims.size, ["side", "size", "rep"])
    spec = dr.spectrum(dr.standardise(arm_d, base), dims.size, ["side", "size", "rep"])
    det = dr.detect_drift(spec, calib, dims)
    rate = lambda s: F.avg(F.when(F.col("side") == s, F.col("drift_detected").cast("double")))
    return det.groupBy("size").agg(rate("test").alias("detection_rate"), rate("clean").alias("false_alarm_rate"), F.avg("r").alias("mean_r"))
