"""Drift analytics from pairwise model disagreement.

The N-row work (disagreement, dispersion, weights) is plain aggregation.  Only the eigen-decomposition of a K x K
matrix runs in a grouped function, and it receives K(K-1)/2 already aggregated numbers per group.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.functions.columns import add, elements, exceeds, greatest_present, mean_present, ratio, spread_present, stored
from quorate.functions.rows import vector_moments
from quorate.operators.ordering import real_digits
from quorate.operators.scores import ModelDims
from quorate.session import reliable_table

NONE, PERTURBATION, STRUCTURAL, PARADIGM = "none", "perturbation", "structural", "paradigm_shift"


def attach(df: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Join per-group scalars; without groups ``small`` is a single row."""
    return df.join(small, by) if by else df.crossJoin(F.broadcast(small))


# ---- baseline and spectrum -----------------------------------------------------------------------------------------


def drift_baseline(d: DataFrame, by: list[str] = []) -> DataFrame:
    """Mean and sample deviation of every matrix cell over calibration periods; flat cells take the median deviation."""
    cell = d.groupBy(*by, "mi", "mj").agg(F.avg("d").alias("mu0"), F.stddev_samp("d").alias("__s"))
    good = F.when(F.col("__s") > 1e-10, F.col("__s"))
    # at most K(K-1)/2 rows per group
    fill = cell.groupBy(*by).agg(F.coalesce(F.percentile(good, 0.5), F.lit(1e-4)).alias("__f"))
    return attach(cell, fill, by).select(*by, "mi", "mj", "mu0", F.coalesce(good, F.col("__f")).alias("sigma0"))


def standardise(d: DataFrame, base: DataFrame, by: list[str] = []) -> DataFrame:
    return d.join(base, [*by, "mi", "mj"]).withColumn("a", (F.col("d") - F.col("mu0")) / F.col("sigma0"))


def spectrum(a: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """Eigenvalues (descending) and squared eigenvector entries per group of standardised cells."""
    import numpy as np
    fields = {f.name: f.dataType.simpleString() for f in a.schema}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", eigenvalues array<double>, weights array<array<double>>"

    def decompose(cells: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((size, size))
        m[cells.mi, cells.mj] = m[cells.mj, cells.mi] = cells.a
        values, vectors = np.linalg.eigh(m)
        out = {k: [cells[k].iloc[0]] for k in keys}
        out["eigenvalues"] = [values[::-1].tolist()]
        out["weights"] = [(vectors[:, ::-1].T ** 2).tolist()]
        return pd.DataFrame(out)

    return a.select(*keys, "mi", "mj", "a").groupBy(*keys).applyInPandas(decompose, schema)


def _components(count: Column) -> Column:
    """The first ``count`` components as (eigenvalue, weights)."""
    return F.slice(F.arrays_zip("eigenvalues", "weights"), F.lit(1), count)


def _view_load(component: Column, models: list[int]) -> Column:
    w = component["weights"]
    return add([F.get(w, F.lit(k)) for k in models]) / float(len(models)) * F.greatest(component["eigenvalues"], F.lit(0.0))


def with_loadings(spec: DataFrame, dims: ModelDims, count: Column) -> DataFrame:
    """Add view loadings (mean contribution of a view's models) and level loadings (mean over its views)."""
    def load(models: list[int]) -> Column:
        return F.aggregate(_components(count), F.lit(0.0), lambda acc, c: acc + _view_load(c, models))

    views = [load(m) for m in dims.views.values()]
    out = spec.withColumn("view_loadings", stored(views))
    names = list(dims.views)
    levels = [add([F.get("view_loadings", F.lit(names.index(v))) for v in vs]) / float(len(vs)) for vs in dims.levels.values()]
    out = out.withColumn("level_loadings", stored(levels))
    total = F.aggregate("level_loadings", F.lit(0.0), lambda a, x: a + x) + 1e-10
    return out.withColumn("level_share", F.transform("level_loadings", lambda x: x / total))


def _each(column: str, n: int, fn) -> Column:
    return F.array(*[fn(F.get(column, F.lit(i))) for i in range(n)])


def calibrate_drift(spec: DataFrame, dims: ModelDims, alpha: float = 0.05, by: list[str] = [], spread_periods: int = 10, angle_periods: int = 5) -> DataFrame:
    """Null distribution of the calibration periods as one row per group; its inputs are one row per period.

    A spread over few periods says little: below ``spread_periods`` the limit of a level's share is the largest one seen plus
    0.05 instead of mean and two deviations, and below ``angle_periods`` the angle limit is the default 0.4.
    """
    n_levels, n_views = len(dims.levels), len(dims.views)
    tau = spec.groupBy(*by).agg(F.percentile(F.get("eigenvalues", F.lit(0)), 1 - alpha).alias("tau"))
    null = attach(spec, tau, by)
    null = with_loadings(null, dims, F.greatest(F.size(F.filter("eigenvalues", lambda x: x > F.col("tau"))), F.lit(1)))
    z_crit = NormalDist().inv_cdf(1 - alpha / max(n_levels, 1))
    t = F.count(F.lit(1))
    level_sd = lambda c: F.greatest(F.stddev_samp(c), F.lit(1e-8))
    share_limit = lambda c: F.least(F.when(t >= spread_periods, F.avg(c) + 2 * F.greatest(F.stddev_pop(c), F.lit(1e-4))).otherwise(F.max(c) + 0.05), F.lit(1.0 / n_levels + 0.15))
    stats = null.groupBy(*by).agg(
        F.first("tau").alias("tau"), t.alias("periods"), _each("level_loadings", n_levels, F.avg).alias("level_mu"), _each("level_loadings", n_levels, level_sd).alias("level_sd"),
        _each("level_loadings", n_levels, lambda c: F.avg(c) + z_crit * level_sd(c)).alias("level_tau"), _each("level_share", n_levels, share_limit).alias("class_tau"),
        _each("view_loadings", n_views, F.avg).alias("view_mu"), _each("view_loadings", n_views, lambda c: F.greatest(F.stddev_pop(c), F.lit(1e-8))).alias("view_sd"),
        F.collect_list("view_loadings").alias("__views"))
    z = attach(null.select(*by, "level_loadings"), stats.select(*by, "level_mu", "level_sd"), by)
    z = z.select(*by, F.explode(F.array(*[F.abs((F.get("level_loadings", F.lit(i)) - F.get("level_mu", F.lit(i))) / F.get("level_sd", F.lit(i))) for i in range(n_levels)])).alias("z"))
    limits = z.groupBy(*by).agg((F.percentile("z", 0.8) + 0.3).alias("cusum_k"), F.greatest(F.percentile("z", 0.975), F.lit(1.5)).alias("sample_z"))
    out = attach(stats, limits, by)
    return out.withColumn("eta", F.when(F.col("periods") >= angle_periods, F.greatest(F.coalesce(_sine_quantile(F.col("__views"), 0.95), F.lit(0.4)), F.lit(0.2))).otherwise(0.4)).drop("__views")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _sine_quantile(vectors: Column, p: float) -> Column:
    """Quantile of the pairwise sine angles between the (few) calibration loading vectors."""
    pairs = F.flatten(F.transform(vectors, lambda a, i: F.transform(F.slice(vectors, i + 2, F.size(vectors)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    usable = F.filter(pairs, lambda q: (_dot(q["a"], q["a"]) > 1e-20) & (_dot(q["b"], q["b"]) > 1e-20))
    cos2 = lambda q: F.pow(_dot(q["a"], q["b"]), 2) / (_dot(q["a"], q["a"]) * _dot(q["b"], q["b"]))
    sines = F.array_sort(F.transform(usable, lambda q: F.sqrt(F.greatest(F.lit(1.0) - cos2(q), F.lit(0.0)))))
    at = F.lit(p) * (F.size(sines) - 1)
    lo, hi = F.get(sines, F.floor(at).cast("int")), F.get(sines, F.ceil(at).cast("int"))
    return lo + (hi - lo) * (at - F.floor(at))


# ---- detection -----------------------------------------------------------------------------------------------------


def _names(mask: list[Column], names: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(m, F.lit(n)) for m, n in zip(mask, names)]))


def detect_drift(spec: DataFrame, calib: DataFrame, dims: ModelDims, by: list[str] = []) -> DataFrame:
    """Attribution per period: mechanisms, gap, level z, affected views and models.  One row per period in and out."""
    names, k = list(dims.views), dims.size
    j = attach(spec, calib, by).withColumn("r", F.size(F.filter("eigenvalues", lambda x: x > F.col("tau"))))
    j = with_loadings(j, dims, F.greatest("r", F.lit(1)))
    l1, l2, floor_tau = F.get("eigenvalues", F.lit(0)), F.get("eigenvalues", F.lit(1)), F.greatest("tau", F.lit(1e-10))
    at = lambda c, i: F.get(c, F.lit(i))
    j = j.withColumns({
        "drift_detected": F.col("r") > 0,
        "spectral_gap": F.when((F.col("r") >= 2) & (l2 > 1e-10), l1 / l2).when(F.col("r") == 1, l1 / floor_tau).otherwise(0.0),
        "confidence": F.when(F.col("r") > 0, l1 / floor_tau).otherwise(0.0),
        "level_z": stored([(at("level_loadings", i) - at("level_mu", i)) / at("level_sd", i) for i in range(len(dims.levels))]),
        "mechanism_strengths": F.slice("eigenvalues", F.lit(1), F.col("r"))})
    over = _names([at("view_loadings", i) > at("view_mu", i) + 3 * at("view_sd", i) for i in range(len(names))], names)
    lead = F.array_sort(F.array(*[F.struct((-F.get(at("weights", 0), F.lit(m))).alias("w"), F.lit(-m).alias("m"), F.lit(dims.views_of[m]).alias("v")) for m in range(k)]))
    fallback = F.array_distinct(F.transform(F.slice(lead, 1, max(1, k // 3)), lambda s: s["v"]))
    j = j.withColumn("affected_views", F.when((F.size(over) == 0) & F.col("drift_detected"), fallback).otherwise(over))
    per_component = F.transform(_components(F.col("r")), lambda c: _names(
        [_view_load(c, m) > at("view_mu", i) + 2 * at("view_sd", i) for i, m in enumerate(dims.views.values())], names))
    affected = [F.array_contains("affected_views", v) for v in dims.views_of]
    j = j.withColumn("mechanism_views", F.filter(per_component, lambda v: F.size(v) > 0)).withColumn(
        "healthy_models", F.array_compact(F.array(*[F.when(~m, F.lit(i)) for i, m in enumerate(affected)]))).withColumn(
        "affected_models", F.array_compact(F.array(*[F.when(m, F.lit(i)) for i, m in enumerate(affected)])))
    return j


@F.pandas_udf(T.DoubleType())
def _sine_to_span(vec: pd.Series, history: pd.Series) -> pd.Series:
    import numpy as np

    def one(d, h):
        d = np.asarray(d, dtype=float)
        norm = np.linalg.norm(d)
        if h is None or len(h) < 2 or norm < 1e-10:
            return 0.0
        _, s, vt = np.linalg.svd(np.array([list(x) for x in h], dtype=float), full_matrices=False)
        basis = vt[:max(1, min(5, int((s > s[0] * 0.1).sum())))]
        return float(np.linalg.norm(d - basis.T @ (basis @ d)) / norm)
    return pd.Series([one(d, h) for d, h in zip(vec, history)])


def novelty(reports: DataFrame, dims: ModelDims, by: list[str] = [], order: str = "period") -> DataFrame:
    """Sine of the angle to the span of the last 20 drift vectors, 0 until as many drifts as views were seen."""
    w = Window.partitionBy(*by).orderBy(order)
    drifted = reports.where("drift_detected").select(*by, order, F.collect_list("view_loadings").over(w.rowsBetween(-19, 0)).alias("__h"),
                                                     F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__n"))
    j = reports.join(drifted, [*by, order], "left")
    prev = F.last(F.struct("__h", "__n"), True)
    seen = F.when(F.col("__n").isNotNull(), F.struct("__h", "__n"))
    j = j.withColumn("__p", F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    ready = F.col("__p.__n") >= len(dims.views)
    return j.withColumn("novelty", F.coalesce(_sine_to_span("view_loadings", F.when(ready, F.col("__p.__h"))), F.lit(0.0))).drop("__h", "__n", "__p")


def drift_type(detected: Column, shares: list[Column], limits: list[Column], nov: Column, eta: Column, l1: Column, tau: Column) -> Column:
    """Decision tree; ``shares`` and ``limits`` are surface, structure, global."""
    ds, dr, dg = (s > x for s, x in zip(shares, limits))
    novel = F.when(nov > eta, PARADIGM).otherwise(STRUCTURAL)
    return (F.when(~detected, NONE).when(ds & dr & dg, novel).when(dr, STRUCTURAL).when(dg, novel).when(ds, PERTURBATION)
            .when(l1 > tau * 2, STRUCTURAL).otherwise(PERTURBATION))


# Reaction per drift type.
STRATEGY = {PERTURBATION: "auto_adapt", STRUCTURAL: "selective_retrain", PARADIGM: "full_retrain"}


def with_strategy(df: DataFrame, healthy_share: Column, size: int) -> DataFrame:
    """Strategy and label budget of a drift type."""
    t, gap = F.col("drift_type"), F.greatest(healthy_share, F.lit(0.01))
    budget = F.when(t == PERTURBATION, F.lit(max(10, 2 * size))).when(t == STRUCTURAL, F.ceil(F.lit(200.0) / gap)).when(t == PARADIGM, F.ceil(F.lit(500.0) / gap)).otherwise(0)
    name = F.coalesce(*[F.when(t == k, v) for k, v in STRATEGY.items()], F.lit("none"))
    return df.withColumn("strategy", name).withColumn("label_budget", budget.cast("int"))


def classify_drift(reports: DataFrame, dims: ModelDims) -> DataFrame:
    order = [list(dims.levels).index(x) for x in ("surface", "structure", "global")]
    pick = lambda c: [F.get(c, F.lit(i)) for i in order]
    kind = drift_type(F.col("drift_detected"), pick("level_share"), pick("class_tau"), F.col("novelty"), F.col("eta"), F.get("eigenvalues", F.lit(0)), F.col("tau"))
    return with_strategy(reports.withColumn("drift_type", kind), F.size("healthy_models") / float(dims.size), dims.size)


# ---- per-sample evidence ---------------------------------------------------------------------------------------------


def view_dispersion(scores: DataFrame, dims: ModelDims) -> DataFrame:
    """Add ``disp``: spread of the present models per view; a view with one model uses its distance from 0.5."""
    s = elements("scores", dims.size)
    groups = list(dims.views.values())
    df = scores.withColumn("__means", stored([mean_present([s[k] for k in g]) for g in groups]))
    disp = [F.abs(s[g[0]] - 0.5) if len(g) == 1 else spread_present([s[k] for k in g], F.get("__means", F.lit(i))) for i, g in enumerate(groups)]
    return df.withColumn("disp", stored(disp)).drop("__means")


def calibrate_samples(dispersed: DataFrame, dims: ModelDims, by: list[str] = []) -> DataFrame:
    """Mean and population deviation (at least 1e-4) of the dispersion per view, as two arrays."""
    n = len(dims.views)
    return dispersed.groupBy(*by).agg(_each("disp", n, F.avg).alias("disp_mu"), _each("disp", n, lambda c: F.greatest(F.stddev_pop(c), F.lit(1e-4))).alias("disp_sd"))


def with_baseline(df: DataFrame, calib: DataFrame, by: list[str] = []) -> DataFrame:
    return attach(df, calib, by)


def score_samples(dispersed: DataFrame, calib: DataFrame, dims: ModelDims, by: list[str] = []) -> DataFrame:
    """Evidence per level, anomaly score, drift candidate and type of every sample; no shuffle.

    ``calib``: disp_mu, disp_sd, class_tau (by level) and sample_z.  An absent view adds no evidence.
    """
    names = list(dims.views)
    df = attach(dispersed, calib, by)
    at = lambda c, i: F.get(c, F.lit(i))
    z = [F.coalesce(F.greatest((at("disp", i) - at("disp_mu", i)) / at("disp_sd", i), F.lit(0.0)), F.lit(0.0)) for i in range(len(names))]
    df = df.withColumn("__z", stored(z))
    levels = list(dims.levels)
    df = df.withColumns({f"ev_{lv}": add([at("__z", names.index(v)) for v in vs]) / float(len(vs)) for lv, vs in dims.levels.items()})
    ev = {lv: F.col(f"ev_{lv}") for lv in levels}
    df = df.withColumn("anomaly", greatest_present(list(ev.values())))
    total = add(list(ev.values())) + 1e-10
    dom = {lv: ev[lv] / total > at("class_tau", i) for i, lv in enumerate(levels)}
    ds, dr, dg = dom["surface"], dom["structure"], dom["global"]
    kind = (F.when(F.col("anomaly") < F.col("sample_z"), NONE).when(ds & dr & dg, PARADIGM).when(dr, STRUCTURAL).when(ds & ~dg, PERTURBATION)
            .when(dg, PARADIGM).otherwise(STRUCTURAL))
    return df.withColumn("is_candidate", F.col("anomaly") > F.col("sample_z")).withColumn("sample_type", kind).drop("__z", *calib.columns)


# ---- conformal sets, reweighting, pseudo labels ------------------------------------------------------------------------


PERIODS_AT_ONCE = 16


def conformal(cal: DataFrame, test: DataFrame, healthy: DataFrame, size: int, alpha: float = 0.10) -> DataFrame:
    """Drift-adaptive prediction sets per test period: (period, n_cal, quantile, bound, mean set size, coverage).

    ``healthy`` has one row (period, healthy_models) per test period; these report rows are read first.  Calibration rows are read
    once and merged into one (label, score) histogram per *distinct* set of models.  The weights of a period are a function
    of the score, so they are columns over the histogram, PERIODS_AT_ONCE at a time; no row is repeated per period.  A
    weighted quantile is found digit by digit: each pass adds up the weights per digit among the rows that share the digits
    found so far, which is one aggregation without any sort, and the last one reads off the exact distance.
    """
    plan = sorted(((r["period"], tuple(sorted(set(r["healthy_models"] or [])))) for r in healthy.select("period", "healthy_models").collect()), key=lambda r: r[0])
    masks = sorted({m for _, m in plan})
    scores = elements("scores", size)
    means = [mean_present([scores[i] for i in (m or range(size))]) for m in masks]
    hist = reliable_table(cal.select("y", F.inline(F.array(*[F.struct(F.lit(i).alias("m"), e.alias("e")) for i, e in enumerate(means)]))).where("e is not null")
                          .groupBy("m", "y", "e").agg(F.count(F.lit(1)).cast("double").alias("k")))
    k, e = F.col("k"), F.col("e")
    n = F.sum("k")
    base = hist.groupBy("m").agg(n.alias("n"), (F.sum(k * (e - 0.5)) / n).alias("s"), (F.sum(k * F.pow(e - 0.5, 2)) / n).alias("q")).collect()
    base = {r["m"]: (r["n"], r["s"] + 0.5, max(math.sqrt(max(r["q"] - r["s"] ** 2, 0.0)), 1e-8)) for r in base}
    own = F.coalesce(*[F.when(F.col("period").isin([p for p, m in plan if m == mask]), means[i]) for i, mask in enumerate(masks)])
    t = test.where(F.col("period").isin([p for p, _ in plan])).select("period", "y", own.alias("e"))
    shape = {r["period"]: (r["tm"], max(r["ts"], 1e-8)) for r in t.groupBy("period").agg(F.avg("e").alias("tm"), F.stddev_pop("e").alias("ts")).where("tm is not null").collect()}
    found = []
    known = [(p, masks.index(m)) for p, m in plan if p in shape and masks.index(m) in base]
    for lo in range(0, len(known), PERIODS_AT_ONCE):
        found += _weighted_quantiles(hist, [(p, m, *base[m], *shape[p]) for p, m in known[lo:lo + PERIODS_AT_ONCE]], alpha)
    if not found:
        return t.groupBy("period").agg(F.lit(0).cast("bigint").alias("n_cal"), *[F.avg("e").alias(c) for c in ("quantile", "bound", "mean_set_size", "coverage")]).where(F.lit(False))
    q = test.sparkSession.createDataFrame(found, f"period {dict(test.dtypes)['period']}, n_cal bigint, quantile double, bound double")
    s = t.join(F.broadcast(q), "period")
    in0, in1 = F.abs("e") <= F.col("quantile"), F.abs(F.col("e") - 1.0) <= F.col("quantile")
    rounded = F.bround("e").cast("int")
    has = lambda y, inside: inside | (~in0 & ~in1 & (rounded == y))
    s = s.select("period", "n_cal", "quantile", "bound", (has(0, in0).cast("int") + has(1, in1).cast("int")).alias("size"),
                 F.when(F.col("y") == 1, has(1, in1)).otherwise(has(0, in0)).cast("double").alias("hit"))
    return s.groupBy("period", "n_cal", "quantile", "bound").agg(F.avg("size").alias("mean_set_size"), F.avg("hit").alias("coverage"))


def _weighted_quantiles(hist: DataFrame, periods: list[tuple], alpha: float) -> list[tuple]:
    """(period, n, quantile, bound) of each (period, mask, n, mean and deviation of calibration, mean and deviation of the period)."""
    e = F.col("e")
    here = [F.col("m") == m for _, m, *_ in periods]
    ratio = [F.pow((e - cm) / cs, 2) * 0.5 - F.pow((e - tm) / ts, 2) * 0.5 for _, _, _, cm, cs, tm, ts in periods]
    tops = hist.agg(*[F.max(F.when(h, r)).alias(f"t{i}") for i, (h, r) in enumerate(zip(here, ratio))]).first()
    rows = hist.select("m", F.abs(e - F.col("y")).alias("nc"), "k", *[F.when(h, F.least(F.greatest(F.exp(r - F.lit(tops[i])), F.lit(0.01)), F.lit(100.0))).alias(f"w{i}") for i, (h, r) in enumerate(zip(here, ratio))])
    digits = [f"d{i}" for i in range(3)]
    rows = rows.select("*", *[d.alias(name) for d, name in zip(real_digits(F.col("nc")), digits)])
    total = rows.agg(*[a for i, h in enumerate(here) for a in (F.sum(F.col(f"w{i}") * F.col("k")), F.max(f"w{i}"), F.min(f"w{i}"), F.max(F.when(h, F.col("nc"))))]).first()
    level = [min((1 + 1 / n) * (1 - alpha), 1.0) for _, _, n, *_ in periods]
    wanted = [(level[i] - 1e-12) * total[4 * i] for i in range(len(periods))]
    before, prefix = [0.0] * len(periods), [[] for _ in periods]
    for depth in range(len(digits) + 1):
        # the last pass goes by the distances themselves: at most 65,536 share all digits
        by = digits[depth] if depth < len(digits) else "nc"
        inside = [F.col("m") == m for _, m, *_ in periods]
        for i, p in enumerate(prefix):
            for d, v in zip(digits, p):
                inside[i] = inside[i] & (F.col(d) == v)
        any_of = inside[0]
        for c in inside[1:]:
            any_of = any_of | c
        cells = rows.where(any_of).groupBy(by).agg(*[F.sum(F.when(c, F.col(f"w{i}") * F.col("k"))).alias(f"s{i}") for i, c in enumerate(inside)]).orderBy(by).toPandas()
        for i in range(len(periods)):
            own = cells[cells[f"s{i}"].notna()]
            reached = before[i] + own[f"s{i}"].cumsum()
            at = int(np.searchsorted(reached.to_numpy(), wanted[i])) if len(own) else 0
            at = min(at, len(own) - 1)
            if at > 0:
                before[i] = float(reached.iloc[at - 1])
            value = own[by].iloc[at]
            prefix[i].append(float(value) if by == "nc" else int(value))
    out = []
    for i, (p, _, n, *_) in enumerate(periods):
        spread = total[4 * i + 1] / max(total[4 * i + 2], 1e-8)
        out.append((p, int(n), prefix[i][-1], max(0.0, 1 - alpha - spread / (n + 1))))
    return out


def reweight(df: DataFrame, detected: Column, view_deltas: Column, dims: ModelDims, name: str = "weights") -> DataFrame:
    """Add model weights lowered by view impact, equal when there is no drift or it hits all views alike."""
    k = dims.size
    names = list(dims.views)
    impact = [F.greatest(F.get(view_deltas, F.lit(names.index(v))), F.lit(0.0)) for v in dims.views_of]
    out = df.withColumn("__i", stored(impact)).withColumn("__top", F.array_max("__i"))
    out = out.withColumn("__rel", F.transform("__i", lambda x: x / F.greatest(F.col("__top"), F.lit(1e-300))))
    out = out.withColumn("__used", F.filter("__rel", lambda x: x > 0.01)).withColumn("__n", F.size("__used"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("__mean", total("__used") / F.greatest("__n", F.lit(1)))
    out = out.withColumn("__var", total(F.transform("__used", lambda x: (x - F.col("__mean")) * (x - F.col("__mean")))) / F.greatest("__n", F.lit(1)))
    uniform = (F.col("__n") > 1) & (F.sqrt("__var") / F.greatest("__mean", F.lit(1e-8)) < 0.25)
    out = out.withColumn("__raw", F.transform("__rel", lambda x: F.greatest(F.lit(1.0) - F.sqrt(x) * 0.4, F.lit(0.5 / k)))).withColumn("__sum", total("__raw"))
    weights = F.when(~detected | (F.col("__top") < 1e-6) | uniform, F.array_repeat(F.lit(1.0 / k), k)).otherwise(F.transform("__raw", lambda x: x / F.col("__sum")))
    # generated as one column: a filter that the planner derives from a later explode would otherwise repeat all steps inside each other
    return out.select(*[c for c in df.columns if c != name], F.explode(F.array(weights)).alias(name))


def pseudo_labels(scores: DataFrame, healthy: list[int], size: int, thr: float = 0.85) -> DataFrame:
    """Majority label of the healthy models and its agreement, kept where the agreement reaches ``thr``."""
    s = elements("scores", size)
    votes = mean_present([exceeds(s[k], 0.5, True) for k in healthy])
    df = scores.withColumn("__v", votes).withColumn("pseudo", F.bround("__v").cast("int"))
    df = df.withColumn("agreement", F.greatest(F.col("__v"), F.lit(1.0) - F.col("__v")))
    if len(healthy) < 2:
        return df.where(F.lit(False)).drop("__v")
    return df.where(F.col("agreement") >= thr).drop("__v")


def pseudo_quality(scores: DataFrame, healthy: list[int], size: int, thr: float = 0.85) -> DataFrame:
    """Share of samples that get a pseudo label and its accuracy, per period."""
    kept = pseudo_labels(scores, healthy, size, thr).groupBy("period").agg(
        F.count(F.lit(1)).alias("kept"), F.avg((F.col("pseudo") == F.col("y")).cast("double")).alias("accuracy"))
    n = scores.groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    return n.join(kept, "period", "left").select("period", "n", F.coalesce("kept", F.lit(0)).alias("kept"), ratio(F.coalesce("kept", F.lit(0)), F.col("n")).alias("rate"), "accuracy")


def pseudo_by_period(scores: DataFrame, healthy: DataFrame, size: int, thr: float = 0.85) -> DataFrame:
    """``pseudo_quality`` with each period's own models: ``healthy`` has one row (period, healthy_models) per period.

    A period with fewer than two healthy models keeps none of its samples.
    """
    s = elements("scores", size)
    own = scores.join(F.broadcast(healthy.select("period", F.col("healthy_models").alias("__h"))), "period")
    votes = mean_present([F.when(F.array_contains("__h", k), exceeds(c, 0.5, True)) for k, c in enumerate(s)])
    own = own.select("period", "y", F.when(F.size("__h") >= 2, votes).alias("__v"))
    kept = F.coalesce(F.greatest(F.col("__v"), F.lit(1.0) - F.col("__v")) >= thr, F.lit(False))
    right = (F.bround("__v").cast("int") == F.col("y")).cast("double")
    g = own.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum(kept.cast("bigint")).alias("kept"), F.avg(F.when(kept, right)).alias("accuracy"))
    return g.select("period", "n", "kept", ratio(F.col("kept"), F.col("n")).alias("rate"), "accuracy")


# ---- sequential baselines --------------------------------------------------------------------------------------------


def cusum(df: DataFrame, k: float | Column, keys: list[str], epoch: str = "epoch", order: str = "period", z: str = "z") -> DataFrame:
    """``S = max(0, S + max(z, 0) - k)`` restarted at every epoch, in closed form over running sums and minima.

    One row per period and level; a group is as long as its number of periods.
    """
    k = F.lit(k) if isinstance(k, (int, float)) else k
    w = Window.partitionBy(*keys, epoch).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    c = df.withColumn("__c", F.sum(F.greatest(F.col(z), F.lit(0.0)) - k).over(w))
    return c.withColumn("cusum", F.col("__c") - F.least(F.lit(0.0), F.min("__c").over(w))).drop("__c")


def rolling_baseline(d: DataFrame, window: int, order: str = "period") -> DataFrame:
    w = Window.partitionBy("mi", "mj").orderBy(order).rowsBetween(-(window - 1), 0)
    return d.withColumn("mu", F.avg("d").over(w)).withColumn("sigma", F.stddev_samp("d").over(w))


def ema_baseline(d: DataFrame, decay: float = 0.9, order: str = "period", sigma0: float = 0.0) -> DataFrame:
    """Exponential mean and deviation per cell, folded over its few periods in order."""
    seq = d.groupBy("mi", "mj").agg(F.array_sort(F.collect_list(F.struct(order, "d"))).alias("s"))
    start = F.struct(F.get("s", F.lit(0))["d"].alias("mu"), F.lit(float(sigma0) ** 2).alias("var"))

    def step(acc, x):
        gap = x["d"] - acc["mu"]
        return F.struct((acc["mu"] * decay + x["d"] * (1 - decay)).alias("mu"), (acc["var"] * decay + gap * gap * (1 - decay)).alias("var"))
    out = F.aggregate(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), start, step)
    return seq.select("mi", "mj", out.alias("o")).select("mi", "mj", F.col("o.mu").alias("mu"), F.sqrt("o.var").alias("sigma"))


# ---- reports ---------------------------------------------------------------------------------------------------------

# Public technique id and name per view of the bound example.
TECHNIQUE = {"V_byte": ("T1027.002", "Software Packing"), "V_string": ("T1027", "Obfuscated Files or Information"), "V_struct": ("T1036.005", "Match Legitimate Name or Location"),
             "V_import": ("T1027.007", "Dynamic API Resolution"), "V_all": ("Multiple", "Multi-vector evasion")}
# What to look at first when a view has drifted.
ADVICE = {"V_byte": "Compare byte histograms of new and old samples and recalibrate.", "V_string": "Sample the texts that newly appear and check how they are encoded.",
          "V_struct": "Check header and section fields of new samples.", "V_import": "List imported names that vanished or are resolved at run time.",
          "V_all": "Several views moved together: review the newest period as a whole."}


def severity(kind: Column, r: Column, healthy_share: Column) -> Column:
    return (F.when((kind == PARADIGM) | ((r >= 4) & (healthy_share < 0.3)), "CRITICAL").when((kind == STRUCTURAL) | (r >= 2), "HIGH")
            .when(kind == PERTURBATION, "MEDIUM").otherwise("LOW"))


def attribute(reports: DataFrame, dims: ModelDims, technique: dict[str, tuple[str, str]] = TECHNIQUE, advice: dict[str, str] = ADVICE) -> DataFrame:
    """One row per affected view: technique, advice and confidence = loading / largest loading.  Views without an entry have NULLs there."""
    from quorate.functions.rows import literal_rows
    dim = literal_rows(reports.sparkSession, [(v, *technique[v], advice.get(v)) for v in technique], "view string, technique_id string, technique string, remediation string")
    names = list(dims.views)
    rows = reports.select("period", F.explode("affected_views").alias("view"), "view_loadings", F.array_max("view_loadings").alias("__m"))
    load = F.get("view_loadings", F.array_position(F.array(*[F.lit(v) for v in names]), F.col("view")).cast("int") - 1)
    conf = F.when(F.col("__m") > 0, F.least(F.lit(1.0), F.greatest(load, F.lit(0.0)) / F.greatest("__m", F.lit(1e-10)))).otherwise(0.5)
    return rows.join(F.broadcast(dim), "view", "left").select("period", "view", "technique_id", "technique", "remediation", conf.alias("confidence"))


def report_text(reports: DataFrame, size: int) -> DataFrame:
    """Severity and a one-line text per drifted period."""
    share = F.size("healthy_models") / float(size)
    pct = F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("%"))
    why = (F.when(F.col("strategy") == "auto_adapt", F.concat(pct, F.lit(" of the models still hold; weights follow without labels")))
           .when(F.col("strategy") == "selective_retrain", F.concat(F.lit("retrain the affected models with about "), F.col("label_budget").cast("string"), F.lit(" labels")))
           .when(F.col("strategy") == "full_retrain", F.concat(F.lit("retrain all models with about "), F.col("label_budget").cast("string"), F.lit(" labels"))).otherwise("nothing to do"))
    sev = severity(F.col("drift_type"), F.col("r"), share)
    text = F.concat_ws(" | ", F.concat(F.lit("Type: "), F.col("drift_type")), F.concat(F.lit("Severity: "), sev), F.concat(F.lit("Mechanisms: "), F.col("r").cast("string")), why)
    return reports.where("drift_detected").select("period", sev.alias("severity"), text.alias("report"))


def separability(dims: ModelDims) -> float:
    """Largest Jaccard overlap of the model sets of two levels."""
    sets = [{m for v in vs for m in dims.views[v]} for vs in dims.levels.values()]
    return max((len(a & b) / max(len(a | b), 1) for i, a in enumerate(sets) for b in sets[i + 1:]), default=0.0)


def separability_table(members: DataFrame, group: str, item: str) -> DataFrame:
    """Jaccard overlap of item sets per pair of groups, from shared items only plus set sizes."""
    m = members.select(group, item).distinct()
    sizes = m.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    # the groups (levels) of one item are few, so pairs come from the item's own group list
    pairs = m.groupBy(item).agg(F.array_sort(F.collect_set(group)).alias("g")).where(F.size("g") > 1)
    pairs = pairs.select(F.explode(F.flatten(F.transform("g", lambda a, i: F.transform(F.slice("g", i + 2, F.size("g")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    both = pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("both"))
    j = both.join(sizes.select(F.col(group).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(group).alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def group_shift(train: DataFrame, evaluation: DataFrame, groups: dict[str, tuple[int, int]], tau: float = 0.5, by: list[str] = ["period"]) -> DataFrame:
    """Mean standardised shift of the feature means per group of dimensions and the resulting drift type.

    Only per-dimension moments are joined.
    """
    mu = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - mu * mu, F.lit(0.0)))
    base = vector_moments(train, [], "vec").select("dim", mu.alias("mu"), F.greatest(sd, F.lit(1e-8)).alias("sd"))
    ev = vector_moments(evaluation, by, "vec").select(*by, "dim", mu.alias("m"))
    j = ev.join(F.broadcast(base), "dim").withColumn("shift", F.abs(F.col("m") - F.col("mu")) / F.col("sd"))
    agg = [F.coalesce(F.avg(F.when((F.col("dim") >= lo) & (F.col("dim") < hi), F.col("shift"))), F.lit(0.0)).alias(f"{g}_shift") for g, (lo, hi) in groups.items()]
    out = j.groupBy(*by).agg(*agg, F.avg("shift").alias("global_shift"))
    s, r, g = F.col("surface_shift") > tau, F.col("structure_shift") > tau, F.col("global_shift") > tau
    kind = F.when(~(s | r | g), NONE).when(s & r & g, PARADIGM).when(r, STRUCTURAL).when(s, PERTURBATION).otherwise(STRUCTURAL)
    return out.withColumn("drift_type", kind)


def min_detectable(level_sd: list[float], size: int, alpha: float = 0.05) -> tuple[float, int]:
    z = NormalDist().inv_cdf(1 - alpha / max(len(level_sd), 1))
    return max(level_sd, default=1.0) * z, size + 1


def pseudo_quality_bound(healthy_share: float, size: int, accuracy: float = 0.85) -> float:
    h = max(int(healthy_share * size), 1)
    return 1.0 - math.exp(-2 * h * (max(accuracy, 0.51) - 0.5) ** 2)
