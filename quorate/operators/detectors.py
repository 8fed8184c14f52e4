"""Seven reference drift detectors.  Each compares calibration rows with the rows of every test period.

All work on the score array (an absent model counts as 0.5 where a full matrix is needed) and return one row per period
with ``detected`` and its diagnostics.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions.columns import add, binary_entropy, elements, exceeds, mean_present, spread_present, stored
from quorate.functions.rows import product_sums
from quorate.operators import ordering
from quorate.operators.scores import disagreement_rate
from quorate.operators.statistics import kolmogorov_p
from quorate.session import reliable_table


def _one(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach a single calibration row."""
    return df.crossJoin(F.broadcast(row))


def _full(scores: DataFrame, size: int) -> list[Column]:
    return [F.coalesce(c, F.lit(0.5)) for c in elements("scores", size)]


def with_ensemble(scores: DataFrame, size: int) -> DataFrame:
    return scores.withColumn("e", mean_present(elements("scores", size)))


def confidence(e: Column) -> Column:
    return F.greatest(e, F.lit(1.0) - e)


def _ks_by_period(cal: DataFrame, test: DataFrame, value: str) -> DataFrame:
    """Distance of every test period to all calibration rows."""
    ks = ordering.ks_against(cal, test, ["period"], value)
    least = F.least("n_a", "n_b").cast("double")
    return ks.withColumn("ks_p", kolmogorov_p(F.col("ks"), F.col("n_a"), F.col("n_b"))).withColumn("min_ks", F.greatest(F.lit(0.04), F.lit(3.0) / F.sqrt(least))).drop("n_a", "n_b")


def _moments(col: str, floor: float) -> list[Column]:
    return [F.avg(col).alias("cal_mean"), F.greatest(F.stddev_pop(col), F.lit(floor)).alias("cal_sd")]


def uncertainty(cal: DataFrame, test: DataFrame, size: int, key: str = "sample_id", sig: float = 0.05) -> DataFrame:
    """Distance test on uncertainty plus model spread, or a mean shift above 2.5 deviations."""
    def ncm(df):
        s = elements("scores", size)
        df = with_ensemble(df, size)
        return df.select(key, "period", (F.lit(1.0) - confidence(F.col("e")) + spread_present(s, F.col("e"))).alias("ncm"))
    c, t = reliable_table(ncm(cal)), reliable_table(ncm(test))  # the measure is computed once per row, not once per use
    base = c.agg(*_moments("ncm", 1e-6))
    mean = _one(t.groupBy("period").agg(F.avg("ncm").alias("m")), base)
    j = mean.join(_ks_by_period(c, t, "ncm"), "period").withColumn("shift", F.abs(F.col("m") - F.col("cal_mean")) / F.col("cal_sd"))
    return j.select("period", ((F.col("ks_p") < sig) & (F.col("ks") > F.col("min_ks")) | (F.col("shift") > 2.5)).alias("detected"), "ks", "shift")


def covariance(df: DataFrame, size: int) -> DataFrame:
    """Upper triangle (i, j, mean_i, mean_j, cov) of the score covariance from partial sums."""
    sums = product_sums(df.select(F.array(*_full(df, size)).alias("v")), "v", size)
    n = F.col("n")
    return sums.select("i", "j", (F.col("si") / n).alias("mean_i"), (F.col("sj") / n).alias("mean_j"), (F.col("sij") / n - F.col("si") / n * F.col("sj") / n).alias("cov"))


def principal_axes(cov: DataFrame, size: int, share: float = 0.5) -> DataFrame:
    """One row (mu, axes): the leading components of a K x K covariance; only K(K+1)/2 rows reach the grouped function."""
    import numpy as np
    k = min(max(2, int(size * share)), size - 1)

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        m, mu = np.zeros((size, size)), np.zeros(size)
        m[cells.i, cells.j] = m[cells.j, cells.i] = cells["cov"]
        mu[cells.i] = cells.mean_i
        _, vec = np.linalg.eigh(m)
        return pd.DataFrame({"mu": [mu.tolist()], "axes": [vec[:, ::-1][:, :k].T.tolist()]})

    return cov.withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(solve, "mu array<double>, axes array<array<double>>")


def reconstruction_error(df: DataFrame, axes: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """Distance between a centred score row and its projection on the axes."""
    d = _one(df, axes)
    d = d.withColumn("__c", stored([x - F.get("mu", F.lit(i)) for i, x in enumerate(_full(df, size))]))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    kept = F.aggregate(F.transform("axes", lambda v: F.pow(dot(v, F.col("__c")), 2)), F.lit(0.0), lambda s, x: s + x)
    return d.select(*keep, F.sqrt(F.greatest(dot(F.col("__c"), F.col("__c")) - kept, F.lit(0.0))).alias("error"))


def reconstruction(cal: DataFrame, test: DataFrame, size: int, pct: float = 0.95) -> DataFrame:
    """Outlier share above the calibration percentile of the reconstruction error, or its mean shift."""
    axes = reliable_table(principal_axes(covariance(cal, size), size))
    # one number per row, read by every round of the percentile
    c = reliable_table(reconstruction_error(cal, axes, size, []))
    base = c.agg(*_moments("error", 1e-6)).crossJoin(F.broadcast(ordering.percentiles(c, [], "error", {"limit": pct})))
    t = _one(reconstruction_error(test, axes, size, ["period"]), base)
    g = t.groupBy("period").agg(F.avg((F.col("error") > F.col("limit")).cast("double")).alias("outlier_ratio"),
                                ((F.avg("error") - F.first("cal_mean")) / F.first("cal_sd")).alias("shift"))
    return g.select("period", ((F.col("outlier_ratio") > 0.10) | (F.col("shift") > 2.0)).alias("detected"), "outlier_ratio", "shift")


def mask_weights(size: int, seed: int, n: int = 30, drop: float = 0.25) -> list[list[float]]:
    """Model weights of ``n`` random masks; a model is dropped when its hash falls below ``drop``."""
    out = []
    for i in range(n):
        keep = [int(hashlib.md5(f"{seed}:{i}:{k}".encode()).hexdigest()[:8], 16) / 2**32 > drop for k in range(size)]
        if not any(keep):
            keep[0] = True
        out.append([1.0 / sum(keep) if x else 0.0 for x in keep])
    return out


def mask_variance_of(scores: DataFrame, size: int, seed: int, n: int = 30) -> Column:
    """Variance of the masked means.  It is the quadratic form of the mask covariance, so no row is repeated per mask."""
    w = mask_weights(size, seed, n)
    mean = [sum(r[k] for r in w) / n for k in range(size)]
    x = _full(scores, size)
    terms = []
    for i in range(size):
        for j in range(i, size):
            c = sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in w) / n
            terms.append(x[i] * x[j] * (c if i == j else 2 * c))
    return F.greatest(add(terms), F.lit(0.0))


def mask_variance(cal: DataFrame, test: DataFrame, size: int) -> DataFrame:
    """Share of rows above the calibration p90 of the masked variance, or its mean shift."""
    c = reliable_table(cal.select(mask_variance_of(cal, size, 42).alias("v")))
    base = c.agg(*_moments("v", 1e-8)).crossJoin(F.broadcast(ordering.percentiles(c, [], "v", {"p90": 0.9})))
    t = _one(test.select("period", mask_variance_of(test, size, 123).alias("v")), base)
    g = t.groupBy("period").agg(F.avg((F.col("v") > F.col("p90")).cast("double")).alias("exceed_ratio"), ((F.avg("v") - F.first("cal_mean")) / F.first("cal_sd")).alias("shift"))
    return g.select("period", ((F.col("exceed_ratio") > 0.15) | (F.col("shift") > 2.0)).alias("detected"), "exceed_ratio", "shift")


def _profile(df: DataFrame, size: int, keys: list[str]) -> DataFrame:
    e = with_ensemble(df, size)
    return e.groupBy(*keys).agg(F.avg(binary_entropy(F.col("e"))).alias("entropy"), F.avg(exceeds(F.col("e"), 0.5, True).cast("double")).alias("ratio"),
                                F.avg(confidence(F.col("e"))).alias("conf"))


def accumulated(ent_shift: Column, ratio_shift: Column, keys: list[str] = [], order: str = "period") -> Column:
    """Running evidence over periods."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.greatest(ent_shift, F.lit(0.0)) * 0.3 + ratio_shift * 0.5).over(w)


def entropy_ratio(cal: DataFrame, test: DataFrame, size: int) -> DataFrame:
    """Entropy rise, class-ratio shift, confidence drop, or their accumulation over periods."""
    base = _profile(cal, size, []).select(*[F.col(c).alias(f"c_{c}") for c in ("entropy", "ratio", "conf")])
    j = _one(_profile(test, size, ["period"]), base)
    j = j.withColumns({"ent_shift": (F.col("entropy") - F.col("c_entropy")) / F.greatest("c_entropy", F.lit(1e-6)), "ratio_shift": F.abs(F.col("ratio") - F.col("c_ratio")),
                       "conf_drop": (F.col("c_conf") - F.col("conf")) / F.greatest("c_conf", F.lit(1e-6))})
    j = j.withColumn("accumulated", accumulated(F.col("ent_shift"), F.col("ratio_shift")))
    hit = (F.col("ent_shift") > 0.15) | (F.col("ratio_shift") > 0.08) | (F.col("conf_drop") > 0.05) | (F.col("accumulated") > 0.5)
    return j.select("period", hit.alias("detected"), "ent_shift", "ratio_shift", "conf_drop", "accumulated")


def centroids(cal: DataFrame, size: int, min_rows: int = 5) -> DataFrame:
    """One row with mean and deviation arrays per class (mu0, sd0, mu1, sd1); NULL for a class that is too small."""
    x = _full(cal, size)
    aggs = []
    for c in (0, 1):
        own = [F.when(F.col("y") == c, v) for v in x]
        enough = F.count(F.when(F.col("y") == c, 1)) > min_rows
        aggs += [F.when(enough, F.array(*[F.avg(v) for v in own])).alias(f"mu{c}"), F.when(enough, F.array(*[F.greatest(F.stddev_pop(v), F.lit(1e-6)) for v in own])).alias(f"sd{c}")]
    return cal.agg(*aggs)


def centroid_distance(df: DataFrame, size: int, cls: int) -> Column:
    x = _full(df, size)
    return add([F.abs(v - F.get(f"mu{cls}", F.lit(i))) / F.get(f"sd{cls}", F.lit(i)) for i, v in enumerate(x)]) / float(size)


def centroid(cal: DataFrame, test: DataFrame, size: int) -> DataFrame:
    """Mean distance to the nearest class centroid and the share inside the calibration p90."""
    cent = reliable_table(centroids(cal, size))
    own = F.when(F.col("y") == 1, centroid_distance(cal, size, 1)).otherwise(centroid_distance(cal, size, 0))
    c = reliable_table(_one(cal, cent).select(own.alias("z")).where("z is not null"))
    base = c.agg(F.avg("z").alias("cal_mean"), F.greatest(F.stddev_pop("z"), F.lit(0.1)).alias("cal_sd")).crossJoin(F.broadcast(ordering.percentiles(c, [], "z", {"p90": 0.9})))
    rel = _one(c, base).agg(F.avg((F.col("z") < F.col("p90")).cast("double")).alias("cal_reliability"))
    near = F.least(centroid_distance(test, size, 0), centroid_distance(test, size, 1))
    t = _one(_one(_one(test, cent).select("period", near.alias("z")), base), rel)
    g = t.groupBy("period").agg(((F.avg("z") - F.first("cal_mean")) / F.first("cal_sd")).alias("z_shift"), F.avg((F.col("z") < F.col("p90")).cast("double")).alias("reliability"),
                                F.first("cal_reliability").alias("cal_reliability"))
    return g.select("period", ((F.col("z_shift") > 2.0) | (F.col("reliability") < F.col("cal_reliability") * 0.85)).alias("detected"), "z_shift", "reliability")


def confidence_shift(cal: DataFrame, test: DataFrame, size: int, key: str = "sample_id", sig: float = 0.05) -> DataFrame:
    """Confidence drop, entropy rise, or a distance test on the confidence."""
    def prep(df):
        return with_ensemble(df, size).select(key, "period", confidence(F.col("e")).alias("conf"), binary_entropy(F.col("e")).alias("ent"))
    c, t = reliable_table(prep(cal)), reliable_table(prep(test))
    sd = lambda x: F.greatest(F.stddev_pop(x), F.lit(1e-6))
    base = c.agg(F.avg("conf").alias("cm"), sd("conf").alias("cs"), F.avg("ent").alias("em"), sd("ent").alias("es"))
    g = _one(t.groupBy("period").agg(F.avg("conf").alias("conf"), F.avg("ent").alias("ent")), base)
    g = g.join(_ks_by_period(c, t, "conf"), "period").withColumns({"conf_shift": (F.col("cm") - F.col("conf")) / F.col("cs"), "ent_shift": (F.col("ent") - F.col("em")) / F.col("es")})
    hit = (F.col("conf_shift") > 1.5) | (F.col("ent_shift") > 1.5) | ((F.col("ks_p") < sig) & (F.col("ks") > F.col("min_ks")))
    return g.select("period", hit.alias("detected"), "conf_shift", "ent_shift", "ks")


def disagreement(cal: DataFrame, test: DataFrame, size: int, n_sigma: float = 2.5) -> DataFrame:
    """Mean pairwise disagreement above the calibration periods."""
    base = disagreement_rate(cal, size, ["period"]).agg(F.avg("rate").alias("m"), F.greatest(F.stddev_pop("rate"), F.lit(1e-6)).alias("s"))
    j = _one(disagreement_rate(test, size, ["period"]), base)
    limit = F.coalesce(F.col("m") + F.col("s") * n_sigma, F.lit(0.5))
    return j.select("period", (F.col("rate") > limit).alias("detected"), "rate", limit.alias("threshold"), ((F.col("rate") - F.col("m")) / F.col("s")).alias("shift"))


ALL = {"uncertainty": uncertainty, "reconstruction": reconstruction, "mask_variance": mask_variance, "entropy_ratio": entropy_ratio, "centroid": centroid,
       "confidence": confidence_shift, "disagreement": disagreement}

_registered: dict = {}


def register_detector(name: str, fn) -> None:
    """Add a detector ``fn(cal, test, size) -> DataFrame(period, detected, ...)`` to the reports."""
    _registered[name] = fn


def run_all(cal: DataFrame, test: DataFrame, size: int, names: list[str] | None = None) -> DataFrame:
    """Flags of all detectors, built in and registered (or of those named), one row per period."""
    out = test.select("period").distinct()
    for name, fn in {**ALL, **_registered}.items():
        if names is not None and name not in names:
            continue
        flags = reliable_table(fn(cal, test, size).select("period", F.col("detected").alias(f"det_{name}")))
        out = out.join(flags, "period", "left")
    return out
