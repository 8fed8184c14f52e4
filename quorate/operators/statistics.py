"""Paired and two-sample statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions.columns import positive, ratio
from quorate.operators import ordering
from quorate.operators.ordering import real_digits, running, Measure


def kolmogorov_p(stat: Column, n_a: Column, n_b: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample distance (100 terms of the series)."""
    t = stat * F.sqrt(n_a.cast("double") * n_b / (n_a + n_b))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
                         lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * k * k * t * t))
    return F.when(t < 0.2, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks_2samp(a: DataFrame, b: DataFrame, value: str, by: list[str] = []) -> DataFrame:
    """Distance, sizes and p-value between the value columns of two frames, per group."""
    both = a.select(*by, value, F.lit(0).alias("__side")).unionByName(b.select(*by, value, F.lit(1).alias("__side")))
    out = ordering.ks_statistic(both, by, value, "__side")
    return out.withColumn("p_value", kolmogorov_p(F.col("ks"), F.col("n_a"), F.col("n_b")))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided p-value of the smaller discordant count ``k`` of ``n`` at one half."""
    # each term is the one before times (n - i) / (i + 1), in logarithms: one pass over k + 1 terms
    size = n.cast("double")
    start = F.struct(F.lit(0.0).alias("sum"), (size * -math.log(2.0)).alias("term"))
    step = lambda a, i: F.struct((a["sum"] + F.exp(a["term"])).alias("sum"), (a["term"] + F.log(F.greatest(size - i, F.lit(1e-300))) - F.log(i + 1.0)).alias("term"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")), start, step, lambda a: a["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), tail * 2))


def mcnemar(pairs: DataFrame, a: str, b: str, by: list[str] = []) -> DataFrame:
    c = pairs.groupBy(*by).agg(positive(F.col(a) & ~F.col(b)).alias("a_only"), positive(~F.col(a) & F.col(b)).alias("b_only"))
    n = F.col("a_only") + F.col("b_only")
    stat = F.when(n == 0, 0.0).otherwise(F.pow(F.abs(F.col("a_only") - F.col("b_only")) - 1.0, 2) / n)
    return c.select("*", stat.alias("statistic"), binomial_two_sided(F.least("a_only", "b_only"), n).alias("p_value"))


def cohens_h(p1: Column, p2: Column) -> Column:
    clip = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return F.asin(F.sqrt(clip(p1))) * 2 - F.asin(F.sqrt(clip(p2))) * 2


def cohens_d(df: DataFrame, value: str, side: str, by: list[str] = []) -> DataFrame:
    """Standardised mean difference (side 0 minus side 1) with pooled sample variance, 0 for fewer than two rows a side."""
    x = lambda s: F.when(F.col(side) == s, F.col(value))
    g = df.groupBy(*by).agg(F.count(x(0)).alias("n0"), F.count(x(1)).alias("n1"), F.avg(x(0)).alias("m0"), F.avg(x(1)).alias("m1"),
                            F.var_samp(x(0)).alias("v0"), F.var_samp(x(1)).alias("v1"))
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2))
    d = F.when((F.col("n0") < 2) | (F.col("n1") < 2), 0.0).otherwise((F.col("m0") - F.col("m1")) / F.greatest(pooled, F.lit(1e-8)))
    return g.select(*by, d.alias("d")).withColumn("effect", effect_label(F.col("d")))


def effect_label(h: Column) -> Column:
    a = F.abs(h)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def holm(p_values: DataFrame, alpha: float = 0.05, by: list[str] = [], p: str = "p_value", tie: str = "name") -> DataFrame:
    """Step-down correction; one row per comparison, so groups are as small as the list of competitors."""
    w = Window.partitionBy(*by).orderBy(p, tie)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    df = p_values.withColumn("holm_rank", F.row_number().over(w)).withColumn("holm_threshold", F.lit(alpha) / (m - F.row_number().over(w) + 1))
    ok = (F.col(p) < F.col("holm_threshold")).cast("int")
    return df.withColumn("significant", F.min(ok).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)


def poisson_steps(n: int = 9) -> list[float]:
    """Cumulative probabilities of a Poisson(1) variable: a uniform number above k of them draws weight k."""
    out, acc, term = [], 0.0, math.exp(-1.0)
    for i in range(n):
        acc += term
        out.append(acc)
        term /= i + 1
    return out


@dataclass(frozen=True)
class Statistic:
    """A statistic of weighted sums: ``terms`` names what is summed over the rows (times their weight), ``value`` is computed from the sums."""

    terms: dict[str, Column]
    value: Column


def weighted_mean(value: str) -> Statistic:
    return Statistic({"n": F.lit(1.0), "total": F.col(value).cast("double")}, F.col("total") / F.col("n"))


# Odd multipliers of a well-known 32-bit mixing function, and the step from one replicate to the next.
MIX_1, MIX_2, STRIDE = 0x21F0AAAD, 0x735A2D97, 0x9E3779B9


def _mix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(MIX_1)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(MIX_2)
    return x ^ (x >> np.uint32(15))


def draws(high: np.ndarray, low: np.ndarray, n_boot: int) -> np.ndarray:
    """(rows, replicates) Poisson(1) weights: a function of the row's two hash words and the number of the replicate only."""
    step = (np.arange(n_boot, dtype=np.uint64) * np.uint64(STRIDE)).astype(np.uint32)
    x = _mix32(_mix32(high[:, None] + step[None]) ^ low[:, None])
    u = (x.astype(np.float64) + 0.5) / 4294967296.0
    return np.searchsorted(np.array(poisson_steps()), u, side="left").astype(np.uint8)


def replicate_sums(df: DataFrame, key: str, statistic: Statistic, n_boot: int, seed: int) -> DataFrame:
    """(rep, sums of the terms) of every replicate.

    A row's weights come from a counter (its hashed key and the replicate), so they do not depend on partitioning, and no row is
    repeated: a task multiplies its weights with its terms batch by batch and sends replicates x terms numbers, once.
    """
    names = list(statistic.terms)
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    rows = df.select(word(1).alias("__h"), word(9).alias("__l"), *[c.cast("double").alias(f"__t{i}") for i, c in enumerate(statistic.terms.values())])

    def run(batches):
        sums = np.zeros((n_boot, len(names)))
        for b in batches:
            high, low = (np.asarray(b.column(k).to_numpy()).astype(np.uint32) for k in (0, 1))
            terms = np.stack([np.nan_to_num(np.asarray(b.column(2 + k).to_numpy(zero_copy_only=False), dtype=float)) for k in range(len(names))], axis=1)
            for lo in range(0, len(high), 2000):
                sums += draws(high[lo:lo + 2000], low[lo:lo + 2000], n_boot).T.astype(float) @ terms[lo:lo + 2000]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot, dtype=np.int32))] + [pa.array(sums[:, k]) for k in range(len(names))], names=["rep"] + names)

    parts = rows.mapInArrow(run, ", ".join(["rep int"] + [f"{n} double" for n in names]))
    return parts.groupBy("rep").agg(*[F.sum(n).alias(n) for n in names])


def bootstrap_ci(df: DataFrame, key: str, statistic: Statistic, n_boot: int = 1000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of a statistic of weighted sums over Poisson(1) resamples.  NULL terms count as 0."""
    stats = replicate_sums(df, key, statistic, n_boot, seed).select(statistic.value.alias("stat")).where("stat is not null")
    lo, hi = (1 - ci) / 2, (1 + ci) / 2
    return stats.agg(F.percentile("stat", lo).alias("lo"), F.percentile("stat", hi).alias("hi"), F.count(F.lit(1)).alias("replicates"))


def _normal_two_sided(z: Column) -> Column:
    """2 (1 - Phi(|z|)) by the Abramowitz-Stegun 7.1.26 polynomial (absolute error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = F.lit(1.0) / (x * 0.3275911 + 1.0)
    poly = t * (t * (t * (t * (t * 1.061405429 - 1.453152027) + 1.421413741) - 0.284496736) + 0.254829592)
    return poly * F.exp(-x * x)


def wilcoxon(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Signed-rank test: zero differences dropped, average ranks, normal approximation with tie correction.

    Equal absolute differences are merged first; ranks come from running counts over the merged values.
    """
    d = pairs.select((F.col(x) - F.col(y)).alias("d")).where("d <> 0")
    v = d.groupBy(F.abs("d").alias("v")).agg(positive(F.col("d") > 0).alias("up"), positive(F.col("d") < 0).alias("down"))
    v = v.withColumn("n", F.col("up") + F.col("down"))
    r = running(v, [], real_digits(F.col("v")), [F.col("v")], [Measure("before", F.col("n"))], inclusive=False)
    rank = F.col("before") + (F.col("n") + 1) / 2.0
    a = r.agg(F.sum("n").alias("n"), F.sum(rank * F.col("up")).alias("rp"), F.sum(rank * F.col("down")).alias("rm"), F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (n * 2 + 1) / 24.0 - F.col("ties") / 48.0)
    stat = F.least("rp", "rm")
    z = (stat - n * (n + 1) / 4.0) / sd
    few = F.coalesce(n, F.lit(0.0)) < 3
    return a.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(few, 0.0).otherwise(stat).alias("statistic"), F.when(few, 1.0).otherwise(_normal_two_sided(z)).alias("p_value"))


def paired(a: DataFrame, b: DataFrame, on: list[str], flag: str) -> DataFrame:
    """Outcomes of two detectors side by side."""
    return a.select(*on, F.col(flag).alias("a")).join(b.select(*on, F.col(flag).alias("b")), on)


def compare_detectors(det: DataFrame, main: str, others: list[str], alpha: float = 0.05, key: str | None = None) -> DataFrame:
    """Main detector against each competitor: discordance test, Holm correction, effect size, rates and agreement.

    With a ``key`` (the period) it also gives the bootstrap interval of the main rate, NULL for fewer than three rows.
    """
    long = det.select(F.col(main).alias("main"), F.inline(F.array(*[F.struct(F.lit(o).alias("name"), F.col(o).alias("flag")) for o in others])))
    test = mcnemar(long, "main", "flag", ["name"])
    share = lambda c: F.avg(c.cast("double"))
    rates = long.groupBy("name").agg(share(F.col("main")).alias("main_rate"), share(F.col("flag")).alias("other_rate"), share(F.col("main") == F.col("flag")).alias("agreement"))
    j = test.join(rates, "name").withColumn("effect_h", cohens_h(F.col("main_rate"), F.col("other_rate")))
    out = holm(j.withColumn("effect", effect_label(F.col("effect_h"))), alpha)
    if key is None:
        return out
    enough = det.agg((F.count(F.lit(1)) >= 3).alias("__enough"))
    interval = bootstrap_ci(det.withColumn("__x", F.col(main).cast("double")), key, weighted_mean("__x")).crossJoin(F.broadcast(enough))
    bounds = [F.when(F.col("__enough"), F.col(c)).alias(f"main_{c}") for c in ("lo", "hi")]
    return out.crossJoin(F.broadcast(interval.select(*bounds)))


def detector_eval(det: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """Confusion of detections against true drift, accuracy, and type accuracy over truly drifted periods.

    ``det``: (on, name, detected, drift_type); ``truth``: (on, true_type).
    """
    j = det.join(truth, on)
    real = F.col("true_type") != "none"
    g = j.groupBy("name").agg(positive(real & F.col("detected")).alias("tp"), positive(~real & F.col("detected")).alias("fp"), positive(~real & ~F.col("detected")).alias("tn"),
                              positive(real & ~F.col("detected")).alias("fn"), positive(real & (F.col("true_type") == F.col("drift_type"))).alias("__t"), positive(real).alias("__r"))
    return g.select("name", "tp", "fp", "tn", "fn", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("accuracy"),
                    ratio(F.col("__t"), F.col("__r")).alias("type_accuracy"))
