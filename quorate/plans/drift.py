"""Drift, detectors and paired statistics over the score matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.functions.rows import literal_rows
from quorate.operators import detectors as de
from quorate.operators import drift as dr
from quorate.operators import models as mo
from quorate.operators import ordering
from quorate.operators import reports as rs
from quorate.operators import scores as sc
from quorate.operators import statistics as st
from quorate.plans.bindings import DETECT, DIM, DIMS, EVAL_PERIODS, L, TRAIN_PERIODS, VEC, VECL, W, detections, scores, sql, table, vectors
from quorate.plans.registry import query
from quorate.plans.score import AUC, ENS, conf_sql, rounded

K = DIMS.size
VIEWS = list(DIMS.views)


def train(spark, d):
    return scores(spark, d).where(F.col("period").isin(TRAIN_PERIODS))


def test(spark, d):
    return scores(spark, d).where(F.col("period").isin(EVAL_PERIODS))


DD = ("dd as (select a.period, a.model_id as mi, b.model_id as mj, 0.6::double*avg(abs(a.score-b.score))+0.4::double*avg(((a.score>0.5)<>(b.score>0.5))::integer::double) as d "
      "from l a join l b on a.sample_id=b.sample_id and a.model_id<b.model_id where a.score is not null and b.score is not null group by 1,2,3)")
BASE = DD + ", b0 as (select mi, mj, avg(d) as mu0, stddev_samp(d) as s from dd where period<=4 group by 1,2), bs as (select mi, mj, mu0, case when s>1e-10 then s else (select quantile_cont(s,0.5) from b0 where s>1e-10) end as sigma0 from b0)"


@query("drf_01_baseline", sql(L, BASE, "select mi, mj, round(mu0,6) as mu0, round(sigma0,6) as sigma0 from bs"))
def baseline(spark, d):
    return rounded(dr.drift_baseline(sc.disagreement(train(spark, d), K, ["period"])), "mu0", "sigma0")


@query("drf_02_standardise", sql(L, BASE, "select period, mi, mj, round((d-mu0)/sigma0,5) as a from dd join bs using (mi,mj)"))
def standardise(spark, d):
    dis = sc.disagreement(scores(spark, d), K, ["period"])
    a = dr.standardise(dis, dr.drift_baseline(dis.where("period <= 4")))
    return a.select("period", "mi", "mj", F.round("a", 5).alias("a"))


DISP = ("nv as (select view, count(*) as nm from dim group by 1), dp as (select sample_id, any_value(period) as period, view, any_value(level) as level, case when any_value(nm)=1 then abs(max(score)-0.5) else stddev_pop(score) end as disp "
        "from l join dim using (model_id) join nv using (view) group by sample_id, view), cb as (select view, avg(disp) as mu, greatest(stddev_pop(disp),1e-4::double) as sd from dp where period<=4 group by 1)")


@query("drf_03_view_dispersion", sql(L, DIM, DISP, "select sample_id, view, round(disp,6) as disp from dp"))
def view_dispersion(spark, d):
    v = dr.view_dispersion(scores(spark, d), DIMS)
    return rounded(v.select("sample_id", F.inline(F.arrays_zip(F.array(*[F.lit(x) for x in VIEWS]).alias("view"), "disp")).alias("view", "disp")), "disp")


@query("drf_03_sample_calibration", sql(L, DIM, DISP, "select view, round(mu,6) as mu, round(sd,6) as sd from cb"))
def sample_calibration(spark, d):
    c = dr.calibrate_samples(dr.view_dispersion(train(spark, d), DIMS), DIMS)
    return rounded(c.select(F.inline(F.arrays_zip(F.array(*[F.lit(x) for x in VIEWS]), "disp_mu", "disp_sd")).alias("view", "mu", "sd")), "mu", "sd")


def sample_calib(spark, d):
    c = dr.calibrate_samples(dr.view_dispersion(train(spark, d), DIMS), DIMS)
    return c.select("*", F.array(F.lit(0.48), F.lit(0.48), F.lit(0.48)).alias("class_tau"), F.lit(1.5).alias("sample_z"))


EV = ("zz as (select sample_id, period, level, avg(coalesce(greatest((disp-mu)/sd,0),0)) as ev from dp join cb using (view) group by 1,2,3), "
      "pv as (select sample_id, any_value(period) as period, max(ev) filter (level='surface') as s, max(ev) filter (level='structure') as r, max(ev) filter (level='global') as g from zz group by 1), "
      "tp as (select *, greatest(s,r,g) as anomaly, s/(s+r+g+1e-10)>0.48 as ds, r/(s+r+g+1e-10)>0.48 as dr, g/(s+r+g+1e-10)>0.48 as dg from pv), "
      "ty as (select *, anomaly>1.5 as is_candidate, case when anomaly<1.5 then 'none' when ds and dr and dg then 'paradigm_shift' when dr then 'structural' when ds and not dg then 'perturbation' when dg then 'paradigm_shift' else 'structural' end as sample_type from tp)")


@query("drf_08_score_samples", sql(L, DIM, DISP, EV, "select sample_id, round(s,5) as ev_surface, round(r,5) as ev_structure, round(g,5) as ev_global, round(anomaly,5) as anomaly, is_candidate, sample_type from ty"))
def score_samples(spark, d):
    s = dr.score_samples(dr.view_dispersion(scores(spark, d), DIMS), sample_calib(spark, d), DIMS)
    return s.select("sample_id", *[F.round(c, 5).alias(c) for c in ("ev_surface", "ev_structure", "ev_global", "anomaly")], "is_candidate", "sample_type")


@query("agg_17_type_counts", sql(L, DIM, DISP, EV, "select period, sample_type, count(*) as n, count(*) filter (is_candidate) as candidates from ty group by 1,2"))
def type_counts(spark, d):
    s = dr.score_samples(dr.view_dispersion(scores(spark, d), DIMS), sample_calib(spark, d), DIMS)
    return s.groupBy("period", "sample_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_candidate").cast("bigint")).alias("candidates"))


@query("jon_14_with_baseline", sql(L, DIM, DISP, "select sample_id, view, round((disp-mu)/sd,5) as z from dp join cb using (view)"))
def with_baseline(spark, d):
    v = dr.with_baseline(dr.view_dispersion(scores(spark, d), DIMS), sample_calib(spark, d))
    z = F.transform(F.arrays_zip("disp", "disp_mu", "disp_sd"), lambda x: (x["disp"] - x["disp_mu"]) / x["disp_sd"])
    return v.select("sample_id", F.inline(F.arrays_zip(F.array(*[F.lit(x) for x in VIEWS]), z)).alias("view", "z")).withColumn("z", F.round("z", 5))


@query("drf_04_calibrate", None)
def calibrate(spark, d):
    return rs.frozen_calibration(rs.period_disagreement(train(spark, d), DIMS), DIMS)[1]


def reports(spark, d):
    dis = rs.period_disagreement(scores(spark, d), DIMS)
    base, calib = rs.frozen_calibration(dis.where("period <= 4"), DIMS)
    return rs.detect_periods(dis, base, calib, DIMS)


@query("drf_05_detect", None)
def detect(spark, d):
    return reports(spark, d).select("period", "drift_detected", "r", "spectral_gap", "confidence", "view_loadings", "level_z", "affected_views", "mechanism_views", "healthy_models", "drift_type", "strategy", "label_budget")


@query("drf_06_novelty", None)
def novelty(spark, d):
    """Novelty over daily reports, so that a history of drifts exists."""
    ev = table(spark, d, "events").select(F.col("event_id").alias("sample_id"), F.dayofmonth("ts").alias("day"))
    s = scores(spark, d).join(ev, "sample_id").drop("period").withColumnRenamed("day", "period")
    dis = rs.period_disagreement(s, DIMS)
    base, calib = rs.frozen_calibration(dis.where("period <= 10"), DIMS)
    return rs.detect_periods(dis, base, calib, DIMS).select("period", "drift_detected", "novelty", "drift_type")


TREE = ("with q as (select event_id, value>3 as det, (event_id%10)/10.0::double as s, (event_id%7)/7.0::double as r, (event_id%4)/4.0::double as g, (event_id%3)/3.0::double as nv, value as l1, (event_id%9)/9.0::double as hs from events), "
        "t as (select *, case when not det then 'none' when s>0.5 and r>0.5 and g>0.5 then case when nv>0.4 then 'paradigm_shift' else 'structural' end when r>0.5 then 'structural' when g>0.5 then case when nv>0.4 then 'paradigm_shift' else 'structural' end "
        "when s>0.5 then 'perturbation' when l1>2*4.0::double then 'structural' else 'perturbation' end as drift_type from q), "
        "z as (select *, case drift_type when 'perturbation' then 'auto_adapt' when 'structural' then 'selective_retrain' when 'paradigm_shift' then 'full_retrain' else 'none' end as strategy, "
        "(case drift_type when 'perturbation' then 16 when 'structural' then ceil(200/greatest(hs,0.01::double)) when 'paradigm_shift' then ceil(500/greatest(hs,0.01::double)) else 0 end)::integer as label_budget from t)")


def tree(spark, d):
    e = F.col("event_id")
    ev = table(spark, d, "events").select("event_id", (F.col("value") > 3).alias("det"), *[(e % m / F.lit(float(m))).alias(n) for n, m in (("s", 10), ("r", 7), ("g", 4), ("nv", 3), ("hs", 9))], F.col("value").alias("l1"))
    half = [F.lit(0.5)] * 3
    kind = dr.drift_type(F.col("det"), [F.col("s"), F.col("r"), F.col("g")], half, F.col("nv"), F.lit(0.4), F.col("l1"), F.lit(4.0))
    return dr.with_strategy(ev.withColumn("drift_type", kind), F.col("hs"), K)


@query("drf_07_classify", TREE + " select event_id, drift_type, strategy, label_budget from z")
def classify(spark, d):
    return tree(spark, d).select("event_id", "drift_type", "strategy", "label_budget")


@query("drf_20_severity", TREE + " select event_id, case when drift_type='paradigm_shift' or (event_id%6>=4 and hs<0.3) then 'CRITICAL' when drift_type='structural' or event_id%6>=2 then 'HIGH' when drift_type='perturbation' then 'MEDIUM' else 'LOW' end as severity from z")
def severity(spark, d):
    return tree(spark, d).select("event_id", dr.severity(F.col("drift_type"), F.col("event_id") % 6, F.col("hs")).alias("severity"))


@query("drf_20_report_text", None)
def report_text(spark, d):
    return dr.report_text(reports(spark, d), K)


@query("jon_18_attribute", None)
def attribute(spark, d):
    return dr.attribute(reports(spark, d), DIMS)


@query("jon_18_technique_join", "with v as (select event_id as period, (['V_byte','V_string','V_struct','V_import','V_all'])[i] as view, (event_id%(i+3))::double/10 as x from events, range(1,6) t(i)), m as (select period, max(x) as m from v group by 1), "
       "t as (select * from (values " + ", ".join(f"('{v}','{a}','{b}')" for v, (a, b) in dr.TECHNIQUE.items()) + ") t(view, technique_id, technique)) "
       "select period, view, technique_id, technique, round(case when m>0 then least(1,x/m) else 0.5 end,6)::double as confidence from v join m using (period) join t using (view) where x>0.1")
def technique_join(spark, d):
    load = F.array(*[(F.col("event_id") % (i + 3)).cast("double") / 10 for i in range(1, 6)])
    names = F.array(*[F.lit(v) for v in VIEWS])
    ev = table(spark, d, "events").select(F.col("event_id").alias("period"), load.alias("view_loadings"), names.alias("__n"))
    hot = F.filter(F.arrays_zip("__n", "view_loadings"), lambda x: x["view_loadings"] > 0.1)
    ev = ev.withColumn("affected_views", F.transform(hot, lambda x: x["__n"]))
    return rounded(dr.attribute(ev, DIMS).drop("remediation"), "confidence")


HEALTHY = {5: [0, 1, 2, 3, 7], 6: [0, 1, 3]}
CONF = ("hm as (select 5 as p, unnest([0,1,2,3,7]) as model_id union all select 6, unnest([0,1,3])), "
        "te as (select sample_id, any_value(y) as y, any_value(period) as p, avg(score) as e from l join hm on hm.model_id=l.model_id and hm.p=l.period group by 1), "
        "ca as (select hm.p, sample_id, any_value(y) as y, avg(score) as e from l join hm on hm.model_id=l.model_id where period<=4 group by 1, 2), "
        "sa as (select p, avg(e) as cm, greatest(stddev_pop(e),1e-8::double) as cs, count(*) as n from ca group by 1), sb as (select p, avg(e) as tm, greatest(stddev_pop(e),1e-8::double) as ts from te group by 1), "
        "lw as (select p, abs(e-y) as nc, n, 0.5::double*power((e-cm)/cs,2)-0.5::double*power((e-tm)/ts,2) as lw from ca join sa using (p) join sb using (p)), "
        "wt as (select p, nc, n, least(greatest(exp(lw-max(lw) over (partition by p)),0.01::double),100::double) as w from lw), "
        "cu as (select p, nc, n, sum(w) over (partition by p order by nc range unbounded preceding) as cw, sum(w) over (partition by p) as tw, max(w) over (partition by p)/greatest(min(w) over (partition by p),1e-8::double) as b, max(nc) over (partition by p) as last from wt), "
        "qq as (select p, any_value(n) as n_cal, coalesce(min(case when cw/tw >= least(0.9::double*(1+1.0::double/n),1)-1e-12::double then nc end), any_value(last)) as quantile, greatest(0,0.9::double-any_value(b)/(any_value(n)+1)) as bound from cu group by 1), "
        "sz as (select p, n_cal, quantile, bound, y, abs(e)<=quantile as i0, abs(e-1)<=quantile as i1, round_even(e,0)::integer as own from te join qq using (p)), "
        "s2 as (select *, i0 or (not i0 and not i1 and own=0) as h0, i1 or (not i0 and not i1 and own=1) as h1 from sz)")


def healthy(spark):
    h = literal_rows(spark, [(p,) for p in HEALTHY], "period int")
    pick = F.when(F.col("period") == 5, F.array(*[F.lit(m) for m in HEALTHY[5]])).otherwise(F.array(*[F.lit(m) for m in HEALTHY[6]]))
    return h.withColumn("healthy_models", pick)


@query("drf_09_conformal", sql(L, CONF, "select p as period, any_value(n_cal) as n_cal, round(any_value(quantile),6) as quantile, round(any_value(bound),6)::double as bound, round(avg(h0::integer+h1::integer),6) as mean_set_size, round(avg((case when y=1 then h1 else h0 end)::integer),6) as coverage from s2 group by 1"))
def conformal(spark, d):
    return rounded(dr.conformal(train(spark, d), test(spark, d), healthy(spark), K), "quantile", "bound", "mean_set_size", "coverage")


@query("win_12_weighted_quantile", sql(L, CONF, "select p as period, round(quantile,6) as quantile from qq"))
def weighted_quantile(spark, d):
    return rounded(dr.conformal(train(spark, d), test(spark, d), healthy(spark), K).select("period", "quantile"), "quantile")


_IMP = {v: i for i, v in enumerate(VIEWS)}


@query("drf_10_reweight", "with v as (select event_id, event_id%7<>0 as det, m.model_id, greatest((event_id%(m.vi+2))::double/10-0.1::double*(event_id%2),0) as imp from events, (values " + ", ".join(f"({i},{_IMP[v]})" for i, v in enumerate(DIMS.views_of)) + ") m(model_id,vi)), "
       "a as (select *, max(imp) over (partition by event_id) as mx from v), r as (select *, imp/greatest(mx,1e-300::double) as rel from a), c as (select event_id, stddev_pop(rel)/greatest(avg(rel),1e-8::double) as cv, count(*) as n from r where rel>0.01 group by 1), "
       "w as (select r.*, not det or mx<1e-6 or (coalesce(n,0)>1 and cv<0.25) as eq, greatest(1-sqrt(rel)*0.4::double,0.0625::double) as raw from r left join c using (event_id)) "
       "select event_id, model_id, round(case when eq then 0.125::double else raw/sum(raw) over (partition by event_id) end,6) as weight from w")
def reweight(spark, d):
    e = F.col("event_id")
    deltas = F.array(*[(e % (i + 2)).cast("double") / 10 - (e % 2) * F.lit(0.1) for i in range(len(VIEWS))])
    ev = dr.reweight(table(spark, d, "events").select("event_id"), e % 7 != 0, deltas, DIMS)
    return rounded(ev.select("event_id", F.posexplode("weights").alias("model_id", "weight")), "weight")


PSEUDO = ("v as (select sample_id, any_value(period) as period, any_value(y) as y, avg((score>=0.5)::integer) as p from l where model_id in (0,1,2,3,7) and score is not null group by 1), "
          "pl as (select *, round_even(p,0)::integer as pseudo, greatest(p,1-p) as agreement from v)")


@query("drf_11_pseudo_labels", sql(L, PSEUDO, "select sample_id, pseudo, round(agreement,6) as agreement from pl where agreement>=0.75"))
def pseudo_labels(spark, d):
    return rounded(dr.pseudo_labels(scores(spark, d), [0, 1, 2, 3, 7], K, 0.75).select("sample_id", "pseudo", "agreement"), "agreement")


@query("drf_11_pseudo_quality", sql(L, PSEUDO, "select period, count(*) as n, count(*) filter (agreement>=0.75) as kept, round(count(*) filter (agreement>=0.75)::double/count(*),6) as rate, round(avg((pseudo=y)::integer) filter (agreement>=0.75),6) as accuracy from pl group by 1"))
def pseudo_quality(spark, d):
    return rounded(dr.pseudo_quality(scores(spark, d), [0, 1, 2, 3, 7], K, 0.75), "rate", "accuracy")


@query("drf_11_pseudo_by_period", sql(L, CONF.split("te as")[0].rstrip(", "), "vo as (select sample_id, any_value(l.period) as period, any_value(y) as y, avg((score>=0.5)::integer) as v from l left join hm on hm.p=l.period and hm.model_id=l.model_id where l.period in (5,6) and hm.p is not null and score is not null group by 1), "
       "pv as (select period, y, greatest(v,1-v)>=0.75 as k, round_even(v,0)::integer=y as ok from vo)", "select period, count(*) as n, count(*) filter (k) as kept, round(count(*) filter (k)::double/count(*),6) as rate, round(avg(ok::integer) filter (k),6) as accuracy from pv group by 1"))
def pseudo_by_period(spark, d):
    return rounded(dr.pseudo_by_period(test(spark, d), healthy(spark), K, 0.75), "rate", "accuracy")


@query("drf_21_ablation_period", "with g as (select extract(day from ts)::integer as period, avg(value) as gap, count(*) as n, sum(event_id)%3<>0 as dr from events group by 1), b as (select period, gap, true as drifted from g where dr and n>=50 order by gap desc, period limit 1), "
       "e as (select period, gap, false as drifted from g where not exists (select 1 from b) order by period desc limit 1) select period, round(gap,6) as spectral_gap, drifted from b union all select period, round(gap,6), drifted from e")
def ablation_period(spark, d):
    g = table(spark, d, "events").groupBy(F.dayofmonth("ts").alias("period")).agg(F.avg("value").alias("spectral_gap"), F.count(F.lit(1)).alias("n"), (F.sum("event_id") % 3 != 0).alias("drift_detected"))
    return rounded(rs.ablation_period(g, g), "spectral_gap")


# ---- detectors -----------------------------------------------------------------------------------------------------

NCM = "nc as (select sample_id, any_value(period) as period, 1-greatest(avg(score),1-avg(score))+stddev_pop(score) as v, greatest(avg(score),1-avg(score)) as conf, avg(score) as e from l group by 1)"


def ks_sql(col: str) -> str:
    return (f"su as (select {col} as v from nc where period<=4), uu as (select p.period, su.v, 0 as side from su, (values (5),(6)) p(period) union all select period, {col}, 1 from nc where period>=5), "
            "cc as (select period, sum(1-side) over (partition by period order by v range unbounded preceding)::double as ca, sum(side) over (partition by period order by v range unbounded preceding)::double as cb, sum(1-side) over (partition by period) as na, sum(side) over (partition by period) as nb from uu), "
            "ks as (select period, max(abs(ca/na-cb/nb)) as ks, any_value(na) as na, any_value(nb) as nb from cc group by 1), kt as (select *, ks*sqrt(na::double*nb/(na+nb)) as t from ks), "
            "kp as (select period, any_value(ks) as ks, any_value(na) as na, any_value(nb) as nb, case when any_value(t)<0.2 then 1 else least(greatest(sum(case when k%2=1 then 2.0::double else -2.0::double end*exp(-2.0::double*k*k*t*t)),0),1) end as p, greatest(0.04::double,3/sqrt(least(any_value(na),any_value(nb))::double)) as lim from kt, range(1,101) r(k) group by 1)")


@query("drf_12_uncertainty", sql(L, NCM, ks_sql("v"), "mm as (select avg(v) as m, greatest(stddev_pop(v),1e-6::double) as s from nc where period<=4), tt as (select period, avg(v) as v from nc where period>=5 group by 1)",
       "select period, (p<0.05 and ks>lim) or abs(v-m)/s>2.5 as detected, round(ks,6) as ks, round(abs(v-m)/s,5) as shift from tt join kp using (period), mm"))
def uncertainty(spark, d):
    u = de.uncertainty(train(spark, d), test(spark, d), K)
    return u.select("period", "detected", F.round("ks", 6).alias("ks"), F.round("shift", 5).alias("shift"))


@query("drf_13_reconstruction", None)
def reconstruction(spark, d):
    return rounded(de.reconstruction(train(spark, d), test(spark, d), K), "outlier_ratio", "shift")


def mask_sql(seed: int) -> str:
    rows = ", ".join(f"({i},{k},{w!r}::double)" for i, r in enumerate(de.mask_weights(K, seed)) for k, w in enumerate(r))
    return f"select * from (values {rows}) t(i,model_id,w)"


MASK = ("mk as (" + mask_sql(42) + "), mt as (" + mask_sql(123) + "), e0 as (select sample_id, i, sum(w*coalesce(score,0.5)) as m from l join mk using (model_id) where period<=4 group by 1,2), va as (select sample_id, var_pop(m) as v from e0 group by 1), "
        "e1 as (select sample_id, period, i, sum(w*coalesce(score,0.5)) as m from l join mt using (model_id) where period>=5 group by 1,2,3), vt as (select sample_id, period, var_pop(m) as v from e1 group by 1,2), "
        "mm as (select avg(v) as cm, greatest(stddev_pop(v),1e-8::double) as cs, quantile_cont(v,0.9) as p90 from va)")


@query("drf_14_mask_variance", sql(L, MASK, "r as (select period, avg((v>p90)::integer) as x, (avg(v)-any_value(cm))/any_value(cs) as s from vt, mm group by 1)", "select period, x>0.15 or s>2 as detected, round(x,6) as exceed_ratio, round(s,5) as shift from r"))
def mask_variance(spark, d):
    m = de.mask_variance(train(spark, d), test(spark, d), K)
    return m.select("period", "detected", F.round("exceed_ratio", 6).alias("exceed_ratio"), F.round("shift", 5).alias("shift"))


ENT = "(-q*log2(q)-(1-q)*log2(1-q))"
PROF = ("pf as (select period, e, greatest(least(e,1-1e-8::double),1e-8::double) as q from nc), c0 as (select avg(" + ENT + ") as ce, avg((e>=0.5)::integer) as cr, avg(greatest(e,1-e)) as cc from pf where period<=4), "
        "t0 as (select period, avg(" + ENT + ") as te, avg((e>=0.5)::integer) as tr, avg(greatest(e,1-e)) as tc from pf where period>=5 group by 1), "
        "x0 as (select period, (te-ce)/greatest(ce,1e-6::double) as es, abs(tr-cr) as rs, (cc-tc)/greatest(cc,1e-6::double) as cd from t0, c0), x1 as (select *, sum(greatest(es,0)*0.3::double+rs*0.5::double) over (order by period) as acc from x0)")


@query("drf_15_entropy_ratio", sql(L, NCM, PROF, "select period, es>0.15 or rs>0.08 or cd>0.05 or acc>0.5 as detected, round(es,6) as ent_shift, round(rs,6) as ratio_shift, round(cd,6) as conf_drop, round(acc,6) as accumulated from x1"))
def entropy_ratio(spark, d):
    return rounded(de.entropy_ratio(train(spark, d), test(spark, d), K), "ent_shift", "ratio_shift", "conf_drop", "accumulated")


@query("win_11_accumulated_shift", "with g as (select event_type, cast(ts as date)::varchar as day, avg(value)/10-1 as es, abs(avg(value)/10-1)/2 as rs from events group by 1,2) select event_type, day, round(sum(greatest(es,0)*0.3::double+rs*0.5::double) over (partition by event_type order by day),6) as acc from g")
def accumulated_shift(spark, d):
    g = table(spark, d, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.avg("value").alias("m"))
    return rounded(g.select("event_type", "day", de.accumulated(F.col("m") / 10 - 1, F.abs(F.col("m") / 10 - 1) / 2, ["event_type"], "day").alias("acc")), "acc")


CENT = ("lf as (select sample_id, period, y, model_id, coalesce(score,0.5) as x from l), ce as (select y as cls, model_id, avg(x) as mu, greatest(stddev_pop(x),1e-6::double) as sd from lf where period<=4 group by 1,2), "
        "zc as (select sample_id, any_value(period) as period, any_value(y) as y, cls, avg(abs(x-mu)/sd) as z from lf join ce using (model_id) group by sample_id, cls), ca as (select z from zc where period<=4 and y=cls), "
        "mm as (select avg(z) as cm, greatest(stddev_pop(z),0.1::double) as cs, quantile_cont(z,0.9) as p90 from ca), rl as (select avg((z<p90)::integer) as cr from ca, mm), ne as (select sample_id, any_value(period) as period, min(z) as z from zc where period>=5 group by 1), "
        "r as (select period, (avg(z)-any_value(cm))/any_value(cs) as zs, avg((z<p90)::integer) as re, any_value(cr) as cr from ne, mm, rl group by 1)")


@query("drf_16_centroid", sql(L, CENT, "select period, zs>2 or re<cr*0.85 as detected, round(zs,6) as z_shift, round(re,6) as reliability from r"))
def centroid(spark, d):
    return rounded(de.centroid(train(spark, d), test(spark, d), K), "z_shift", "reliability")


@query("drf_17_confidence", sql(L, NCM, ks_sql("conf"), "pf as (select period, conf, greatest(least(e,1-1e-8::double),1e-8::double) as q from nc), c0 as (select avg(conf) as cm, greatest(stddev_pop(conf),1e-6::double) as cs, avg(" + ENT + ") as em, greatest(stddev_pop(" + ENT + "),1e-6::double) as es from pf where period<=4), "
       "t0 as (select period, avg(conf) as c, avg(" + ENT + ") as t from pf where period>=5 group by 1)", "select period, (cm-c)/cs>1.5 or (t-em)/es>1.5 or (p<0.05 and ks>lim) as detected, round((cm-c)/cs,6) as conf_shift, round((t-em)/es,6) as ent_shift, round(ks,6) as ks from t0 join kp using (period), c0"))
def confidence(spark, d):
    return rounded(de.confidence_shift(train(spark, d), test(spark, d), K), "conf_shift", "ent_shift", "ks")


@query("drf_18_disagreement", sql(L, "c as (select sample_id, period, count(*) filter (score>0.5) as c, count(score) as k from l group by 1,2), r as (select period, avg(2.0::double*c*(k-c)/(k*k)) as rate from c group by 1), b as (select avg(rate) as m, greatest(stddev_pop(rate),1e-6::double) as s from r where period<=4)",
       "select period, rate>m+2.5*s as detected, round(rate,6) as rate, round(m+2.5*s,6) as threshold, round((rate-m)/s,3) as shift from r, b where period>=5"))
def disagreement(spark, d):
    g = de.disagreement(train(spark, d), test(spark, d), K)
    return g.select("period", "detected", F.round("rate", 6).alias("rate"), F.round("threshold", 6).alias("threshold"), F.round("shift", 3).alias("shift"))


@query("drf_19_period_report", None)
def period_report(spark, d):
    return rs.period_report(scores(spark, d), DIMS, TRAIN_PERIODS, EVAL_PERIODS)


@query("drf_19_adaptive_report", None)
def adaptive_report(spark, d):
    return rs.adaptive_report(scores(spark, d), DIMS, TRAIN_PERIODS, EVAL_PERIODS, 7).select("period", "drift_detected", "r", "spectral_gap", "drift_type", "novelty", "strategy")


@query("drf_21_ablate_weights", None)
def ablate_weights(spark, d):
    return rs.ablate_weights(scores(spark, d), DIMS, TRAIN_PERIODS, EVAL_PERIODS, [(1.0, 0.0), (0.8, 0.2), (0.6, 0.4), (0.4, 0.6), (0.2, 0.8), (0.0, 1.0)])


@query("drf_21_ablate_views", None)
def ablate_views(spark, d):
    return rs.ablate_views(scores(spark, d), DIMS, TRAIN_PERIODS, EVAL_PERIODS, {"full": VIEWS, "minus one": VIEWS[:-1], "minus two": VIEWS[:-2]})


@query("drf_21_ablate_batch", None)
def ablate_batch(spark, d):
    return rs.ablate_batch(scores(spark, d), DIMS, TRAIN_PERIODS, EVAL_PERIODS, [100, 500, 1000], 5)


@query("drf_22_separability", "with m as (select distinct lang, source from documents), z as (select lang, count(*) as n from m group by 1) select a.lang as a, b.lang as b, round(count(*)::double/(any_value(x.n)+any_value(y.n)-count(*)),6) as jaccard from m a join m b on a.source=b.source and a.lang<b.lang join z x on x.lang=a.lang join z y on y.lang=b.lang group by 1,2")
def separability(spark, d):
    return rounded(dr.separability_table(table(spark, d, "documents"), "lang", "source"), "jaccard")


# ---- sequences -----------------------------------------------------------------------------------------------------


@query("win_10_cusum", "with recursive g as (select event_type as level, cast(ts as date)::varchar as period, (day(ts)//10)::integer as epoch, (avg(value)-10)*3 as z from events group by 1,2,3), r as (select *, row_number() over (partition by level, epoch order by period) as rn from g), "
       "c as (select level, epoch, rn, period, greatest(0,greatest(z,0)-0.7::double) as s from r where rn=1 union all select r.level, r.epoch, r.rn, r.period, greatest(0,c.s+greatest(r.z,0)-0.7::double) from c join r on r.level=c.level and r.epoch=c.epoch and r.rn=c.rn+1) "
       "select level, period, epoch, round(s,6)::double as cusum from c")
def cusum(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("level"), F.to_date("ts").cast("string").alias("period"), F.floor(F.dayofmonth("ts") / 10).cast("int").alias("epoch")).agg(((F.avg("value") - 10) * 3).alias("z"))
    return dr.cusum(g, 0.7, ["level"]).select("level", "period", "epoch", (F.round("cusum", 6) + 0).alias("cusum"))


@query("win_14_rolling_baseline", sql(L, DD, "select period, mi, mj, round(avg(d) over w,6) as mu, round(stddev_samp(d) over w,6) as sigma from dd window w as (partition by mi, mj order by period rows between 2 preceding and current row)"))
def rolling_baseline(spark, d):
    return rounded(dr.rolling_baseline(sc.disagreement(scores(spark, d), K, ["period"]), 3).select("period", "mi", "mj", "mu", "sigma"), "mu", "sigma")


@query("win_15_ema_baseline", "with recursive " + L + ", " + DD + ", c as (select mi, mj, period, d as mu, 0.0::double as var from dd where period=1 union all select dd.mi, dd.mj, dd.period, 0.9::double*mu+0.1::double*d, 0.9::double*var+0.1::double*power(d-mu,2) from c join dd on dd.mi=c.mi and dd.mj=c.mj and dd.period=c.period+1) "
       "select mi, mj, round(mu,6) as mu, round(sqrt(var),6) as sigma from c where period=6")
def ema_baseline(spark, d):
    return rounded(dr.ema_baseline(sc.disagreement(scores(spark, d), K, ["period"])), "mu", "sigma")


# ---- calibration, shifts, statistics ---------------------------------------------------------------------------------


@query("agg_15_calibrate_stats", sql(L, "select model_id, round(avg(score),6) as mean, round(stddev_pop(score),6) as sd, round(quantile_cont(score,0.9),6) as p90, round(quantile_cont(score,0.975),6) as p975 from l where score is not null and period<=4 group by 1"))
def calibrate_stats(spark, d):
    long = sc.to_long(train(spark, d), ["period"]).where("score is not null")
    m = long.groupBy("model_id").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    return rounded(m.join(ordering.percentiles(long, ["model_id"], "score", {"p90": 0.9, "p975": 0.975}), "model_id"), "mean", "sd", "p90", "p975")


SHIFT = (VECL + ", b as (select dim, avg(x) as mu, greatest(stddev_pop(x),1e-8::double) as sd from vl where period<=4 group by 1), e as (select period, dim, avg(x+0.1::double*(period-5)*(dim%3)) as m from vl where period>=5 group by 1,2), s as (select period, dim, abs(m-mu)/sd as sh from e join b using (dim)), "
         "g as (select period, avg(sh) filter (dim<16) as s, avg(sh) filter (dim>=16) as r, avg(sh) as g from s group by 1)")


@query("agg_16_group_shift", sql(SHIFT, "select period, round(s,6) as surface_shift, round(r,6) as structure_shift, round(g,6) as global_shift, case when not (s>0.5 or r>0.5 or g>0.5) then 'none' when s>0.5 and r>0.5 and g>0.5 then 'paradigm_shift' when r>0.5 then 'structural' when s>0.5 then 'perturbation' else 'structural' end as drift_type from g"))
def group_shift(spark, d):
    v = vectors(spark, d)
    ev = v.where("period >= 5").withColumn("vec", F.transform("vec", lambda x, i: x + F.lit(0.1) * (F.col("period") - 5) * (i % 3)))
    return rounded(dr.group_shift(v.where("period <= 4"), ev, {"surface": (0, 16), "structure": (16, 64)}), "surface_shift", "structure_shift", "global_shift")


TRUTH = ("tr as (select period, case when m>10 then case when hi>62 then 'structural' else 'perturbation' end else 'none' end as true_type from dt), dn as (select period, 'main' as name, main as f from dt union all select period, 'd1', d1 from dt union all select period, 'd2', d2 from dt union all select period, 'd3', d3 from dt)")


def truth(spark, d):
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("m"), F.max("value").alias("hi"))
    return days.select(F.col("day").cast("string").alias("period"), F.when(F.col("m") > 10, F.when(F.col("hi") > 62, "structural").otherwise("perturbation")).otherwise("none").alias("true_type"))


@query("agg_18_detector_eval", sql(DETECT, "dt2 as (select period, m, hi, main, d1, d2, d3 from dt join det using (period, m))", TRUTH.replace("from dt)", "from dt2)", 1), "j as (select name, f, true_type, 'structural' as ty from dn join tr using (period))",
       "select name, count(*) filter (true_type<>'none' and f) as tp, count(*) filter (true_type='none' and f) as fp, count(*) filter (true_type='none' and not f) as tn, count(*) filter (true_type<>'none' and not f) as fn, "
       "round(count(*) filter ((true_type<>'none')=f)::double/count(*),6) as accuracy, round(coalesce(count(*) filter (true_type='structural')::double/nullif(count(*) filter (true_type<>'none'),0),0),6) as type_accuracy from j group by 1"))
def detector_eval(spark, d):
    det = detections(spark, d).select("period", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("detected")) for n in ("main", "d1", "d2", "d3")]))).withColumn("drift_type", F.lit("structural"))
    return rounded(st.detector_eval(det, truth(spark, d), ["period"]), "accuracy", "type_accuracy")


@query("jon_12_nearest_centroid", sql(VECL, "c as (select y as cls, dim, avg(x) as mu, greatest(stddev_pop(x),1e-6::double) as sd from vl where period<=4 group by 1,2), z as (select sample_id, cls, avg(abs(x-mu)/sd) as z from vl join c using (dim) where period>=5 group by 1,2)",
       "select sample_id, arg_min(cls,z) as nearest, round(min(z),6) as distance from z group by 1"))
def nearest_centroid(spark, d):
    v = vectors(spark, d)
    return rounded(mo.nearest_centroid(v.where("period >= 5"), mo.class_centroids(v.where("period <= 4"), "y"), "sample_id"), "distance")


@query("jon_15_paired", sql(DETECT, "select period, main as a, d1 as b from dt"))
def paired(spark, d):
    det = detections(spark, d)
    return st.paired(det.withColumnRenamed("main", "flag"), det.drop("main").withColumnRenamed("d1", "flag"), ["period"], "flag")


@query("sta_01_ks_2samp", "with u as (select event_type, value as v, (event_id%3=0)::integer as side from events), c as (select event_type, sum(1-side) over (partition by event_type order by v range unbounded preceding)::double as ca, sum(side) over (partition by event_type order by v range unbounded preceding)::double as cb, "
       "sum(1-side) over (partition by event_type) as na, sum(side) over (partition by event_type) as nb from u), k as (select event_type, max(abs(ca/na-cb/nb)) as ks, any_value(na) as na, any_value(nb) as nb from c group by 1)"
       ", kt as (select *, ks*sqrt(na::double*nb/(na+nb)) as t from k) "
       "select event_type, round(any_value(ks),6) as ks, any_value(na)::bigint as n_a, any_value(nb)::bigint as n_b, "
       "round(case when any_value(t)<0.2 then 1 else least(greatest(sum(case when i%2=1 then 2.0::double else -2.0::double end*exp(-2.0::double*i*i*t*t)),0),1) end,6)::double as p_value from kt, range(1,101) r(i) group by 1")
def ks_2samp(spark, d):
    ev = table(spark, d, "events")
    k = st.ks_2samp(ev.where("event_id % 3 <> 0"), ev.where("event_id % 3 = 0"), "value", ["event_type"])
    return rounded(k.select("event_type", "ks", "n_a", "n_b", "p_value"), "ks", "p_value")


MCN = ("mc as (select 'd1' as name, count(*) filter (main and not d1) as a_only, count(*) filter (not main and d1) as b_only, avg(main::integer) as mr, avg(d1::integer) as r, avg((main=d1)::integer) as ag from dt union all "
       "select 'd2', count(*) filter (main and not d2), count(*) filter (not main and d2), avg(main::integer), avg(d2::integer), avg((main=d2)::integer) from dt union all select 'd3', count(*) filter (main and not d3), count(*) filter (not main and d3), avg(main::integer), avg(d3::integer), avg((main=d3)::integer) from dt), "
       "pp as (select *, a_only+b_only as n, case when a_only+b_only=0 then 0 else power(abs(a_only-b_only)-1,2)/(a_only+b_only) end as stat, case when a_only+b_only=0 then 1 else least(1, 2*(select sum(factorial(a_only+b_only)::double/(factorial(i)::double*factorial((a_only+b_only-i)::integer)::double)/power(2::double,a_only+b_only)) from range(0,33) t(i) where i<=least(a_only,b_only))) end as p from mc)")


@query("sta_02_mcnemar", sql(DETECT, MCN.replace("factorial(i)", "factorial(i::integer)").replace("factorial(a_only+b_only)", "factorial((a_only+b_only)::integer)"), "select name, a_only, b_only, round(stat,6)::double as statistic, round(p,6)::double as p_value from pp"))
def mcnemar(spark, d):
    det = detections(spark, d)
    long = det.select("main", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("flag")) for n in ("d1", "d2", "d3")])))
    return rounded(st.mcnemar(long, "main", "flag", ["name"]), "statistic", "p_value")


@query("sta_03_cohens_d", "with g as (select event_type, event_id%2 as side, value from events), a as (select event_type, count(*) filter (side=0) as n0, count(*) filter (side=1) as n1, avg(value) filter (side=0) as m0, avg(value) filter (side=1) as m1, var_samp(value) filter (side=0) as v0, var_samp(value) filter (side=1) as v1 from g group by 1), "
       "x as (select event_type, (m0-m1)/greatest(sqrt(((n0-1)*v0+(n1-1)*v1)/(n0+n1-2)),1e-8::double) as d from a) select event_type, round(d,6) as d, case when abs(d)<0.2 then 'negligible' when abs(d)<0.5 then 'small' when abs(d)<0.8 then 'medium' else 'large' end as effect from x")
def cohens_d(spark, d):
    return rounded(st.cohens_d(table(spark, d, "events").withColumn("side", F.col("event_id") % 2), "value", "side", ["event_type"]), "d")


@query("sta_03_cohens_h", sql(DETECT, "r as (select avg(main::integer) as p1, avg(d1::integer) as p2 from dt)", "select round(2*asin(sqrt(p1))-2*asin(sqrt(p2)),6) as h from r"))
def cohens_h(spark, d):
    r = detections(spark, d).agg(F.avg(F.col("main").cast("double")).alias("p1"), F.avg(F.col("d1").cast("double")).alias("p2"))
    return r.select(F.round(st.cohens_h(F.col("p1"), F.col("p2")), 6).alias("h"))


def boot_sql(rows: str, key: str, statistic: str, n: int, names: tuple[str, str] = ("lo", "hi")) -> str:
    """The bootstrap in SQL: the same counters draw the same weights."""
    weight = " + ".join(f"(u>{c!r}::double)::integer" for c in st.poisson_steps())
    word = lambda at: f"('0x'||substr(md5({key}||':42'),{at},8))::bigint"
    mix = lambda name, source, x: (f"{name}a as (select * exclude (x), xor({x}, {x}>>16) as x from {source}), {name}b as (select * exclude (x), ((x::hugeint*{st.MIX_1})%4294967296)::bigint as x from {name}a), "  # noqa: E731
                                   f"{name}c as (select * exclude (x), ((xor(x, x>>15)::hugeint*{st.MIX_2})%4294967296)::bigint as x from {name}b), {name} as (select * exclude (x), xor(x, x>>15) as x from {name}c)")
    return (f"b0 as (select *, ({word(1)}+rep::bigint*{st.STRIDE})%4294967296 as x, {word(9)} as low from {rows}, range({n}) t(rep)), {mix('b1', 'b0', 'x')}, "
            f"b2 as (select * exclude (x), xor(x, low) as x from b1), {mix('b3', 'b2', 'x')}, bu as (select *, (x+0.5::double)/4294967296 as u from b3), bw as (select *, {weight} as w from bu), "
            f"bs as (select rep, {statistic} as stat from bw where w>0 group by rep) select round(quantile_cont(stat,0.025),6) as {names[0]}, round(quantile_cont(stat,0.975),6) as {names[1]}, count(*) as replicates from bs")


@query("sta_04_bootstrap_ci", "with " + DETECT + ", " + boot_sql("dt", "period", "sum(w*main::integer)::double/sum(w)", 1000))
def bootstrap_ci(spark, d):
    return rounded(st.bootstrap_ci(detections(spark, d).withColumn("x", F.col("main").cast("double")), "period", st.weighted_mean("x")), "lo", "hi")


@query("sta_04_bootstrap_events", "with e as (select event_id, value from events), " + boot_sql("e", "event_id", "sum(w*value)/sum(w)", 20))
def bootstrap_events(spark, d):
    """Interval of the mean event value: every row of the table is drawn in every replicate."""
    return rounded(st.bootstrap_ci(table(spark, d, "events"), "event_id", st.weighted_mean("value"), n_boot=20), "lo", "hi")


@query("sta_05_wilcoxon", "with p as (select e.value-f.value as d from events e join events f on f.event_id=e.event_id+1 where e.event_id%2=0), q as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d))-1)/2.0::double as r from p where d<>0), "
       "t as (select sum(c*c*c-c)::double as ties from (select count(*)::double as c from p where d<>0 group by abs(d))), s as (select count(*) as n, sum(case when d>0 then r else 0 end) as rp, sum(case when d<0 then r else 0 end) as rm from q), "
       "z as (select n, least(rp,rm) as stat, abs((least(rp,rm)-n*(n+1)/4.0::double)/sqrt(n*(n+1.0::double)*(2*n+1)/24-ties/48))/sqrt(2.0::double) as x from s, t), a as (select *, 1/(1+0.3275911::double*x) as k from z) "
       "select n, round(stat,3)::double as statistic, round((((((1.061405429::double*k-1.453152027::double)*k+1.421413741::double)*k-0.284496736::double)*k+0.254829592::double)*k)*exp(-x*x),6)::double as p_value from a")
def wilcoxon(spark, d):
    ev = table(spark, d, "events")
    pairs = ev.where("event_id % 2 = 0").select("event_id", F.col("value").alias("x")).join(ev.where("event_id % 2 = 1").select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("y")), "event_id")
    return st.wilcoxon(pairs, "x", "y").select("n", F.round("statistic", 3).alias("statistic"), F.round("p_value", 6).alias("p_value"))


HOLM = MCN.replace("factorial(i)", "factorial(i::integer)").replace("factorial(a_only+b_only)", "factorial((a_only+b_only)::integer)")


@query("sta_06_compare_detectors", sql(DETECT, HOLM, "ho as (select *, row_number() over (order by p, name) as rk from pp), hs as (select *, 0.05::double/(3-rk+1) as thr from ho), hx as (select *, min((p<thr)::integer) over (order by rk)=1 as sig, 2*asin(sqrt(mr))-2*asin(sqrt(r)) as h from hs)",
       "select name, a_only, b_only, round(stat,6)::double as statistic, round(p,6)::double as p_value, round(mr,6) as main_rate, round(r,6) as other_rate, round(ag,6) as agreement, round(h,6) as effect_h, case when abs(h)<0.2 then 'negligible' when abs(h)<0.5 then 'small' when abs(h)<0.8 then 'medium' else 'large' end as effect, "
       "rk::integer as holm_rank, round(thr,6) as holm_threshold, sig as significant, main_lo, main_hi from hx, (select main_lo, main_hi from (with " + boot_sql("dt", "period", "sum(w*main::integer)::double/sum(w)", 1000, ("main_lo", "main_hi")) + "))"))
def compare_detectors(spark, d):
    return rounded(st.compare_detectors(detections(spark, d), "main", ["d1", "d2", "d3"], key="period"), "statistic", "p_value", "main_rate", "other_rate", "agreement", "effect_h", "holm_threshold", "main_lo", "main_hi")


@query("win_13_holm", "with g as (select event_type, cast(ts as date)::varchar as name, ((sum(event_id)%1000)/20000.0::double)::double as p_value from events group by 1,2), r as (select *, row_number() over (partition by event_type order by p_value, name) as rk, count(*) over (partition by event_type) as m from g), "
       "t as (select *, 0.05::double/(m-rk+1) as thr from r) select event_type, name, p_value, rk::integer as holm_rank, round(thr,6) as holm_threshold, min((p_value<thr)::integer) over (partition by event_type order by rk)=1 as significant from t")
def holm(spark, d):
    g = table(spark, d, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("name")).agg((F.sum("event_id") % 1000 / F.lit(20000.0)).alias("p_value"))
    return rounded(st.holm(g, 0.05, ["event_type"]), "holm_threshold")
