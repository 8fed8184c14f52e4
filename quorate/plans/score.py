"""Score analytics over the event-derived score matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.functions.columns import exceeds
from quorate.operators import ordering
from quorate.operators import scores as sc
from quorate.plans.bindings import DIM, DIMS, L, W, scores, sql
from quorate.plans.registry import query

K = DIMS.size
ENS = ("ens as (select sample_id, any_value(grp) grp, any_value(period) period, any_value(y) y, avg(score) as e from l group by 1)")
AUC = ("(select {g}, (sum(case when y=1 then r end) - sum(y)*(sum(y)+1)/2.0) / nullif((sum(y)*(count(*)-sum(y)))::double,0) as auc from "
       "(select *, rank() over (partition by {g} order by {s}) + (count(*) over (partition by {g}, {s}) - 1)/2.0 as r from {t} where {s} is not null) group by {g})")
RATES = ("round(case when tp+fp>0 then tp::double/(tp+fp) else 0 end,6) as precision, round(case when tp+fn>0 then tp::double/(tp+fn) else 0 end,6) as recall, "
         "round(case when 2*tp+fp+fn>0 then 2.0::double*tp/(2*tp+fp+fn) else 0 end,6) as f1, round(case when fp+tn>0 then fp::double/(fp+tn) else 0 end,6) as fpr, "
         "round((tp+tn)::double/(tp+fp+tn+fn),6) as accuracy")


def conf_sql(p: str) -> str:
    return (f"count(*) filter ({p} and y=1) as tp, count(*) filter ({p} and y=0) as fp, count(*) filter (not {p} and y=0) as tn, "
            f"count(*) filter (not {p} and y=1) as fn")


def rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


RATE_COLS = ("precision", "recall", "f1", "fpr", "accuracy")


@query("agg_06_period_scores", sql(L, ENS, f"select period, n, round(accuracy,6) as accuracy, round(f1,6) as f1, round(auc,6) as auc from "
       f"(select period, count(*) as n, {conf_sql('e>0.5')}, (tp+tn)::double/count(*) as accuracy, 2.0::double*tp/(2*tp+fp+fn) as f1 from ens group by 1) "
       f"join {AUC.format(g='period', s='e', t='ens')} using (period)"))
def period_scores(spark, d):
    """Flagship: ensemble -> confusion -> AUC per period."""
    ens = sc.ensemble(scores(spark, d), K, name="e").select("period", "y", "e")
    rep = sc.confusion(ens, ["period"], "e", "y").join(ordering.auc(ens, ["period"], "e", "y"), "period")
    return rounded(rep.select("period", "n", "accuracy", "f1", "auc"), "accuracy", "f1", "auc")


@query("agg_06_weighted_ensemble", sql(L, "select sample_id, round(sum(score*w)/sum(w),6) as ensemble from (select *, (case when score is not null then model_id+1.0 end)::double as w from l) group by 1"))
def weighted_ensemble(spark, d):
    return rounded(sc.ensemble(scores(spark, d), K, [float(k + 1) for k in range(K)]).select("sample_id", "ensemble"), "ensemble")


@query("agg_07_vote_stats", sql(L, "select sample_id, count(score)::integer as ok_models, (8-count(score))::integer as skipped_models, (count(*) filter (score>0.5))::integer as malicious_votes, "
       "(count(score)-count(*) filter (score>0.5))::integer as benign_votes, round((count(*) filter (score>0.5))::double/count(score),6) as agreement_rate, "
       "round(min(score),6) as min_score, round(max(score),6) as max_score from l group by 1"))
def vote_stats(spark, d):
    v = sc.vote_stats(scores(spark, d), K)
    return rounded(v.drop("grp", "period", "y", "scores"), "agreement_rate", "min_score", "max_score")


@query("agg_08_confusion_by_model", sql(L, f"select *, {RATES} from (select period, model_id, count(*) as n, {conf_sql('score>0.5')} from l where score is not null group by 1,2)"))
def confusion_by_model(spark, d):
    long = sc.to_long(scores(spark, d), ["period", "y"])
    return rounded(sc.confusion(long, ["period", "model_id"], "score", "y"), *RATE_COLS)


GRID = [0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7]
SWEEP = (f"sw as (select thr, {RATES.replace('round(', '(').replace(',6)', ')')}, tp, fp, tn, fn from (select thr, {conf_sql('e>=thr')} from ens, "
         f"(values {', '.join(f'({t}::double)' for t in GRID)}) g(thr) group by 1))")


@query("agg_09_threshold_sweep", sql(L, ENS, SWEEP, "select thr, tp::bigint as tp, fp::bigint as fp, tn::bigint as tn, fn::bigint as fn, " + ", ".join(f"round({c},6) as {c}" for c in RATE_COLS) + " from sw"))
def threshold_sweep(spark, d):
    ens = sc.ensemble(scores(spark, d), K, name="e")
    return rounded(sc.sweep(ens, "e", "y", GRID), *RATE_COLS)


@query("agg_09_best_threshold", sql(L, ENS, SWEEP, "select thr, round(f1,6) as f1, round(precision,6) as precision, round(recall,6) as recall from sw order by f1 desc, thr limit 1"))
def best_threshold(spark, d):
    ens = sc.ensemble(scores(spark, d), K, name="e")
    return rounded(sc.best_threshold(sc.sweep(ens, "e", "y", GRID)), "f1", "precision", "recall")


@query("agg_10_auc_by_model_period", sql(L, f"select period, model_id, round(auc,6) as auc from {AUC.format(g='period, model_id', s='score', t='l')}"))
def auc_by_model_period(spark, d):
    long = sc.to_long(scores(spark, d), ["period", "y"])
    return rounded(ordering.auc(long, ["period", "model_id"], "score", "y"), "auc")


MODEL_EVAL = ("me as (select model_id, count(*) as n, avg(((score>0.5)::integer=y)::integer::double) as accuracy, avg(score) as mean_score from l where score is not null group by 1)")


@query("agg_11_model_eval", sql(L, MODEL_EVAL, f"select model_id, n, round(accuracy,6) as accuracy, round(mean_score,6) as mean_score, round(auc,6) as auc, accuracy>=0.58 as star from me join {AUC.format(g='model_id', s='score', t='l')} using (model_id)"))
def model_eval(spark, d):
    return rounded(sc.model_eval(scores(spark, d), K, star=0.58), "accuracy", "mean_score", "auc")


@query("agg_12_auc_weights", sql(L, "lt as (select * from l where period<=4)", f"a as {AUC.format(g='model_id', s='score', t='lt')}",
       "r as (select model_id, power(greatest(auc-0.5,0),2) as q from a)", "select model_id, round(q/sum(q) over (),6) as weight from r"))
def auc_weights(spark, d):
    train = scores(spark, d).where("period <= 4")
    return rounded(sc.auc_weights(sc.model_eval(train, K)).select("model_id", "weight"), "weight")


@query("agg_13_disagreement", sql(L, "select a.period, a.model_id as mi, b.model_id as mj, round(avg(abs(a.score-b.score)),6) as score_gap, "
       "round(avg(((a.score>0.5)<>(b.score>0.5))::integer::double),6) as pred_gap, round(0.6::double*avg(abs(a.score-b.score))+0.4::double*avg(((a.score>0.5)<>(b.score>0.5))::integer::double),6) as d "
       "from l a join l b on a.sample_id=b.sample_id and a.model_id<b.model_id where a.score is not null and b.score is not null group by 1,2,3"))
def disagreement(spark, d):
    return rounded(sc.disagreement(scores(spark, d), K, ["period"]), "score_gap", "pred_gap", "d")


@query("agg_14_disagreement_rate", sql(L, "c as (select sample_id, period, count(*) filter (score>0.5) as c, count(score) as k from l group by 1,2)",
       "select period, round(avg(2.0::double*c*(k-c)/(k*k)),6) as rate from c group by 1"))
def disagreement_rate(spark, d):
    return rounded(sc.disagreement_rate(scores(spark, d), K, ["period"]), "rate")


@query("jon_07_with_dims", sql(L, DIM, "select period, view, level, count(*) as n, count(score) as n_scored, round(avg(score),6) as mean_score from l join dim using (model_id) group by 1,2,3"))
def with_dims(spark, d):
    long = sc.with_dims(sc.to_long(scores(spark, d), ["period"]), DIMS)
    return rounded(long.groupBy("period", "view", "level").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"), F.avg("score").alias("mean_score")), "mean_score")


PAIRS = [(i, j) for i in range(8) for j in range(i + 1, 8)]


@query("jon_08_model_pairs", sql(W, "select sample_id, " + "+".join(f"(s{i} is not null and s{j} is not null)::integer" for i, j in PAIRS) + " as pairs, round("
       + "+".join(f"coalesce(abs(s{i}-s{j})*{i + 2 * j},0)" for i, j in PAIRS) + ",6) as gap, (" + "+".join(f"coalesce(((s{i}>0.5)<>(s{j}>0.5))::integer,0)" for i, j in PAIRS) + ")::double as differ from w"))
def model_pairs(spark, d):
    pairs = sc.model_pairs(scores(spark, d), K, ["sample_id"]).groupBy("sample_id")
    return rounded(pairs.agg(F.count("gap").cast("int").alias("pairs"), F.sum(F.col("gap") * (F.col("mi") + 2 * F.col("mj"))).alias("gap"), F.sum("differ").alias("differ")), "gap")


@query("prj_13_thresholds", sql(W, "select period, count(*) filter (s0>0.5) as above, count(*) filter (s0>=0.5) as at_least, count(*) filter (s0>0.25) as above_quarter from w group by 1"))
def thresholds(spark, d):
    s = F.get("scores", F.lit(0))
    return scores(spark, d).groupBy("period").agg(F.sum(exceeds(s, 0.5)).alias("above"), F.sum(exceeds(s, 0.5, True)).alias("at_least"), F.sum(exceeds(s, 0.25)).alias("above_quarter"))


NAMED = ("nm as (select sample_id, period, md5(sample_id::varchar) as sha, greatest(s0,s1,s2,s3,s4,s5,s6,s7) as best, case " + " ".join(
    f"when s{i}=greatest(s0,s1,s2,s3,s4,s5,s6,s7) then '{v}'" for i, v, _ in DIMS.rows()) + " end as view, "
    "case when sample_id%4=0 then 'perturbation' when sample_id%4=1 then 'structural' when sample_id%4=2 then 'paradigm_shift' else 'none' end as dt from w)")


@query("win_16_top_view_label", sql(W, NAMED, "select sample_id, view, case dt when 'perturbation' then 'Gen' when 'structural' then 'GenKD' when 'paradigm_shift' then 'GenKD.2' "
       "else case view when 'V_string' then 'Worm' when 'V_struct' then 'Trojan' when 'V_import' then 'Trojan' else 'Virus' end end "
       "||'.'||case view when 'V_byte' then 'ByS' when 'V_string' then 'Str' when 'V_struct' then 'PEs' when 'V_import' then 'Imp' else 'Ens' end||'.'||substring(sha,1,8) as label from nm"))
def top_view_label(spark, d):
    df = sc.top_view(scores(spark, d), DIMS)
    drift = F.element_at(F.array(*[F.lit(x) for x in ("perturbation", "structural", "paradigm_shift", "none")]), (F.col("sample_id") % 4 + 1).cast("int"))
    return df.select("sample_id", "view", sc.label_name(drift, F.col("view"), F.md5(F.col("sample_id").cast("string").cast("binary"))).alias("label"))
