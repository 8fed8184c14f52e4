"""Training, batch scoring, neighbours and extension points over the embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.operators import extensions as ex
from quorate.operators import models as mo
from quorate.operators import projections as pj
from quorate.operators import scores as sc
from quorate.operators import statistics as st
from quorate.plans.bindings import RANGES, TOKENS, VECL, W, sql, table, vectors
from quorate.plans.drift import boot_sql
from quorate.plans.features import RULES
from quorate.plans.registry import query
from quorate.plans.score import rounded

VIEWS = {"V_byte": ["A"], "V_struct": ["B", "C"], "V_all": ["__ALL__"]}
MEMBERS = {"svm": ("linear", "V_byte"), "forest": ("forest", "V_struct"), "boost": ("gbt", "V_all"), "net": ("mlp", "V_struct")}


def wide(spark, d):
    """One column per view; the struct view is absent for every ninth sample."""
    m = pj.project_views(vectors(spark, d), "vec", RANGES, VIEWS)
    cols = {v: F.try_element_at("views", F.lit(v)) for v in VIEWS}
    cols["V_struct"] = F.when(F.col("sample_id") % 9 != 0, cols["V_struct"])
    return m.select("sample_id", "y", "period", *[c.alias(v) for v, c in cols.items()])


def _scored(spark, d, members):
    f = wide(spark, d)
    models = mo.train_ensemble(f.where("period <= 4"), members)
    return mo.score_all(f, models, members, ["sample_id", "y", "period"])


def _member(name):
    def run(spark, d):
        s = _scored(spark, d, {name: MEMBERS[name]})
        return rounded(sc.model_eval(s, 1, ["period"]), "accuracy", "mean_score", "auc")
    return run


query("mlt_01_linear", None)(_member("svm"))
query("mlt_02_forest", None)(_member("forest"))
query("mlt_03_gbt", None)(_member("boost"))
query("mlt_04_mlp", None)(_member("net"))


@query("mlt_05_ensemble", None)
def ensemble(spark, d):
    s = sc.ensemble(_scored(spark, d, MEMBERS), len(MEMBERS), name="e")
    return rounded(sc.confusion(s, ["period"], "e", "y"), "precision", "recall", "f1", "fpr", "accuracy")


@query("mlt_06_score_status", "select m.name as member, case when m.name in ('forest','net') and vec_id%9=0 then 'skipped' else 'ok' end as status, count(*) as n from embeddings, (values ('svm'),('forest'),('boost'),('net')) m(name) group by 1,2")
def score_status(spark, d):
    s = _scored(spark, d, MEMBERS)
    names = F.array(*[F.lit(n) for n in MEMBERS])
    return s.select(F.inline(F.arrays_zip(names, "statuses")).alias("member", "status")).groupBy("member", "status").agg(F.count(F.lit(1)).alias("n"))


@query("jon_11_knn", sql(VECL, "p as (select a.sample_id, b.sample_id as o, b.y, sqrt(sum(power(a.x-b.x,2))) as d from vl a join vl b using (dim) where a.period>=5 and b.period<=4 group by 1,2,3), n as (select * from p qualify row_number() over (partition by sample_id order by d, o)<=5), "
       "w as (select sample_id, sum(case when y=1 then 1/(d+1e-8) end) as a, sum(1/(d+1e-8)) as b from n group by 1)", "select sample_id, round(coalesce(a,0)/b,6)::double as probability, (coalesce(a,0)/b>0.5)::integer as prediction from w"))
def knn(spark, d):
    v = vectors(spark, d)
    return rounded(mo.knn_classify(v.where("period <= 4"), v.where("period >= 5"), "sample_id"), "probability")


@query("udx_01_scorer", sql(VECL, "select sample_id, round(1/(1+exp(-sum(x))),6) as score from vl where dim<16 group by 1"))
def scorer(spark, d):
    def logistic(m):
        import numpy as np
        return 1 / (1 + np.exp(-m.sum(1)))
    mo._scorers.clear()
    ex.register_scorer("logistic", logistic, "V_byte")
    s = mo.score_all(wide(spark, d), {}, {}, ["sample_id"])
    mo._scorers.clear()
    return s.select("sample_id", F.round(F.get("scores", F.lit(0)), 6).alias("score"))


@query("udx_02_detector", sql(W, "select period, avg((s0>0.9)::integer)>0.06 as det_tail from w where period>=5 group by 1"))
def detector(spark, d):
    from quorate.operators import detectors as de
    from quorate.plans.drift import test, train
    ex.register_detector("tail", lambda cal, t, k: t.groupBy("period").agg((F.avg((F.get("scores", F.lit(0)) > 0.9).cast("double")) > 0.06).alias("detected")))
    try:
        return de.run_all(train(spark, d), test(spark, d), 8, ["tail"])
    finally:
        de._registered.pop("tail")


@query("udx_03_rules", "with r as (select doc_id as sample_id, contains(lower(text),' the ') as a, contains(lower(text),'key') as b from documents) select sample_id, concat_ws(',', case when a then 'has_the' end, case when b then 'has_key' end) as rules from r where a or b")
def rules(spark, d):
    ex.register_rules([r for r in RULES if r[0] in ("has_the", "has_key")])
    m = ex.match_registered(table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "text"), "sample_id", "text")
    return m.select("sample_id", F.array_join("rules", ",").alias("rules"))


@query("udx_04_table_function", sql(TOKENS, "select sample_id, count(*) as n, sum(length(token))::bigint as chars from tok group by 1"))
def table_function(spark, d):
    ex.register_functions(spark)
    table(spark, d, "documents").createOrReplaceTempView("quorate_docs")
    return spark.sql("SELECT cast(key AS bigint) AS sample_id, count(*) AS n, sum(length(token)) AS chars FROM tokens_of(TABLE(SELECT doc_id, text FROM quorate_docs)) GROUP BY key")


@query("udx_05_bootstrap_statistic", "with dy as (select cast(ts as date)::varchar as day, avg(value) as v from events group by 1), " + boot_sql("dy", "day", "sqrt(sum(w*v*v)/sum(w))", 500))
def bootstrap_statistic(spark, d):
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    root_mean_square = st.Statistic({"n": F.lit(1.0), "squares": F.col("v") * F.col("v")}, F.sqrt(F.col("squares") / F.col("n")))
    return rounded(st.bootstrap_ci(daily, "day", root_mean_square, n_boot=500), "lo", "hi")
