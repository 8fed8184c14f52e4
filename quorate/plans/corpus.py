"""Corpus building: sources, gates, projections, period assignment, sets, publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quorate.operators import corpus as co
from quorate.operators import headers as hd
from quorate.operators import projections as pj
from quorate.operators import scores as sc
from quorate.operators.ordering import id_digits
from quorate.plans.bindings import (BALANCED, DIMS, RANGES, SAMPLES, VECL, VIEW_RANGES, balanced_samples, samples, scores, sql, table,
                                    vectors)
from quorate.plans.registry import query
from quorate.plans.score import rounded
from quorate.session import shared_dir
from quorate.sources import corpus as src
from quorate.sources import responses as rp
from quorate.sources import signatures as sg
from quorate.sources import sinks as sk

# ---- sources -------------------------------------------------------------------------------------------------------


@query("src_01_label_from_path", "with p as (select doc_id, (['malicious','Clean','mal','goodware','misc','0'])[doc_id%6+1]||'/'||source||case when doc_id%5=0 then '/x/deep' else '' end||'/f'||doc_id||(['.exe','.dll','.txt','.EXE'])[doc_id%4+1] as rel from documents) "
       "select rel as rel_path, (case when doc_id%6 in (0,2) then 1 when doc_id%6 in (1,3,5) then 0 else -1 end)::integer as label from p where doc_id%4<>2")
def label_from_path(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % n + 1).cast("int"))
    deep = F.when(F.col("doc_id") % 5 == 0, "/x/deep").otherwise("")
    rel = F.concat(pick(["malicious", "Clean", "mal", "goodware", "misc", "0"], 6), F.lit("/"), F.col("source"), deep, F.lit("/f"),
                   F.col("doc_id").cast("string"), pick([".exe", ".dll", ".txt", ".EXE"], 4))
    return src.label_files(docs, rel).select("rel_path", "label")


@query("src_02_year_from_path", "select doc_id, case when doc_id%3<>0 then (2015+doc_id%9)::integer end as year from documents")
def year_from_path(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    folder = F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 9 + 2015).cast("string")).otherwise("old20")
    path = F.concat(F.lit("/corpus/"), folder, F.lit("/"), F.col("source"), F.lit("/12345678.bin"))
    return docs.select("doc_id", src.year_from_path(path).alias("year"))


@query("src_03_metadata_jsonl", "select doc_id, case when doc_id%4=3 then '/abs/'||doc_id else 'base/'||source||'/'||doc_id end as path, (case when doc_id%4=2 then 0 else doc_id%2 end)::integer as label, "
       "(case when doc_id%4=1 then 0 else doc_id%12+1 end)::integer as period, case when doc_id%4 in (0,1) then lang else 'unknown' end as family from documents")
def metadata_jsonl(spark, d):
    c, k = F.col, F.col("doc_id") % 4
    p = F.concat_ws("/", "source", c("doc_id").cast("string"))
    lab, mon = (c("doc_id") % 2).cast("int"), (c("doc_id") % 12 + 1).cast("int")
    line = (F.when(k == 0, F.to_json(F.struct(p.alias("path"), lab.alias("label"), mon.alias("month"), c("lang").alias("family"))))
            .when(k == 1, F.to_json(F.struct(p.alias("file"), (lab == 1).alias("malware"), c("lang").alias("avclass"))))
            .when(k == 2, F.to_json(F.struct(p.alias("sha256"), F.lit("n/a").alias("label"), mon.cast("string").alias("appeared_month"))))
            .otherwise(F.to_json(F.struct(F.concat(F.lit("/abs/"), c("doc_id").cast("string")).alias("path"), lab.cast("string").alias("y"), mon.alias("month")))))
    return src.parse_metadata(table(spark, d, "documents").select("doc_id", line.alias("value")), "base")


def _own_folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("src_04_metadata_csv", "select doc_id, (doc_id%2)::integer as label, (case when doc_id%5=0 then 0 else doc_id%12+1 end)::integer as period, case when doc_id%3=0 then 'unknown' else source end as family from documents")
def metadata_csv(spark, d):
    """Written as CSV into the shared folder and found there as the first metadata source that exists."""
    c, root = F.col, _own_folder(spark, "metadata")
    rows = table(spark, d, "documents").select(c("doc_id").cast("string").alias("file"), (c("doc_id") % 2).alias("y"), F.when(c("doc_id") % 5 != 0, c("doc_id") % 12 + 1).alias("appeared_month"),
                                               F.when(c("doc_id") % 3 != 0, c("source")).alias("avclass"))
    rows.write.option("header", "true").csv(f"{root}/metadata.csv")
    got = src.read_metadata(spark, root)
    return got.select(F.regexp_extract("path", "([0-9]+)$", 1).cast("bigint").alias("doc_id"), "label", "period", "family")


@query("src_05_feature_error_gate", "select count(*) as n, count(*) filter (doc_id%13=0) as bad, count(*) filter (doc_id%13=0)>count(*)*0.05 as failed from documents")
def feature_error_gate(spark, d):
    c = F.col
    good = F.to_json(F.struct((c("doc_id") % 2).alias("label"), F.lit("2020-01").alias("appeared"), F.array(c("n_chars").cast("double")).alias("histogram")))
    lines = table(spark, d, "documents").select(F.when(c("doc_id") % 13 == 0, F.concat(F.lit('{"label": '), c("lang"))).otherwise(good).alias("value"))
    return src.check_error_rate(src.parse_features(lines), 0.05)


@query("src_06_float_matrix", "select row_number() over (order by vec_id)-1 as row_id, len(embedding)::integer as ndim, round(list_sum(list_transform(embedding, lambda x: x::double)),6) as checksum, round(embedding[1]::double,6) as first from embeddings")
def float_matrix(spark, d):
    """Vectors written as raw rows in the order of their ids and read back by their place in the files."""
    emb = table(spark, d, "embeddings")
    path = f"{shared_dir(spark).rstrip('/')}/matrix-{uuid.uuid4().hex}"
    size = emb.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    src.write_float_matrix(emb, path, "embedding", size["width"], ["vec_id"])
    m = src.read_float_matrix(spark, path, size["n"])
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return m.select("row_id", F.size("vec").alias("ndim"), F.round(total, 6).alias("checksum"), F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("first"))


@query("src_07_tabular", "select event_id, ts, props, (case when event_type='view' then 0 else 1 end)::integer as label, round(value+2*user_id,6) as checksum from events")
def tabular(spark, d):
    ev = table(spark, d, "events").withColumn("Class", F.when(F.col("event_type") == "view", "Benign").otherwise(F.col("event_type"))).drop("event_type")
    t = src.tabular(ev.withColumn("key", F.col("event_id").cast("string")), "class", ["EVENT_ID"])
    t = t.select(F.col("event_id"), "ts", "props", "label", F.round(F.get("vec", F.lit(1)) + F.get("vec", F.lit(0)) * 2, 6).alias("checksum"))
    return t


SIG_LINES = ("ln as (select doc_id, case doc_id%6 when 0 then sha256(text)||':'||octet_length(encode(text))||':n'||doc_id when 1 then '  '||sha256(text)||':*:n'||doc_id when 2 then '# note' "
             "when 3 then 'abc:1' when 4 then md5(text)||':5:n' else upper(sha256(text))||':0:n' end as value from documents)")


def sig_lines(spark, d):
    c, k, raw = F.col, F.col("doc_id") % 6, F.col("text").cast("binary")
    sha, name = F.sha2(raw, 256), F.concat(F.lit(":n"), c("doc_id").cast("string"))
    v = (F.when(k == 0, F.concat(sha, F.lit(":"), F.octet_length("text").cast("string"), name)).when(k == 1, F.concat(F.lit("  "), sha, F.lit(":*"), name))
         .when(k == 2, "# note").when(k == 3, "abc:1").when(k == 4, F.concat(F.md5(raw), F.lit(":5:n"))).otherwise(F.concat(F.upper(sha), F.lit(":0:n"))))
    return table(spark, d, "documents").select("doc_id", v.alias("value"))


@query("src_08_hash_signatures", sql(SIG_LINES, "k as (select doc_id, string_split(trim(value),':') as p from ln where doc_id%6 in (0,1,5))",
       "select lower(trim(p[1])) as digest, (case when trim(p[2]) in ('*','0') then null else trim(p[2])::bigint end) as size from k qualify row_number() over (partition by lower(trim(p[1])) order by doc_id)=1"))
def hash_signatures(spark, d):
    return sg.hash_signatures(sig_lines(spark, d), "sha256", "doc_id")


@query("src_08_import_outcomes", sql(SIG_LINES, "select case when doc_id%6=4 then 'skipped' else 'kept' end as outcome, count(*) as n from ln where doc_id%6 in (0,1,4,5) group by 1"))
def import_outcomes(spark, d):
    return sg.split_hash_lines(sig_lines(spark, d), "sha256").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("src_08_incremental_import", sql(SIG_LINES, "k as (select distinct lower(trim(string_split(trim(value),':')[1])) as digest, doc_id<500 as old from ln where doc_id%6 in (0,1,5))",
       "select digest from k group by 1 having not bool_or(old)"))
def incremental_import(spark, d):
    lines = sig_lines(spark, d)
    known = sg.hash_signatures(lines.where("doc_id < 500"), "sha256", "doc_id")
    return sg.hash_signatures(lines, "sha256", "doc_id", existing=known).select("digest")


@query("src_09_fuzzy_signatures", "with b as (select doc_id, sha256(text) as s, md5(text) as m, octet_length(encode(text)) as n from documents where doc_id%9<>0), "
       "u as (select doc_id, s, n, 'ssdeep' as hash_type, case when doc_id%3<>0 then 'ss'||substr(m,1,6) end as value from b union all select doc_id, s, n, 'vhash', substr(m,1,4) from b "
       "union all select doc_id, s, n, 'authentihash', m from b union all select doc_id, s, n, 'imphash', case when doc_id%2=0 then substr(m,1,8) end from b) "
       "select hash_type, value, case when doc_id%4=0 then null else n::bigint end as size, 'n'||doc_id as name, s as sha256 from u where value is not null qualify row_number() over (partition by hash_type, value order by doc_id)=1")
def fuzzy_signatures(spark, d):
    c, raw = F.col, F.col("text").cast("binary")
    m = F.md5(raw)
    line = F.concat_ws(":", F.sha2(raw, 256), F.when(c("doc_id") % 4 == 0, "*").otherwise(F.octet_length("text").cast("string")), F.concat(F.lit("n"), c("doc_id").cast("string")),
                       F.when(c("doc_id") % 3 != 0, F.concat(F.lit("ss"), F.substring(m, 1, 6))).otherwise(""), F.upper(F.substring(m, 1, 4)), m,
                       F.when(c("doc_id") % 2 == 0, F.substring(m, 1, 8)).otherwise("abc"), F.lit("zz"))
    lines = table(spark, d, "documents").select("doc_id", F.when(c("doc_id") % 9 == 0, F.concat(F.lit("#"), line)).otherwise(line).alias("value"))
    return sg.fuzzy_signatures(lines, "doc_id")


def graph_lines(spark, d):
    c = F.col
    k = c("o_orderkey")
    acfg = F.array(*[F.struct((k % 3 + i + 1).cast("int").alias("block_number"), F.array(F.array(F.lit(0)), F.array(F.lit(1))).alias("block_edges"),
                              F.array(*[F.array((k % 10 + j).cast("double"), F.lit(1.0)) for j in range(2)]).alias("block_features")) for i in range(2)])
    names = F.array(F.lit("local_a"), F.lit("local_b"), F.concat(F.lit("ext_"), (k % 17).cast("string")), F.concat(F.lit("ext_"), (k % 5).cast("string")))
    g = F.to_json(F.struct(k.cast("string").alias("hash"), (k % 2).cast("int").alias("label"), F.array(F.array(k % 4, k % 3), F.array(k % 2, F.lit(3))).alias("function_edges"),
                           acfg.alias("acfg_list"), names.alias("function_names")))
    return src.parse_graphs(table(spark, d, "orders").select(g.alias("value")))


@query("src_10_graph_edges", "select o_orderkey::varchar as hash, o_orderkey%4 as src, o_orderkey%2 as dst from orders union all select o_orderkey::varchar, o_orderkey%3, 3 from orders")
def graph_edges(spark, d):
    return src.graph_edges(graph_lines(spark, d))


@query("src_10_graph_blocks", "select o_orderkey::varchar as hash, f::integer as function, j::integer as block, (o_orderkey%10+j)::double as first_feature from orders, range(2) a(f), range(2) b(j)")
def graph_blocks(spark, d):
    return src.graph_blocks(graph_lines(spark, d)).select("hash", "function", "block", F.get("features", F.lit(0)).alias("first_feature"))


@query("src_10_external_names", "select name, count(*) as n from (select 'ext_'||(o_orderkey%17) as name from orders union all select 'ext_'||(o_orderkey%5) from orders) group by 1")
def external_names(spark, d):
    return src.graph_names(graph_lines(spark, d)).where("external").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def response_lines(spark, d):
    c, k = F.col, F.col("event_id") % 5
    pct = F.concat(F.round(c("value"), 2).cast("string"), F.lit("%"))
    v = (F.when(k == 0, F.to_json(F.struct(F.struct(F.struct(pct.alias("probability")).alias("m1"), (c("event_id") % 100).alias("m2")).alias("models"))))
         .when(k == 1, F.to_json(F.struct(F.array(F.struct(F.lit("net").alias("name"), (c("event_id") % 100 / 100).alias("score"), c("event_type").alias("label")),
                                                  F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("score"), F.lit("clean").alias("label"))).alias("Scores"))))
         .when(k == 2, F.to_json(F.struct(F.array((c("event_id") % 100 / 100), F.lit(0.5)).alias("scores"))))
         .when(k == 3, F.to_json(F.struct(F.lit("benign").alias("label"), (c("event_id") % 10 / 10).alias("benign_prob"))))
         .otherwise(F.to_json(F.struct((c("event_id") % 2 == 0).alias("is_malware"), F.lit("n/a").alias("score")))))
    return table(spark, d, "events").select("event_id", v.alias("body"))


_V = "case when p is null then 'failed' when p>0.5 then 'malicious' else 'benign' end"


@query("src_11_model_responses", "with b as (select event_id, value, event_type, event_id%5 as k from events), r as ("
       "select event_id, 'm1' as name, round(least(round(value,2)/100,1),4) as p, null as f from b where k=0 union all "
       "select event_id, 'm2', round(case when event_id%100>1 then (event_id%100)/100.0::double else (event_id%100)::double end,4), null from b where k=0 union all "
       "select event_id, 'net', round((event_id%100)/100.0::double,4), null from b where k=1 union all select event_id, 'Model-2', null, 'benign' from b where k=1 union all "
       "select event_id, 'Model-1', round((event_id%100)/100.0::double,4), null from b where k=2 union all select event_id, 'Model-2', 0.5, null from b where k=2 union all "
       "select event_id, 'ensemble', round(1-(event_id%10)/10.0::double,4), 'benign' from b where k=3 union all "
       "select event_id, 'ensemble', null, case when event_id%2=0 then 'malicious' else 'benign' end from b where k=4) "
       f"select event_id, name, p as probability, coalesce(f, {_V}) as result from r")
def model_responses(spark, d):
    return rp.normalise(response_lines(spark, d), "body", ["event_id"])


# ---- sinks ---------------------------------------------------------------------------------------------------------


@query("snk_01_publish", "select (doc_id%12+1)::integer as period, count(*) as n, sum(octet_length(encode(text)))::bigint as bytes, max(doc_id) as last from documents group by 1")
def publish(spark, d):
    """Published by period into the shared folder and read back."""
    out = _own_folder(spark, "published")
    c = F.col
    sk.write_dataset(table(spark, d, "documents").select(c("doc_id").alias("sample_id"), (c("doc_id") % 12 + 1).cast("int").alias("period"), F.octet_length("text").cast("bigint").alias("size")), out)
    return spark.read.parquet(out).groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("sample_id").alias("last"))


@query("snk_02_index_lines", sql(SAMPLES, "select '{\"month\":'||period||',\"label\":'||label||',\"family\":\"'||family||'\"}' as value from smp"))
def index_lines(spark, d):
    return sk.index_lines(samples(spark, d))


@query("snk_03_report_rows", "with p as (select ((o_orderkey%50)+1)::integer as period, avg(o_totalprice) as auc, max(o_totalprice)/7 as gap from orders group by 1) "
       "select period::varchar as period, printf('%.4f', auc) as auc, printf('%.2f', gap) as gap, case when auc>250000 then 'Y' else 'N' end as drift from p")
def report_rows(spark, d):
    o = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 50 + 1).cast("int").alias("period")).agg(F.avg("o_totalprice").alias("auc"), (F.max("o_totalprice") / 7).alias("gap"))
    return sk.summary_rows(o.withColumn("drift", F.col("auc") > 250000), four=["auc"], two=["gap"], flags=["drift"])


@query("snk_03_report_json", "select '{\"event_id\":'||event_id||',\"ratio\":'||case when event_id%7=0 then 'null' else ((event_id%8)/8.0::double)::varchar end||'}' as value from events")
def report_json(spark, d):
    e = F.col("event_id")
    bad = F.when(e % 14 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return sk.report_json(table(spark, d, "events").select("event_id", F.when(e % 7 == 0, bad).otherwise((e % 8) / F.lit(8.0)).alias("ratio")))


@query("snk_04_manifest_counts", sql(SAMPLES, "select period, label, count(*) as n from smp group by rollup(period, label)"))
def manifest_counts(spark, d):
    return sk.manifest_counts(samples(spark, d))


@query("snk_04_manifest_checksums", sql(SAMPLES, "select period, count(*) as n, sum(('0x'||substr(sha256,1,12))::hugeint)::varchar as checksum from smp group by 1"))
def manifest_checksums(spark, d):
    return sk.manifest_checksums(samples(spark, d))


# widths of the projected views (a view without a rule has none), rows per period, and what differs from what was expected
@query("snk_04_manifest_fields", "with r as (select (vec_id%6+1)::integer as period, vec_id from embeddings), c as (select period, count(*) as n from r group by 1), "
       f"w as (select 'V_byte' as view, count(*) as n, {RANGES['A'][1] - RANGES['A'][0]} as width from r union all select 'V_struct', count(*), {RANGES['B'][1] - RANGES['B'][0]} from r where vec_id%5<>0 union all select 'V_import', count(*), {RANGES['C'][1] - RANGES['C'][0]} from r where vec_id%7<>0) "
       "select 'view_width' as field, view as name, width::varchar as value from w where n>0 union all select 'missing_view', 'V_gone', '' union all select case when period<=4 then 'train_period' else 'eval_period' end, period::varchar, n::varchar from c "
       f"union all select 'eval_period', '9', '0' union all select 'problem', 'V_byte', {RANGES['A'][1] - RANGES['A'][0]}||' instead of 3' from w where view='V_byte' and n>0 union all select 'problem', 'period 9', '0 rows instead of 5'")
def manifest_fields(spark, d):
    own = partial_views(spark, d).withColumn("period", (F.col("sample_id") % 6 + 1).cast("int"))
    return sk.manifest_fields(own, {"V_byte": 3, "V_gone": 4}, [1, 2, 3, 4], [5, 6, 9], {9: 5})


@query("snk_05_reject_counts", sql(SAMPLES, "select reason, count(*) as n from (select case when label<0 then 'no label' when size<500 then 'too small: '||family when size>8000 then 'too large' end as reason from smp) "
       "where reason is not null group by 1 order by n desc, reason limit 10"))
def reject_counts(spark, d):
    df = samples(spark, d)
    reason = F.when(F.col("label") < 0, "no label").when(F.col("size") < 500, F.concat(F.lit("too small: "), F.col("family"))).when(F.col("size") > 8000, "too large")
    return sk.reject_counts(sk.split_rejects(df, reason)[1])


# ---- projections ---------------------------------------------------------------------------------------------------


@query("prj_01_labelled", sql(SAMPLES, "select sample_id, label from smp where label>=0"))
def labelled(spark, d):
    return co.labelled(samples(spark, d)).select("sample_id", "label")


@query("prj_02_binarise", "select event_id, (case when value>10 then 1 else 0 end)::integer as y, (case when lower(event_type)<>'view' then 1 else 0 end)::integer as y_text from events")
def binarise(spark, d):
    ev = table(spark, d, "events")
    text = F.when(F.col("event_type") == "view", "BENIGN").otherwise(F.col("event_type"))
    return ev.select("event_id", co.binarise(F.col("value") - 10).alias("y"), co.binarise_class(text).alias("y_text"))


@query("prj_03_clean_numeric", "select event_id, case when event_id%5 in (0,1,2) then 0 else value end::double as value from events")
def clean_numeric(spark, d):
    e = F.col("event_id") % 5
    dirty = F.when(e == 0, float("nan")).when(e == 1, float("inf")).when(e == 2, float("-inf")).otherwise(F.col("value"))
    return co.clean_numeric(table(spark, d, "events").select("event_id", dirty.alias("value")), ["value"])


_RNG = "rg as (select * from (values " + ", ".join(f"('{v}',{lo},{hi})" for v, lo, hi in
                                                  [(v, *RANGES[r]) for v, rs in VIEW_RANGES.items() for r in (RANGES if rs == ["__ALL__"] else rs) if r in RANGES]) + ") t(view,lo,hi))"
PROJ = sql(VECL, _RNG, "select sample_id, view, count(*)::integer as width, round(sum(x*(dim+1)),6) as checksum from vl join rg on dim>=lo and dim<hi group by 1,2")


@query("prj_04_project_views", PROJ)
def project_views(spark, d):
    long = pj.project_views_long(vectors(spark, d), "vec", RANGES, VIEW_RANGES, ["sample_id"])
    base = {v: min(RANGES[r][0] for r in (RANGES if rs == ["__ALL__"] else rs) if r in RANGES) for v, rs in VIEW_RANGES.items() if rs != ["missing"]}
    start = F.element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), F.col("view"))
    weight = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1 + start)), F.lit(0.0), lambda a, x: a + x)
    return long.select("sample_id", "view", F.size("vec").alias("width"), F.round(weight, 6).alias("checksum"))


def partial_views(spark, d):
    """Samples whose views are missing by a fixed pattern."""
    wide = pj.project_views(vectors(spark, d), "vec", RANGES, {"V_byte": ["A"], "V_struct": ["B"], "V_import": ["C"], "V_ghost": ["missing"]})
    drop = F.when(F.col("sample_id") % 35 == 0, F.array(F.lit("V_struct"), F.lit("V_import"))).when(F.col("sample_id") % 5 == 0, F.array(F.lit("V_struct"))) \
        .when(F.col("sample_id") % 7 == 0, F.array(F.lit("V_import"))).otherwise(F.array().cast("array<string>"))
    return wide.withColumn("views", F.map_filter("views", lambda k, v: ~F.array_contains(drop, k)))


@query("prj_05_require_views", "select vec_id as sample_id, case when vec_id%35=0 then 'missing: V_import,V_struct' when vec_id%5=0 then 'missing: V_struct' when vec_id%7=0 then 'missing: V_import' end as reason from embeddings")
def require_views(spark, d):
    return partial_views(spark, d).select("sample_id", pj.missing_views("views", ["V_byte", "V_import", "V_struct"]).alias("reason"))


@query("prj_06_adaptive_views", "select view, n from (select 'V_byte' as view, count(*) as n from embeddings union all select 'V_struct', count(*) filter (vec_id%5<>0) from embeddings union all select 'V_import', count(*) filter (vec_id%7<>0) from embeddings)")
def adaptive_views(spark, d):
    return pj.available_views(partial_views(spark, d))


@query("prj_07_conform_dim", sql(VECL, "select sample_id, (40+sample_id%50)::integer as width, case when 40+sample_id%50>64 then 'padded:64->'||(40+sample_id%50) when 40+sample_id%50<64 then 'truncated:64->'||(40+sample_id%50) end as note, "
       "round(sum(case when dim<40+sample_id%50 then x else 0 end),6) as total from vl group by 1"))
def conform_dim(spark, d):
    want = (F.col("sample_id") % 50 + 40).cast("int")
    v = vectors(spark, d).withColumn("fixed", pj.conform(F.col("vec"), want))
    return v.select("sample_id", F.size("fixed").alias("width"), pj.conform_note(F.col("vec"), want).alias("note"),
                    F.round(F.aggregate("fixed", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("prj_08_align_dims", sql(VECL, "a as (select sample_id, case when sample_id%2=0 then 'even' else 'odd' end as view, x, dim, 10+sample_id%20 as w from vl where dim<10+sample_id%20)",
       "select view, sample_id, (max(max(w)) over (partition by view))::integer as width, round(sum(x),6) as total from a group by 1,2"))
def align_dims(spark, d):
    v = vectors(spark, d).select("sample_id", F.when(F.col("sample_id") % 2 == 0, "even").otherwise("odd").alias("view"),
                                 F.slice("vec", F.lit(1), (F.col("sample_id") % 20 + 10).cast("int")).alias("vec"))
    return pj.align_dims(v).select("view", "sample_id", F.size("vec").alias("width"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("prj_09_index_category", "select doc_id, (dense_rank() over (order by source)-1) as idx from documents")
def index_category(spark, d):
    return co.index_category(table(spark, d, "documents").select("doc_id", "source"), "source").select("doc_id", "idx")


@query("prj_10_normalise_probability", "select event_id, round(case event_id%6 when 0 then least(round(value,2)/100,1) when 1 then case when value/100>1 then least(value/100/100,1) else value/100 end when 2 then case when value>1 then least(value/100,1) else value end when 3 then null when 4 then null else 0 end,6)::double as p from events")
def normalise_probability(spark, d):
    e, v = F.col("event_id") % 6, F.col("value")
    text = (F.when(e == 0, F.concat(F.lit(" "), F.round(v, 2).cast("string"), F.lit("% "))).when(e == 1, (v / 100).cast("string")).when(e == 2, v.cast("string"))
            .when(e == 3, "abc").when(e == 4, " ").otherwise("-3"))
    return table(spark, d, "events").select("event_id", F.round(rp.normalise_probability(text), 6).alias("p"))


@query("prj_11_normalise_verdict", "select event_id, case when event_type='error' then 'malicious' when event_type='view' then 'benign' when event_id%3=0 then 'failed' when value>10 then 'malicious' else 'benign' end as verdict from events")
def normalise_verdict(spark, d):
    word = F.when(F.col("event_type") == "error", " Infected ").when(F.col("event_type") == "view", "CLEAN").otherwise(F.col("event_type"))
    p = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return table(spark, d, "events").select("event_id", rp.normalise_verdict(F.lit(None).cast("string"), word, p, 10.0).alias("verdict"))


@query("prj_12_status", "with s as (select event_id, case when event_id%41=0 then -1 when value>12 then 1 when event_id%3=0 then 2 else 0 end as st from events) "
       "select event_id, st::integer as status, case st when -1 then 'Error' when 0 then 'Benign' when 1 then 'Malicious' else 'DriftSuspect' end as label from s")
def status(spark, d):
    st = co.status((F.col("value") > 12).cast("int"), F.col("event_id") % 3 == 0, F.col("event_id") % 41 == 0)
    return table(spark, d, "events").select("event_id", st.alias("status")).withColumn("label", co.status_label(F.col("status")))


@query("prj_14_size_bucket", sql(SAMPLES, "select sample_id, (case when size*40<10240 then 32 when size*40<30720 then 64 when size*40<61440 then 128 when size*40<102400 then 256 when size*40<204800 then 384 "
       "when size*40<512000 then 512 when size*40<1024000 then 768 else 1024 end)::integer as width from smp"))
def size_bucket(spark, d):
    return samples(spark, d).select("sample_id", co.size_bucket(F.col("size") * 40).alias("width"))


def headers(spark, d):
    """Executable headers spelled out from the order columns, one defect per divisor."""
    k = F.col("o_orderkey")
    le = lambda v, n: hd.little_endian(v, n)
    mag = F.when(k % 13 == 0, "5A4D").otherwise("4D5A")
    off = F.when(k % 11 == 0, F.lit(70000)).otherwise(F.lit(64))
    sig = F.when(k % 17 == 0, "50450001").otherwise("50450000")
    machine = F.when(k % 37 == 0, 0x1234).when(k % 2 == 0, 0x14C).otherwise(0x8664)
    nsec = F.when(k % 31 == 0, 97).otherwise(k % 12)
    opt = F.when(k % 23 == 0, 0x2000).otherwise(F.lit(224))
    ts = F.lit(1400000000) + k * 30000
    first = F.when(k % 29 == 0, F.lit(900000000)).otherwise(F.lit(0))
    section = F.concat(F.repeat(F.lit("00"), 16), le(F.lit(512), 4), le(first, 4), F.repeat(F.lit("00"), 16))
    table_hex = F.repeat(section, F.when(k % 19 == 0, F.lit(0)).otherwise(nsec).cast("int"))
    h = F.concat(mag, F.repeat(F.lit("00"), 58), le(off, 4), sig, le(machine, 2), le(nsec, 2), le(ts, 4), F.repeat(F.lit("00"), 8), le(opt, 2), F.lit("0000"),
                 F.repeat(F.lit("00"), 224), table_hex)
    return table(spark, d, "orders").select("o_orderkey", F.unhex(F.when(k % 43 == 0, F.substring(h, 1, 100)).otherwise(h)).alias("content"))


@query("prj_15_validate_header", "select o_orderkey, r is null as ok, coalesce(r,'ok') as reason from (select o_orderkey, case when o_orderkey%43=0 then 'file too small' when o_orderkey%13=0 then 'bad magic' "
       "when o_orderkey%11=0 then 'header offset out of range' when o_orderkey%17=0 then 'bad signature' when o_orderkey%37=0 then 'unknown machine' when o_orderkey%31=0 then 'too many sections' "
       "when o_orderkey%23=0 then 'optional header too large' when o_orderkey%19=0 and o_orderkey%12>0 then 'section table outside file' when o_orderkey%29=0 and o_orderkey%12>0 and not o_orderkey%19=0 then 'section 0 outside file' end as r from orders)")
def validate_header(spark, d):
    return hd.validate_header(headers(spark, d), "content").select("o_orderkey", "ok", "reason")


@query("prj_16_header_period", "with t as (select o_orderkey, 1400000000+o_orderkey*30000 as ts, not (o_orderkey%43=0 or o_orderkey%13=0 or o_orderkey%11=0 or o_orderkey%17=0) and 1400000000+o_orderkey*30000 between 1420070400 and 1767225600 as ok from orders) "
       "select o_orderkey, case when ok then year(make_timestamp(ts*1000000))::integer end as year, case when ok then month(make_timestamp(ts*1000000))::integer end as month from t")
def header_period(spark, d):
    return hd.header_period(headers(spark, d), "content").select("o_orderkey", "year", "month")


# ---- joins on keys -------------------------------------------------------------------------------------------------


@query("jon_05_todo", "select doc_id from documents where doc_id not in (select doc_id from labels) and doc_id not in (select vec_id from embeddings where label=3) and doc_id not in (select item_id*5 from benchmark)")
def todo(spark, d):
    done = table(spark, d, "labels")
    failed = table(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("doc_id"))
    bad = table(spark, d, "benchmark").select((F.col("item_id") * 5).alias("doc_id"))
    return co.todo(table(spark, d, "documents").select("doc_id"), "doc_id", done, failed, bad)


@query("jon_06_enrich", "select v.vec_id as doc_id, d.lang, d.source, d.n_chars from embeddings v left join documents d on v.vec_id=d.doc_id")
def enrich(spark, d):
    return co.enrich(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), table(spark, d, "documents"), "doc_id", ["lang", "source", "n_chars"])


@query("jon_13_split", sql(SAMPLES, "select sample_id, period, case when period<=8 then 'train' else 'eval' end as split from smp where period<=11"))
def split(spark, d):
    df = samples(spark, d).select("sample_id", "period")
    return co.union_all(co.split(df, list(range(1, 9))).withColumn("split", F.lit("train")), co.split(df, [9, 10, 11]).withColumn("split", F.lit("eval")))


@query("jon_16_diff_registry", "with b as (select p_partkey, p_brand as type, p_retailprice as weight from part where p_size<=40), c as (select p_partkey, case when p_partkey%6=0 then 'new' else p_brand end as type, "
       "case when p_partkey%10=0 then 0 else p_retailprice end as weight from part where p_size>10) select coalesce(b.p_partkey,c.p_partkey) as p_partkey, case when c.p_partkey is null then 'missing' when b.p_partkey is null then 'extra' else 'changed' end as kind, "
       "case when b.p_partkey is null or c.p_partkey is null then '' else concat_ws(',', case when b.type<>c.type then 'type' end, case when b.weight<>c.weight then 'weight' end) end as changed "
       "from b full join c using (p_partkey) where b.p_partkey is null or c.p_partkey is null or b.type<>c.type or b.weight<>c.weight")
def diff_registry(spark, d):
    p = table(spark, d, "part")
    base = p.where("p_size <= 40").select("p_partkey", F.col("p_brand").alias("type"), F.col("p_retailprice").alias("weight"))
    cand = p.where("p_size > 10").select("p_partkey", F.when(F.col("p_partkey") % 6 == 0, "new").otherwise(F.col("p_brand")).alias("type"),
                                         F.when(F.col("p_partkey") % 10 == 0, F.lit(0.0)).otherwise(F.col("p_retailprice")).alias("weight"))
    return co.diff_registry(base, cand, "p_partkey", ["type", "weight"])


@query("jon_17_check_dims", "with p as (select source as view, doc_id%3 as period, case when source='src1' then 10+doc_id%2 when source='src3' then 5 else 20 end as width from documents where source<>'src2'), "
       "x as (select distinct source as view, 20 as width, 8 as lower from documents), g as (select view, count(distinct width) k, min(width) lo, max(width) hi from p group by 1) "
       "select view, case when k is null then 'missing' when k>1 then 'inconsistent' when hi<>width then 'unexpected' when lo<lower then 'too_small' end as problem, lo as got_min, hi as got_max "
       "from x full join g using (view) where k is null or k>1 or hi<>width or lo<lower")
def check_dims(spark, d):
    docs = table(spark, d, "documents")
    width = F.when(F.col("source") == "src1", F.col("doc_id") % 2 + 10).when(F.col("source") == "src3", 5).otherwise(20).cast("bigint")
    produced = docs.where("source <> 'src2'").select(F.col("source").alias("view"), (F.col("doc_id") % 3).alias("period"), width.alias("width"))
    expected = docs.select(F.col("source").alias("view")).distinct().select("view", F.lit(20).alias("width"), F.lit(8).alias("lower"))
    return co.check_dims(produced, expected)


# ---- aggregates ----------------------------------------------------------------------------------------------------


@query("agg_01_dedup_content", sql(SAMPLES, "select sha256, path, sample_id, (count(*) over (partition by sha256)-1) as duplicates from smp qualify row_number() over (partition by sha256 order by path)=1"))
def dedup_content(spark, d):
    return co.dedup_content(samples(spark, d)).select("sha256", "path", "sample_id", "duplicates")


@query("agg_02_contingency", sql(SAMPLES, "select period, count(*) as n, count(*) filter (label=1) as malware, count(*) filter (label=0) as benign, count(*) filter (label<0) as unknown, "
       "round(coalesce(count(*) filter (label=1)::double/nullif(count(*) filter (label>=0),0),0),6) as malware_ratio, (count(*) filter (label=1)=0 or count(*) filter (label=0)=0) as class_is_zero from smp group by 1"))
def contingency(spark, d):
    return rounded(co.contingency(samples(spark, d)), "malware_ratio")


@query("agg_02_split_totals", sql(SAMPLES, "select case when period<=8 then 'train' else 'eval' end as split, count(*) filter (label=1) as malware, count(*) filter (label=0) as benign, "
       "(count(*) filter (label=1)=0 or count(*) filter (label=0)=0) as class_is_zero from smp group by 1"))
def split_totals(spark, d):
    return co.split_totals(samples(spark, d), list(range(1, 9)), list(range(9, 13)))


@query("agg_03_summary", sql(SAMPLES, "select count(*) as n, count(*) filter (label=1) as malware, count(*) filter (label=0) as benign, count(distinct family) as n_families, round(count(*) filter (label=1)::double/count(*),4) as malware_ratio from smp"))
def summary(spark, d):
    return co.summary(samples(spark, d))


@query("agg_04_validate", sql(SAMPLES, "a as (select count(*) n, count(*) filter (label not in (0,1)) b, count(*) filter (label=1) m, count(distinct period) p, min(period) f from smp)",
       "select 'not_empty' as check, n>0 as ok, n as detail from a union all select 'labels_binary', b=0, b from a union all select 'class_share', m::double/n>0.01 and m::double/n<0.99, m from a "
       "union all select 'two_periods', p>=2, p from a union all select 'positive_periods', f>0, f from a union all select 'not_all_zero', true, 0 from a"))
def validate(spark, d):
    return co.validate(samples(spark, d))


@query("agg_04_validate_vectors", "with e as (select vec_id, label%2 as label, (vec_id%6+1)::integer as period, len(list_filter(embedding, lambda x: x<>0))=0 as z from embeddings), a as (select count(*) n, count(*) filter (label not in (0,1)) b, count(*) filter (label=1) m, count(distinct period) p, min(period) f, count(*) filter (z) z, "
       "count(*) filter (period in (1,2)) t, count(*) filter (period in (6,9)) v from e) select 'not_empty' as check, n>0 as ok, n as detail from a union all select 'labels_binary', b=0, b from a union all select 'class_share', m::double/n>0.01 and m::double/n<0.99, m from a "
       "union all select 'two_periods', p>=2, p from a union all select 'positive_periods', f>0, f from a union all select 'not_all_zero', z<n, z from a union all select 'train_periods', t>0, t from a union all select 'eval_periods', v>0, v from a union all select 'offsets_total', true, n from a")
def validate_vectors(spark, d):
    own = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).alias("label"), (F.col("vec_id") % 6 + 1).cast("int").alias("period"), "embedding")
    return co.validate(own, "embedding", [1, 2], [6, 9], co.period_offsets(own))


@query("agg_05_coverage", "with e as (select count(*) n, count(*) filter (vec_id%5<>0) s, count(*) filter (vec_id%7<>0) i from embeddings), v as (select 'V_byte' as view, n as present, n from e union all select 'V_struct', s, n from e union all select 'V_import', i, n from e union all select 'V_ghost', 0, n from e) "
       "select view, present, n, round(present::double/n,6) as coverage, case when present=0 then 'downgrade' when present<n then 'fail' else 'pass' end as gate from v")
def coverage(spark, d):
    return rounded(co.coverage(partial_views(spark, d), ["V_byte", "V_struct", "V_import", "V_ghost"]), "coverage")


# ---- period assignment ---------------------------------------------------------------------------------------------


@query("win_01_assign_periods", "with s as (select greatest(least(count(distinct date_trunc('month', o_orderdate)),18),6) as n, count(*) as t from orders), r as (select o_orderkey, row_number() over (order by date_trunc('month', o_orderdate), o_orderkey)-1 as r from orders) "
       "select o_orderkey, least(r//(t//n)+1, n)::integer as period from r, s")
def assign_periods(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("appeared"))
    month = F.substring("appeared", 1, 4).cast("int") * 12 + F.substring("appeared", 6, 2).cast("int")
    return co.assign_periods(o, "appeared", [month], "o_orderkey").select("o_orderkey", "period")


@query("win_02_split_periods", "with r as (select o_orderkey, (o_orderkey%5=0)::integer as side, row_number() over (partition by o_orderkey%5=0 order by o_orderkey)-1 as r, count(*) over (partition by o_orderkey%5=0) as t from orders) "
       "select o_orderkey, case when side=0 then least(r//(t//13)+1,13)::integer else (13+least(r//(t//3)+1,3))::integer end as period from r")
def split_periods(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5 == 0).cast("int").alias("side"))
    return co.assign_split_periods(o, "side", "o_orderkey").select("o_orderkey", "period")


@query("win_03_round_robin", "select o_orderkey, ((row_number() over (partition by year(o_orderdate) order by md5(o_orderkey||':42'), o_orderkey)-1)%12+1)::integer as period from orders")
def round_robin(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return co.round_robin(o, ["year"], "o_orderkey").select("o_orderkey", "period")


@query("win_04_assign_grouped", sql(BALANCED, "g as (select label, group_key, (row_number() over (partition by label order by md5(group_key||':42'), group_key)-1)%12+1 as p from (select distinct label, group_key from bal))",
       "select sample_id, g.p::integer as period from bal join g using (label, group_key)"))
def assign_grouped(spark, d):
    return co.assign_grouped(balanced_samples(spark, d), "label", "group_key").select("sample_id", "period")


@query("win_05_assign_balanced", sql(BALANCED, "g as (select label, group_key, row_number() over (partition by label order by count(*) desc, md5(group_key||':42'), group_key)-1 as r from bal group by 1,2)",
       "select sample_id, (case when r%24<12 then r%24+1 else 24-r%24 end)::integer as period from bal join g using (label, group_key)"))
def assign_balanced(spark, d):
    return co.assign_balanced(balanced_samples(spark, d), "label", "group_key").select("sample_id", "period")


# g: malware handed out, u: rows handed out after m periods; both follow from the wanted running sums, bounded by what exists
RAMP = ("q as (select 0 as m, 0::bigint as g, 0::bigint as u, n, mal from c union all select m+1, g2, u+(g2-g)+least(want-(g2-g), n-mal-(u-g)), n, mal from "
        "(select *, least(mal, g+want, greatest(g+greatest(0, want-(n-mal-(u-g))), least(g+floor(want*share)::bigint, mal)))::bigint as g2 from "
        "(select *, case when m<11 then n//12 else n-m*(n//12) end as want, 0.15::double+0.7::double*m/11 as share from q where m<12)))")


@query("win_06_assign_ramp", "with recursive " + BALANCED + ", c as (select count(*)::bigint as n, sum(label)::bigint as mal from bal), " + RAMP +
       ", r as (select m, g-lag(g) over (order by m) as malware, u-lag(u) over (order by m) as n, max(mal) over ()-max(g) over () as more, max(n) over ()-max(u) over () as rest from q) "
       "select m::integer as period, (malware+case when m=1 then more else 0 end)::bigint as malware, (n+case when m=1 then rest else 0 end)::bigint as n from r where m>0")
def assign_ramp(spark, d):
    return co.assign_ramp(balanced_samples(spark, d), "label", "sample_id").groupBy("period").agg(F.sum("label").alias("malware"), F.count(F.lit(1)).alias("n"))


@query("win_07_sample_by_period", sql(BALANCED, "select sample_id, period, label from bal qualify row_number() over (partition by period, label order by md5(sample_id||':42'), sample_id)<=20"))
def sample_by_period(spark, d):
    return co.sample_by_period(balanced_samples(spark, d), 20, "sample_id").select("sample_id", "period", "label")


@query("win_07_balance", sql(BALANCED, "r as (select sample_id, label, row_number() over (partition by label order by md5(sample_id||':42'), sample_id) as r from bal)",
       "select sample_id, label from r where r<=(select min(c) from (select count(*) c from bal group by label))"))
def balance(spark, d):
    return co.balance(balanced_samples(spark, d), "sample_id").select("sample_id", "label")


@query("win_08_train_eval_months", "with m as (select distinct strftime(o_orderdate,'%Y-%m') as appeared from orders), r as (select appeared, dense_rank() over (order by appeared) as p, count(*) over () as n from m) "
       "select appeared, p::integer as period, case when p<=greatest(2,2*n//3) then 'train' else 'eval' end as split from r")
def train_eval_months(spark, d):
    return co.train_eval_months(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("appeared")), "appeared")


@query("win_09_period_offsets", sql(SAMPLES, "select period, (coalesce(sum(count(*)) over (order by period rows between unbounded preceding and 1 preceding),0))::bigint as start, count(*) as count from smp group by 1"))
def period_offsets(spark, d):
    return co.period_offsets(samples(spark, d))


@query("win_09_sortedness", sql(SAMPLES, "x as (select period < max(period) over (order by sample_id rows between unbounded preceding and 1 preceding) as down from smp)", "select count(*) filter (down) as descents, count(*) filter (down)=0 as is_sorted from x"))
def sortedness(spark, d):
    return co.sortedness(samples(spark, d), "sample_id")


# ---- sorts and sets ------------------------------------------------------------------------------------------------


@query("srt_01_sort_periods", sql(SAMPLES, "select period, sample_id, path from smp order by period, sample_id"))
def sort_periods(spark, d):
    return co.sort_periods(samples(spark, d).select("period", "sample_id", "path"), "sample_id")


@query("srt_02_top_n", "select source, count(*) as n from documents group by 1 order by n desc, source limit 10")
def top_n(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return co.top_n(g, 10, F.desc("n"), F.asc("source"))


@query("srt_03_subsample", "select doc_id from documents order by md5(doc_id||':42'), doc_id limit 100")
def subsample(spark, d):
    return co.subsample(table(spark, d, "documents").select("doc_id"), 100, "doc_id")


@query("srt_03_first_rows", "select doc_id, lang from documents order by doc_id limit 100")
def first_rows(spark, d):
    return co.first_rows(table(spark, d, "documents").select("doc_id", "lang"), 100, "doc_id")


@query("set_01_union_all", "select doc_id as id, lang, null::bigint as turn from documents union all select conv_id, null, turn from conversations")
def union_all(spark, d):
    return co.union_all(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "turn"))


@query("set_02_common_views", "with p as (select distinct source as view, doc_id%12+1 as period from documents where not (source in ('src1','src4') and doc_id%12=3)) select view, count(*) as periods, count(*)=(select count(distinct period) from p) as common from p group by 1")
def common_views(spark, d):
    f = table(spark, d, "documents").select(F.col("source").alias("view"), (F.col("doc_id") % 12 + 1).alias("period"))
    return co.common_views(f.where("not (view in ('src1','src4') and period = 4)"))


@query("set_03_partition_models", "select p_name||p_partkey as model, p_brand as view, case when p_brand not in (select p_brand from part where p_size>49) then 'frozen' when p_partkey%9=0 then 'skipped' when p_partkey%10=1 then 'passthrough' else 'trainable' end as role from part")
def partition_models(spark, d):
    p = table(spark, d, "part")
    models = p.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("model"), F.col("p_brand").alias("view"), "p_partkey")
    views = p.where("p_size > 49").select(F.col("p_brand").alias("view"))
    # include and exclude lists are short; the special members are marked by name
    skip = models.where("p_partkey % 9 = 0").select("model")
    roles = co.partition_models(models, views)
    listed = roles.join(skip.withColumn("__skip", F.lit(True)), "model", "left")
    role = F.when(F.col("role") == "frozen", "frozen").when(F.col("__skip"), "skipped").when(F.col("p_partkey") % 10 == 1, "passthrough").otherwise(F.col("role"))
    return listed.select("model", "view", role.alias("role"))


@query("set_04_set_diff", "select coalesce(a.p_brand,b.p_brand) as p_brand, case when b.p_brand is null then 'missing' when a.p_brand is null then 'extra' else 'both' end as side from (select distinct p_brand from part where p_size%7=0) a full join (select distinct p_brand from part where p_partkey%41=0) b using (p_brand)")
def set_diff(spark, d):
    p = table(spark, d, "part")
    return co.set_diff(p.where("p_size % 7 = 0"), p.where("p_partkey % 41 = 0"), "p_brand")
