"""Signature matching, verdicts and scan summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.operators import matching as mt
from quorate.operators import scores as sc
from quorate.plans.bindings import DIMS, FUZZY, L, SIGS, W, digests, fuzzy_samples, fuzzy_signatures, md5_signatures, scores, signatures, sql, table
from quorate.plans.registry import query
from quorate.plans.score import rounded

TYPES = ["words", "long_words", "shape"]
EXACT = sql(SIGS, "select dg.sample_id, sig.size as sig_size from dg join sig on dg.sha256=sig.digest where sig.size is null or sig.size=dg.size")
TIERED = (SIGS + ", " + FUZZY + ", t1 as (select distinct sample_id, 0 as tier, 0 as k, 'KnownMalware' as name, '' as hash_type from dg join sig on dg.sha256=sig.digest and (sig.size is null or sig.size=dg.size)), "
          "t2 as (select distinct sample_id, 1, 0, 'KnownMalware', '' from dg join msig on dg.md5=msig.digest), "
          "t3 as (select sample_id, 2, case hash_type when 'words' then 1 when 'long_words' then 2 else 3 end, fs.name, hash_type from fl join fs using (hash_type, value) where fs.size is null or fs.size=fl.size), "
          "hits as (select * from (select * from t1 union all select * from t2 union all select * from t3) qualify row_number() over (partition by sample_id order by tier, k)=1)")
SOURCE = "(['sha256_db','md5_db','fuzzy_db'])[tier+1]"


@query("jon_01_match_exact", EXACT)
def match_exact(spark, d):
    return mt.match_exact(digests(spark, d), signatures(spark, d), "sha256").select("sample_id", "sig_size")


@query("jon_01_known", sql(SIGS, "select sample_id from dg where exists (select 1 from sig where digest=sha256 and (sig.size is null or sig.size=dg.size))"))
def known(spark, d):
    return mt.known(digests(spark, d), signatures(spark, d), "sha256").select("sample_id")


@query("jon_02_match_with_bloom", EXACT)
def match_with_bloom(spark, d):
    return mt.match_exact(digests(spark, d), signatures(spark, d), "sha256").select("sample_id", "sig_size")


@query("jon_03_match_tiered", sql(TIERED, f"select sample_id, {SOURCE} as source, name, hash_type from hits"))
def match_tiered(spark, d):
    smp = digests(spark, d).join(fuzzy_samples(spark, d).drop("size"), "sample_id")
    return mt.match_tiered(smp, signatures(spark, d), md5_signatures(spark, d), fuzzy_signatures(spark, d), TYPES)


@query("jon_04_match_fuzzy", sql(FUZZY, "select sample_id, hash_type, value, fs.name from fl join fs using (hash_type, value) where fs.size is null or fs.size=fl.size"))
def match_fuzzy(spark, d):
    return mt.match_fuzzy(fuzzy_samples(spark, d), fuzzy_signatures(spark, d), TYPES)


@query("agg_20_signature_stats", sql(SIGS, "a as (select 'sha256' as algo, substr(digest,1,2) as shard from sig union all select 'md5', substr(digest,1,2) from msig)", "select algo, shard, count(*) as n from a group by rollup(algo, shard)"))
def signature_stats(spark, d):
    sha = signatures(spark, d).select(F.lit("sha256").alias("algo"), "digest")
    md5 = md5_signatures(spark, d).select(F.lit("md5").alias("algo"), "digest")
    return mt.signature_stats(sha.unionByName(md5))


VERDICT = (TIERED + ", " + L + ", en as (select sample_id, avg(score) as e from l where sample_id%50<>7 group by 1), vw as (select sample_id, sample_id%9=0 as is_drift, case when sample_id%9=0 then 'structural' else 'none' end as dt, case " +
           " ".join(f"when s{i}=greatest(s0,s1,s2,s3,s4,s5,s6,s7) then '{v}'" for i, v, _ in DIMS.rows()) + " end as view from w), "
           f"j as (select dg.sample_id, sha256, tier, name, {SOURCE} as source, e, coalesce(is_drift,false) as is_drift, dt, view, case when tier is not null then 1.0::double else e end as score, "
           "case when tier is not null or e>0.5 then 1 when tier is null and e is null then -1 when is_drift then 2 else 0 end as st from dg left join hits using (sample_id) left join en using (sample_id) left join vw using (sample_id)), "
           "vd as (select sample_id, coalesce(source,'ensemble') as source, round(score,6) as score, st::integer as status, case when tier is not null then name when st>0 then case when dt='structural' then 'GenKD' else "
           "case view when 'V_string' then 'Worm' when 'V_struct' then 'Trojan' when 'V_import' then 'Trojan' else 'Virus' end end||'.'||case view when 'V_byte' then 'ByS' when 'V_string' then 'Str' when 'V_struct' then 'PEs' when 'V_import' then 'Imp' else 'Ens' end||'.'||substr(sha256,1,8) else '' end as detection, "
           "case st when -1 then 'Error' when 0 then 'Benign' when 1 then 'Malicious' else 'DriftSuspect' end as status_label from j)")


@query("mlt_07_verdicts", sql(VERDICT, "select * from vd"))
def verdicts(spark, d):
    smp = digests(spark, d).join(fuzzy_samples(spark, d).drop("size"), "sample_id")
    hits = mt.match_tiered(smp, signatures(spark, d), md5_signatures(spark, d), fuzzy_signatures(spark, d), TYPES)
    s = sc.top_view(sc.ensemble(scores(spark, d), 8, name="score"), DIMS)
    drift = F.col("sample_id") % 9 == 0
    s = s.where("sample_id % 50 <> 7").select("sample_id", "score", drift.alias("is_drift"), F.when(drift, "structural").otherwise("none").alias("drift_type"), "view")
    return rounded(mt.verdicts(digests(spark, d), hits, s), "score")


@query("agg_19_scan_summary", "with v as (select event_id, case when event_id%37=0 then -1 when value>10 then 1 else 0 end as st, value as sec from events), t as (select sec, row_number() over (order by sec)-1 as r, count(*) over () as n from v where st<>-1 and sec>0) "
       "select count(*) as total, count(*) filter (st=1) as malicious, count(*) filter (st=0) as benign, count(*) filter (st=-1) as errors, min(sec) filter (st<>-1 and sec>0) as min_time, max(sec) filter (st<>-1 and sec>0) as max_time, "
       "round(avg(sec) filter (st<>-1 and sec>0),6) as avg_time, round(count(*)/sum(sec),6) as throughput, (select sec from t where r=n//2) as median_time from v")
def scan_summary(spark, d):
    v = table(spark, d, "events").select(F.when(F.col("event_id") % 37 == 0, -1).when(F.col("value") > 10, 1).otherwise(0).alias("status"), F.col("value").alias("sec"))
    return rounded(mt.scan_summary(v, "sec"), "avg_time", "throughput")
