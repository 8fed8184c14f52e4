"""Streaming operators fed from the driver tables; each is compared with its batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quorate import schemas
from quorate.plans.bindings import SIGS, signatures, sql, table
from quorate.plans.registry import query
from quorate.session import reliable_table, shared_dir
from quorate.streaming import streams as sr

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def events(spark, d):
    return sr.stream_samples(spark, f"{d}/events*.parquet", schemas.EVENTS)


@query("str_01_gated_samples", "select event_id, event_type from events where value>5")
def gated_samples(spark, d):
    s = sr.stream_samples(spark, f"{d}/events*.parquet", schemas.EVENTS, F.col("value") > 5)
    return sr.run_available(s.select("event_id", "event_type"))[0]


@query("str_02_dedup", "select distinct md5(user_id||':'||event_type) as digest from events")
def dedup(spark, d):
    s = sr.with_event_time(events(spark, d), "ts", "60 days").select("ts", F.md5(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").cast("binary")).alias("digest"))
    return sr.run_available(sr.stream_dedup(s, "digest").select("digest"))[0]


@query("str_03_match", sql(SIGS, "select dg.sample_id, sig.size as sig_size from dg join sig on dg.sha256=sig.digest where sig.size is null or sig.size=dg.size"))
def match(spark, d):
    s = sr.stream_samples(spark, f"{d}/documents*.parquet", DOCS)
    s = s.select(F.col("doc_id").alias("sample_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size"))
    return sr.run_available(sr.stream_match(s, signatures(spark, d)).select("sample_id", "sig_size"))[0]


@query("str_04_counters", "select cast(ts as date)::varchar as day, count(*) as n, count(*) filter (event_type='error') as errors, count(*) filter (value>10) as high from events group by 1")
def counters(spark, d):
    s = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    c = sr.stream_counters(s, "ts", {"errors": F.col("event_type") == "error", "high": F.col("value") > 10})
    out = sr.run_available(c.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "errors", "high"), "complete")[0]
    return out


STATS = ("with e as (select cast(ts as date) - o::integer as start, value from events, range({n}) t(o)), g as (select start, count(*) as n, avg(value) as mean, stddev_pop(value) as sd from e group by 1) "
         "select start::varchar as start, n, round(mean,6) as mean, round(sd,6) as sd from g")


@query("str_05_tumbling_stats", STATS.format(n=1))
def tumbling(spark, d):
    return _stats(spark, d, "1 day", None)


@query("str_05_sliding_stats", STATS.format(n=5))
def sliding(spark, d):
    return _stats(spark, d, "5 days", "1 day")


def _stats(spark, d, size, slide):
    marked, close = sr.with_close(events(spark, d), "ts", "1 day")
    s = sr.stream_stats(marked, "ts", "value", size, slide)
    return sr.run_closed(s.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd")), close)[0]


@query("str_06_detect", "with recursive g as (select event_type as level, cast(ts as date)::varchar as day, (avg(value)-10)*3 as z from events group by 1,2), r as (select *, row_number() over (partition by level order by day) as rn from g), "
       "c as (select level, rn, day, greatest(0,greatest(z,0)-0.7::double) as s, z as mu from r where rn=1 union all select r.level, r.rn, r.day, greatest(0,c.s+greatest(r.z,0)-0.7::double), 0.9::double*c.mu+0.1::double*r.z from c join r on r.level=c.level and r.rn=c.rn+1) "
       "select level, day, round(s,6)::double as cusum, round(mu,6) as ema from c")
def detect(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("level"), F.to_date("ts").cast("string").alias("day")).agg(((F.avg("value") - 10) * 3).alias("z"))
    t = reliable_table(g)
    s = sr.stream_samples(spark, t.inputFiles()[0].rsplit("/", 1)[0], "level string, day string, z double")
    out = sr.run_available(sr.stream_detect(s, "level", "day", "z", 0.7))[0]
    return out.select("level", "day", (F.round("cusum", 6) + 0).alias("cusum"), F.round("ema", 6).alias("ema"))


@query("str_06_monitor", "with recursive g as (select event_type as level, date_trunc('day', ts) as day, (avg(value)-10)*3 as z, avg(value)/100 as gain, avg(value) as d from events group by 1,2), r as (select *, row_number() over (partition by level order by day) as rn from g), "
       "c as (select level, rn, day, greatest(0,greatest(z,0)-0.3::double) as s, gain as acc, case when greatest(0,greatest(z,0)-0.3::double)>0.5 then []::double[] else [d] end as ring from r where rn=1 "
       "union all select r.level, r.rn, r.day, v.s, c.acc+r.gain, case when v.s>0.5 then c.ring when len(c.ring)>=5 then list_append(c.ring[2:5], r.d) else list_append(c.ring, r.d) end "
       "from c join r on r.level=c.level and r.rn=c.rn+1, lateral (select greatest(0,(case when c.s>0.5 then c.s else 0 end)+greatest(r.z,0)-0.3::double) as s) v) "
       "select level, strftime(day, '%Y-%m-%d') as day, round(s,6)::double as cusum, round(acc,6) as accumulated, round(list_avg(ring),6) as mu, round(case when len(ring)>1 then list_stddev_samp(ring) end,6) as sigma, s>0.5 as in_drift from c")
def monitor(spark, d):
    """Days arrive in shuffled files; timers put them in order."""
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("level"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg(
        ((F.avg("value") - 10) * 3).alias("z"), (F.avg("value") / 100).alias("gain"), F.avg("value").alias("d"))
    t = reliable_table(g.repartition(4, F.xxhash64("day", F.lit(3))))
    s = sr.stream_samples(spark, t.inputFiles()[0].rsplit("/", 1)[0], "level string, day timestamp, z double, gain double, d double", files_per_batch=1)
    marked, close = sr.with_close(s, "day", "40 days")
    out = sr.with_state_store(spark, sr.run_closed, sr.stream_monitor(marked, "level", "day", "z", "gain", "d", 0.3, 0.5, 5), close)[0]
    rounded = [(F.round(c, 6) + 0).alias(c) for c in ("cusum", "accumulated", "mu", "sigma")]
    return out.select("level", F.date_format("day", "yyyy-MM-dd").alias("day"), *rounded, "in_drift")


@query("str_07_late_rows", "with e as (select event_id, ts, ((extract(day from ts)-1)//4 + event_id%3)::bigint as b from events), m as (select b, max(ts) as latest from e group by b), "
       "w as (select b, max(latest) over (order by b rows between unbounded preceding and 1 preceding) - interval 5 day as mark from m) "
       "select event_id, b-(select min(b) from e) as batch from e join w using (b) where ts < mark")
def late_rows(spark, d):
    """Every third event arrives four days late and every third eight; five days are allowed."""
    own = table(spark, d, "events").select("event_id", "ts", (F.floor((F.dayofmonth("ts") - 1) / 4) + F.col("event_id") % 3).alias("arrival"))
    base = f"{shared_dir(spark).rstrip('/')}/arrivals-{uuid.uuid4().hex}"
    for (part,) in sorted(own.select("arrival").distinct().collect()):  # a handful of arrivals, written one after the other
        own.where(F.col("arrival") == part).select("event_id", "ts").coalesce(1).write.mode("append").parquet(base)
    s = sr.stream_samples(spark, base, own.select("event_id", "ts").schema, files_per_batch=1)
    return sr.route_late(s, "ts", "5 days")[1].select("event_id", "batch")
