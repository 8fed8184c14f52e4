"""Logical tables over the driver's parquet files, once as DataFrames and once as SQL text for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.operators.scores import ModelDims

# Eight scoring models, their view and level.
DIMS = ModelDims([
    ("V_byte", "surface"), ("V_byte", "surface"), ("V_byte", "surface"), ("V_string", "surface"),
    ("V_struct", "structure"), ("V_struct", "structure"), ("V_import", "structure"), ("V_all", "global"),
])
# Multipliers of the synthetic scores.
SCORE_P = [7919, 104729, 1299709, 15485863, 32452843, 49979687, 67867967, 86028121]
SCORE_Q = [31, 17, 13, 7, 5, 3, 11, 19]
TRAIN_PERIODS = [1, 2, 3, 4]
EVAL_PERIODS = [5, 6]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """One row per sample: (sample_id, grp, period, y, scores array<double>); an absent model is NULL."""
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    period = (F.floor((F.dayofmonth("ts") - 1).cast("double") / 5).cast("int") + 1)
    base = ev.select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("grp"), period.alias("period"),
                     F.when(F.col("event_type").isin("error", "purchase"), 1).otherwise(0).alias("y"))
    y = F.col("y").cast("double")
    cols = []
    for k in range(8):
        u = ((F.col("sample_id") * SCORE_P[k] + F.col("grp") * SCORE_Q[k]) % 1000).cast("double") / F.lit(999.0)
        s = u * 0.85 + y * 0.15
        if k in (4, 5, 6):
            s = F.when(F.col("period") >= 5, u * 0.85 + (F.lit(1.0) - y) * 0.15).otherwise(s)
        if k == 7:
            s = F.when(F.col("sample_id") % 11 != 0, s)
        cols.append(s)
    # generated as one column, so that later plans read it like a stored score array
    return base.select("sample_id", "grp", "period", "y", F.explode(F.array(F.array(*cols))).alias("scores"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, d, "labels").select("doc_id", "toxic")
    raw = F.col("text").cast("binary")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("sample_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.sha2(raw, 256).alias("sha256"), F.md5(raw).alias("md5"), F.octet_length("text").cast("bigint").alias("size"),
        F.coalesce(F.col("toxic"), F.lit(-1)).cast("int").alias("label"), F.col("source").alias("family"),
        F.concat_ws(":", "lang", "source").alias("group_key"), (F.col("doc_id") % 12 + 1).cast("int").alias("period"))


def balanced_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a two-class label (toxic, or text length parity where there is no label)."""
    docs = samples(spark, d)
    return docs.withColumn("label", F.when(F.col("label") >= 0, F.col("label")).otherwise((F.col("size") % 3 == 0).cast("int")))


def digests(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("sample_id"), F.sha2(raw, 256).alias("sha256"), F.md5(raw).alias("md5"),
        F.octet_length("text").cast("bigint").alias("size"))


def signatures(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    return (table(spark, d, "documents").where(F.col("doc_id") % 7 == 0)
            .groupBy(F.sha2(raw, 256).alias("digest"))
            .agg(F.min_by(F.when(F.col("doc_id") % 14 != 0, F.octet_length("text").cast("bigint")), "doc_id").alias("size")))


def md5_signatures(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    return (table(spark, d, "documents").where(F.col("doc_id") % 7 == 1).select(F.md5(raw).alias("digest"))
            .distinct().withColumn("size", F.lit(None).cast("bigint")))


def fuzzy_samples(spark: SparkSession, d: str) -> DataFrame:
    """Similarity keys of a whole document: its set of words, its set of long words, language plus length class."""
    words = F.array_sort(F.array_distinct(F.split(F.lower("text"), " ")))
    key = lambda w: F.md5(F.array_join(w, " ").cast("binary"))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("sample_id"), F.octet_length("text").cast("bigint").alias("size"),
        key(words).alias("words"), key(F.filter(words, lambda w: F.length(w) > 6)).alias("long_words"),
        F.md5(F.concat_ws(":", "lang", F.col("n_chars").cast("string")).cast("binary")).alias("shape"))


def fuzzy_signatures(spark: SparkSession, d: str) -> DataFrame:
    from quorate.operators.matching import first_signature
    base = fuzzy_samples(spark, d).where(F.col("sample_id") % 5 == 2)
    long = base.unpivot(["sample_id", "size"], ["words", "long_words", "shape"], "hash_type", "value")
    long = long.select("hash_type", "value", F.when(F.col("sample_id") % 10 == 2, F.lit(None)).otherwise(F.col("size")).alias("size"),
                       F.concat(F.lit("n"), F.col("sample_id").cast("string")).alias("name"), F.col("sample_id").alias("row_id"))
    return first_signature(long, ["hash_type", "value"], "row_id")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
        (F.col("label") % 2).cast("int").alias("y"), (F.col("vec_id") % 6 + 1).cast("int").alias("period"))


# Named feature ranges over the 64 vector entries and the views built from them.
RANGES = {"A": (0, 16), "B": (16, 32), "C": (32, 48), "D": (48, 64)}
VIEW_RANGES = {"V_byte": ["A"], "V_struct": ["B", "C"], "V_late": ["D", "missing"], "V_all": ["__ALL__"], "V_none": ["missing"]}


def contents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").cast("binary").alias("content"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.split(F.lower("text"), " ").alias("words"))
    return docs.select("sample_id", F.posexplode("words").alias("pos", "token")).where("token <> ''")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct call edges per graph: callers are suppliers, callees parts, spread over 50 graphs."""
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 50).cast("int").alias("graph"), F.col("l_suppkey").alias("src"),
        (F.col("l_partkey") % 100).alias("dst")).distinct()


def detections(spark: SparkSession, d: str) -> DataFrame:
    """Per day (period) the flag of four detectors: daily mean value above a fixed level."""
    day = F.to_date("ts")
    avg = table(spark, d, "events").groupBy(day.alias("day")).agg(F.avg("value").alias("m"), F.max("value").alias("hi"))
    return avg.select(F.col("day").cast("string").alias("period"), F.col("m"),
                      (F.col("m") > 9.9).alias("main"), (F.col("m") > 10.1).alias("d1"), (F.col("m") > 9.7).alias("d2"),
                      (F.col("hi") > 60.0).alias("d3"))


# ---- the same tables as SQL common table expressions -------------------------------------------------------------

def _score_sql(k: int) -> str:
    u = f"0.85::double*(cast((event_id*{SCORE_P[k]}+user_id*{SCORE_Q[k]})%1000 as double)/999::double)"
    s = f"({u} + y::double*0.15::double)"
    if k in (4, 5, 6):
        s = f"(case when period>=5 then {u} + (1::double-y)*0.15::double else {s} end)"
    if k == 7:
        s = f"(case when event_id%11<>0 then {s} end)"
    return f"{s} as s{k}"


W = ("w0 as (select event_id, user_id, cast(floor(cast(day(ts)-1 as double)/5) as integer)+1 as period, "
     "case when event_type in ('error','purchase') then 1 else 0 end as y from events), "
     "w as (select event_id as sample_id, user_id as grp, period, y, " + ", ".join(_score_sql(k) for k in range(8)) + " from w0)")
L = (W + ", l as (" + " union all ".join(f"select sample_id, grp, period, y, {k} as model_id, s{k} as score from w" for k in range(8)) + ")")
DIM = ("dim as (select * from (values " + ", ".join(f"({m},'{v}','{lv}')" for m, v, lv in DIMS.rows()) + ") t(model_id, view, level))")
SAMPLES = ("smp as (select d.doc_id as sample_id, d.source||'/'||d.doc_id as path, sha256(d.text) as sha256, md5(d.text) as md5, "
           "octet_length(encode(d.text))::bigint as size, coalesce(b.toxic,-1)::integer as label, d.source as family, "
           "d.lang||':'||d.source as group_key, (d.doc_id%12+1)::integer as period from documents d left join labels b using (doc_id))")
BALANCED = (SAMPLES + ", bal as (select * replace (case when label>=0 then label else (size%3=0)::integer end as label) from smp)")
DIGESTS = ("dg as (select doc_id as sample_id, sha256(text) as sha256, md5(text) as md5, octet_length(encode(text))::bigint as size from documents)")
SIGS = (DIGESTS + ", sig as (select sha256 as digest, arg_min(struct_pack(v := case when sample_id%14<>0 then size end), sample_id).v as size "
        "from dg where sample_id%7=0 group by 1), msig as (select distinct md5 as digest, null::bigint as size from dg where sample_id%7=1)")
FUZZY = ("fz as (select doc_id as sample_id, octet_length(encode(text))::bigint as size, md5(array_to_string(list_sort(list_distinct(string_split(lower(text),' '))),' ')) as words, "
         "md5(array_to_string(list_filter(list_sort(list_distinct(string_split(lower(text),' '))), lambda w: length(w)>6),' ')) as long_words, md5(lang||':'||n_chars) as shape from documents), "
         "fl as (select sample_id, size, 'words' as hash_type, words as value from fz union all select sample_id, size, 'long_words', long_words from fz "
         "union all select sample_id, size, 'shape', shape from fz), "
         "fs as (select hash_type, value, case when sample_id%10=2 then null else size end as size, 'n'||sample_id as name from fl "
         "where sample_id%5=2 qualify row_number() over (partition by hash_type, value order by sample_id)=1)")
VEC = ("vec as (select vec_id as sample_id, embedding::double[] as vec, (label%2)::integer as y, (vec_id%6+1)::integer as period from embeddings)")
VECL = VEC + ", vl as (select sample_id, y, period, unnest(vec) as x, generate_subscripts(vec,1)-1 as dim from vec)"
TOKENS = ("tok as (select * from (select doc_id as sample_id, unnest(string_split(lower(text),' ')) as token, "
          "generate_subscripts(string_split(lower(text),' '),1)-1 as pos from documents) where token<>'')")
BYTES = ("bt as (select doc_id as sample_id, ('0x'||unnest(regexp_extract_all(hex(encode(text)),'..')))::integer as b, "
         "generate_subscripts(regexp_extract_all(hex(encode(text)),'..'),1)-1 as pos from documents)")
EDGES = "e as (select distinct (l_orderkey%50)::integer as graph, l_suppkey as src, l_partkey%100 as dst from lineitem)"
DETECT = ("det as (select cast(ts as date)::varchar as period, avg(value) as m, max(value) as hi from events group by 1), "
          "dt as (select period, m, m>9.9 as main, m>10.1 as d1, m>9.7 as d2, hi>60 as d3 from det)")


def sql(*parts: str) -> str:
    """``with`` clause from table texts plus the final select (last argument)."""
    return "with " + ", ".join(parts[:-1]) + " " + parts[-1]
