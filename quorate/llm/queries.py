"""The registered query of each operator: name -> callable(spark, folder), and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm import collocations, decontamination, hard_negatives, html_extract, licenses, near_dup, packing, pii, quality_classifier, quality_rules, suffix_dedup, toxicity, vector_links
from quorate.llm.common import remainder, table


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, folder, "labels"), ~held)
    return toxicity.score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "n_passages", "passage_start", "passage_end")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.report(table(spark, folder, "documents")).drop("host_ok")


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    shelf = F.floor(F.col("doc_id") / 64).cast("string")
    files = docs.select("doc_id", "text", F.concat(F.concat_ws("/", "source", "lang", shelf, F.col("doc_id").cast("string")), F.lit(".txt")).alias("path"))
    found = licenses.scan(files)
    return found.withColumn("doc_id", F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), width=3, percent=85)


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.report(docs, pii.fit(docs))


def op7_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, folder, "documents"))


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = quality_classifier.fit(docs, table(spark, folder, "labels"), ~held)
    return quality_classifier.score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op11_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_links.links(table(spark, folder, "embeddings"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", flipped), F.col("vec_id") % 100 == 0)


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_license_scan": op2_license_scan, "op3_decontamination": op3_decontamination, "op4_quality_rules": op4_quality_rules, "op5_near_dup": op5_near_dup, "op6_pii": op6_pii, "op7_html_extract": op7_html_extract, "op8_packing": op8_packing, "op9_quality_classifier": op9_quality_classifier, "op10_suffix_dedup": op10_suffix_dedup,
           "op11_embedding_dedup": op11_embedding_dedup, "op12_hard_negatives": op12_hard_negatives, "op13_collocations": op13_collocations}

SQL: dict[str, str] = {}

SQL["op4_quality_rules"] = r"""
with d as (select doc_id, source, coalesce(text, '') as text, row_number() over (order by doc_id) as r from documents),
w as (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
g as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as gram
      from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
t as (select r, i from (select r, i, count(*) over (partition by r, gram) as c from g) where c > 1),
p as (select r, count(distinct i + o) as n from (select r, i, unnest([0, 1, 2]) as o from t) group by r),
s as (select d.r, d.doc_id, d.source, len(w.ws)::bigint as n_words,
        length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
        length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        (len(list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
         - len(list_distinct(list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::bigint as n_dup_lines,
        coalesce(p.n, 0)::bigint as n_repeat_words
      from d join w using (r) left join p using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s),
h as (select source, count(*)::double as n, sum(case when base_failed then 1 else 0 end)::double as f from b group by source),
m as (select sum(f) / sum(n) as m, sum(n) as n, count(*) - 1 as free, sum(n * n) as n2,
        sum(f * f / n) - sum(f) / sum(n) * sum(f) as spread from h),
c as (select m, greatest(0.0001, least(0.9999, case when m * (1 - m) * (n - n2 / n - free) > 0
        then (spread - m * (1 - m) * free) / (m * (1 - m) * (n - n2 / n - free)) else 0.0001 end)) as r from m),
v as (select source, (f + m * (1 - r) / r) / (n + (1 - r) / r) <= 0.5 as host_ok from h, c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed) and host_ok as kept
from b join v on b.source is not distinct from v.source
"""

SQL["op5_near_dup"] = r"""
with recursive d as (select row_number() over (order by doc_id) as r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, case when len(ws) < 3 then array_to_string(ws, ' ') else ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] end as g
      from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
rare as (select g from s group by g having count(*) > 1),
k as (select a.doc_id as a, b.doc_id as b, count(*) as m
      from (select * from s semi join rare using (g)) a join (select * from s semi join rare using (g)) b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from k join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k.m >= 85 * (x.n + y.n - k.m)),
u as (select a as x, b as y from e union select b, a from e),
c(x, y) as (select doc_id, doc_id from d union select c.x, u.y from c join u on c.y = u.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.low as component_id, d.doc_id = m.low as kept
from d left join n using (doc_id) join (select x, min(y) as low from c group by x) m on m.x = d.doc_id
"""

SQL["op10_suffix_dedup"] = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as k from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as i from d where length(h) >= 200)),
t as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as n from w) where n > 1),
e as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as new from t),
g as (select doc_id, i, sum(new) over (partition by doc_id order by i) as s from e),
r as (select doc_id, s, min(i) as a, max(i) + 100 as b from g group by doc_id, s),
q as (select doc_id, s, a, b, coalesce(lag(b) over (partition by doc_id order by s), 0) as before from r),
k as (select doc_id, count(*) as n, sum(b - a) as m, max(b) as last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by s) as head
      from q join d using (doc_id) group by doc_id)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(m, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans,
  sha256(unhex(case when n is null then h else head || substr(h, 2 * last + 1) end)) as kept_sha256
from d left join k using (doc_id)
"""

SQL["op11_embedding_dedup"] = r"""
with recursive v as (select vec_id, embedding::double[] as e, len(embedding) as d, embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok from embeddings),
u as (select a.vec_id as x, b.vec_id as y from v a join v b on a.ok and b.ok and a.d = b.d and a.vec_id <> b.vec_id
      where list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.9),
c(x, y) as (select vec_id, vec_id from v union select c.x, u.y from c join u on c.y = u.x),
n as (select x, count(*) as n from u group by x)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, m.low as component_id, v.vec_id = m.low as kept
from v left join n on n.x = v.vec_id join (select x, min(y) as low from c group by x) m on m.x = v.vec_id
"""

SQL["op12_hard_negatives"] = r"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
      from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, list_inner_product(a.q, b.q)::bigint as score
      from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, own, vec_id as positive_id, score as positive_score from s where label = own
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
t as (select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)::int as rank, s.vec_id as negative_id, positive_score, s.score as negative_score
      from p join s on s.anchor_id = p.anchor_id and s.label <> p.own and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score)
select * from t where rank <= 5
"""

SQL["op13_collocations"] = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
g as (select lang, k as words, array_to_string(ws[i:i + k - 1], ' ') as phrase
      from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (select unnest([1, 2, 3, 4]) as k) where len(ws) >= k)),
f as (select lang, words, phrase, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where words = 1 group by lang),
q as (select lang, words, phrase, string_split(phrase, ' ') as ws, f as a from f where words > 1 and f >= 30),
c as (select lang, phrase, words, a, k, array_to_string(ws[1:k], ' ') as p1, array_to_string(ws[k + 1:words], ' ') as p2
      from (select *, unnest(range(1, words)) as k from q)),
s as (select c.lang, c.phrase, c.a, k, x.f as l, y.f as r, (2000000::hugeint * c.a // (x.f + y.f))::bigint as score
      from c join f x on x.lang = c.lang and x.phrase = c.p1 join f y on y.lang = c.lang and y.phrase = c.p2),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
e as (select lang, phrase, max(a) as longer from (
        select lang, array_to_string(ws[1:words - 1], ' ') as phrase, a from q union all select lang, array_to_string(ws[2:words], ' '), a from q) group by all),
t as (select b.*, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank
      from b left join e using (lang, phrase) where e.longer is null or 100 * e.longer < 80 * a)
select lang, rank::int as rank, phrase, a, l, r, n.n, score from t join n using (lang) where rank <= 2000
"""
