"""Content, token, graph and region features; detection statistics and group shifts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.operators import content as ct
from quorate.operators import graph as gr
from quorate.operators import filetype as ft
from quorate.operators import vectoriser as vz
from quorate.plans.bindings import BYTES, EDGES, TOKENS, VEC, contents, edges, sql, table, tokens, vectors
from quorate.plans.registry import query
from quorate.plans.score import rounded


def nudged(df, name):
    """Six decimals with exact halves pushed up, so both engines round them alike."""
    return df.withColumn(name, F.round(F.col(name) + 1e-9, 6))


# texts and pages: markup anywhere, else ASCII by first sign and share of printable bytes, else UTF-8
TYPE_SQL = (r"with c as (select html as t from pages union all select text from documents), n as (select t, octet_length(encode(t)) as n, length(regexp_replace(t, '[^\x20-\x7e\x09\x0a\x0d]', '', 'g')) as p from c), "
            r"k as (select case when n=0 then 'ANY' when regexp_matches(t, '^(From:? |Received: |Return-Path: |Delivered-To: |Message-ID: |Subject: |X-Originating-IP: )') then 'MAIL' when"
            r"  regexp_matches(t, '(?i)<(html|head|script|iframe|img|object|table|a\s[^>]*href|!DOCTYPE|body)\b') then 'HTML' "
            r"when regexp_matches(t, '^[\x00-\x7f]') and p>n*0.9 then 'TEXT_ASCII' else 'TEXT_UTF8' end as type_code from n) "
            r"select type_code, case type_code when 'ANY' then 'other' when 'HTML' then 'document' when 'MAIL' then 'mail' else 'text' end as category, "
            r"case type_code when 'ANY' then 'empty' when 'HTML' then 'pattern' when 'MAIL' then 'magic' else 'text-detect' end as method, count(*) as n from k group by 1")


@query("prj_17_file_type", TYPE_SQL)
def file_type(spark, d):
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").cast("binary").alias("content"))
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").cast("binary").alias("content"))
    return ft.tag_file_type(pages.unionByName(docs), "content").groupBy("type_code", "category", "method").agg(F.count(F.lit(1)).alias("n"))


@query("prj_18_term_flags", "select doc_id as sample_id, " + ", ".join(f"contains(lower(text),'{t}')::integer as t{i}" for i, t in enumerate(ct.SENSITIVE_TERMS)) + " from documents")
def term_flags(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), *ct.term_flags(F.col("text")))


RULES = [("has_the", " the ", False), ("has_digit", "[0-9]{3}", True), ("has_mail", "[a-z]+@[a-z]+", True), ("has_key", "key", False), ("has_license", "license", False),
         ("has_url", "https?://", True), ("has_und", " und ", False)]


@query("prj_18_match_rules", "with r as (select doc_id as sample_id, list_filter([" + ", ".join(
    f"case when {'regexp_matches(text, ' + repr('(?i)' + p) + ')' if rx else 'contains(lower(text), ' + repr(p) + ')'} then '{n}' end" for n, p, rx in RULES) + "], lambda x: x is not null) as r from documents) "
    "select sample_id, array_to_string(r, ',') as rules, array_to_string(r[1:5], ',') as first_hits from r where len(r)>0")
def match_rules(spark, d):
    m = ct.match_rules(table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "text"), "sample_id", "text", RULES)
    return m.select("sample_id", F.array_join("rules", ",").alias("rules"), F.array_join("first_hits", ",").alias("first_hits"))


@query("agg_21_byte_histogram", sql(BYTES, "select sample_id, b as byte, count(*) as n, round(count(*)::double/sum(count(*)) over (partition by sample_id)+1e-9::double,6) as share from bt group by 1,2"))
def byte_histogram(spark, d):
    return nudged(ct.byte_histogram(contents(spark, d), "sample_id", "content"), "share")


_H = "(log2(sum(n))-sum(n*log2(n))/sum(n))"


@query("agg_22_entropy", sql(BYTES, "c as (select sample_id, b, count(*)::double as n, (count(*) filter (pos<1024))::double as nh, (count(*) filter (pos>=1024))::double as nt from bt group by 1,2)",
       "h as (select sample_id, log2(sum(n))-sum(n*log2(n))/sum(n) as whole, log2(sum(nh))-sum(case when nh>0 then nh*log2(nh) else 0 end)/sum(nh) as head, "
       "case when sum(nt)>0 then log2(sum(nt))-sum(case when nt>0 then nt*log2(nt) else 0 end)/sum(nt) else 0 end as tail from c group by 1)",
       "select doc_id as sample_id, round(coalesce(whole,0),6)+0 as whole, round(coalesce(head,0),6)+0 as head, round(coalesce(tail,0),6)+0 as tail from documents left join h on doc_id=sample_id"))
def entropy(spark, d):
    e = ct.entropy(contents(spark, d), "sample_id", "content")
    return e.select("sample_id", *[(F.round(c, 6) + 0).alias(c) for c in ("whole", "head", "tail")])


BLOCKS = ("sz as (select sample_id, count(*) as n from bt group by 1), bc as (select sample_id, case when n<1024 then 0 else pos//1024 end as block, b, count(*)::double as n from bt join sz using (sample_id) where n<1024 or pos//1024 < n//1024 group by 1,2,3), "
          "bh as (select sample_id, block, log2(sum(n))-sum(n*log2(n))/sum(n) as h from bc group by 1,2)")


@query("agg_23_block_entropy", sql(BYTES, BLOCKS, "select sample_id, count(*) as blocks, round(max(h),6)+0 as max_h, round(min(h),6)+0 as min_h, round(avg(h),6)+0 as mean_h, round(stddev_pop(h),5)+0 as std_h from bh group by 1"))
def block_entropy(spark, d):
    e = ct.block_entropy(contents(spark, d), "sample_id", "content")
    return e.select("sample_id", "blocks", *[(F.round(c, 6) + 0).alias(c) for c in ("max_h", "min_h", "mean_h")], (F.round("std_h", 5) + 0).alias("std_h"))


@query("agg_23_entropy_histogram", sql(BYTES, BLOCKS, "q as (select sample_id, least(floor((h+1e-12)/8*256),255)::integer as bin from bh)", "select sample_id, bin, count(*) as n, round(count(*)::double/sum(count(*)) over (partition by sample_id)+1e-9::double,6) as share from q group by 1,2"))
def entropy_histogram(spark, d):
    return nudged(ct.entropy_histogram(contents(spark, d), "sample_id", "content"), "share")


PAIRS = "pr as (select sample_id, b as a, lead(b) over (partition by sample_id order by pos) as b from bt), pc as (select sample_id, a, b, count(*) as n from pr where b is not null group by 1,2,3)"


@query("agg_24_transitions", sql(BYTES, PAIRS, "select sample_id, a, b, n from pc"))
def transitions(spark, d):
    return ct.transitions(contents(spark, d), "sample_id", "content")


@query("agg_24_folded_bigrams", sql(BYTES, PAIRS, "select sample_id, xor(a,b)::integer as cell, round(sum(n)::double/sum(sum(n)) over (partition by sample_id)+1e-9::double,6) as share from pc group by 1,2"))
def folded_bigrams(spark, d):
    return nudged(ct.folded_bigrams(contents(spark, d), "sample_id", "content"), "share")


@query("agg_24_row_entropy", sql(BYTES, PAIRS, f"select sample_id, a, round({_H.replace('n*log2(n)', 'n*log2(n::double)')},6)+0 as h from pc group by 1,2"))
def row_entropy(spark, d):
    e = ct.row_entropy(contents(spark, d), "sample_id", "content")
    return e.select("sample_id", "a", (F.round("h", 6) + 0).alias("h"))


@query("agg_25_string_stats", "with s as (select doc_id as sample_id, unnest(regexp_extract_all(text,'[\\x20-\\x7e]{4,}')) as s from documents), g as (select sample_id, count(*) as n_strings, avg(length(s)) as mean_len, max(length(s))::integer as max_len, stddev_pop(length(s)) as std_len, "
       "count(*) filter (contains(lower(s),'http') or contains(lower(s),'www')) as n_web, avg(starts_with(s,'http')::integer) as url_share, avg((contains(s,'/') or contains(s,chr(92)))::integer) as path_share, avg(contains(lower(s),'.dll')::integer) as dll_share, "
       "avg(contains(lower(s),'.exe')::integer) as exe_share, avg(regexp_matches(s,'[0-9]')::integer) as digit_share from s group by 1) "
       "select doc_id as sample_id, coalesce(n_strings,0) as n_strings, round(coalesce(mean_len,0),6) as mean_len, coalesce(max_len,0)::integer as max_len, round(coalesce(std_len,0),6) as std_len, coalesce(n_web,0) as n_web, round(coalesce(url_share,0),6) as url_share, "
       "round(coalesce(path_share,0),6) as path_share, round(coalesce(dll_share,0),6) as dll_share, round(coalesce(exe_share,0),6) as exe_share, round(coalesce(digit_share,0),6) as digit_share from documents left join g on sample_id=doc_id")
def string_stats(spark, d):
    return rounded(ct.string_stats(contents(spark, d), "sample_id", "content"), "mean_len", "std_len", "url_share", "path_share", "dll_share", "exe_share", "digit_share")


HASHED = "hb as (select sample_id, ('0x'||substr(md5(token),1,8))::bigint as h from tok)"


@query("agg_26_hashed_signed", sql(TOKENS, HASHED, "select sample_id, (h%64)::integer as bucket, sum(case when h>=2147483648 then 1 else -1 end)::double as value from hb group by 1,2"))
def hashed_signed(spark, d):
    return ct.hashed_features(tokens(spark, d), "sample_id", "token", 64)


@query("agg_26_hashed_counts", sql(TOKENS, HASHED, "c as (select sample_id, (h%256)::integer as bucket, ln(1+count(*)::double) as v from hb group by 1,2)", "select sample_id, bucket, round(v/(sqrt(sum(v*v) over (partition by sample_id))+1e-8::double),6) as value from c"))
def hashed_counts(spark, d):
    return rounded(ct.hashed_features(tokens(spark, d), "sample_id", "token", 256, signed=False), "value")


@query("agg_26_char_trigrams", "with g as (select item_id, unnest(list_transform(range(1, greatest(length(text)-1,1)::bigint), lambda i: substring(text, i::bigint, 3))) as token from benchmark), h as (select item_id, (('0x'||substr(md5(token),1,8))::bigint%256)::integer as bucket from g), "
       "c as (select item_id, bucket, ln(1+count(*)::double) as v from h group by 1,2) select item_id, bucket, round(v/(sqrt(sum(v*v) over (partition by item_id))+1e-8::double),6) as value from c")
def char_trigrams(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.explode(ct.text_ngrams(F.col("text"), 3)).alias("token"))
    return rounded(ct.hashed_features(t, "item_id", "token", 256, signed=False), "value")


CLASSES = {"article": ["the", "le", "la", "les", "der", "die", "das", "el", "los"], "joiner": ["and", "et", "und", "y"], "relation": ["of", "de", "von", "in", "on", "to"]}


@query("agg_27_category_share", sql(TOKENS, "c as (select sample_id, case " + " ".join(f"when token in ({', '.join(repr(w) for w in ws)}) then '{c}'" for c, ws in CLASSES.items()) + " else 'other' end as category from tok)",
       "select sample_id, category, count(*) as n, round(count(*)::double/sum(count(*)) over (partition by sample_id)+1e-9::double,6) as share from c group by 1,2"))
def category_share(spark, d):
    return nudged(ct.category_share(tokens(spark, d), "sample_id", "token", CLASSES), "share")


@query("agg_28_graph_stats", sql(EDGES, "n as (select graph, src as node from e union select graph, dst from e), o as (select graph, src as node, count(*) as od, max((src=dst)::integer) as lp from e group by 1,2), i as (select graph, dst as node, count(*) as id from e group by 1,2), "
       "d as (select graph, node, coalesce(od,0) as od, coalesce(id,0) as id, coalesce(lp,0) as lp from n left join o using (graph,node) left join i using (graph,node)), b as (select graph, count(*) filter (dst<=src) as be from e group by 1)",
       "select graph, count(*) as nodes, sum(od)::bigint as edges, round(sum(od)::double/count(*),6) as avg_degree, round(sum(od)::double/(count(*)*(count(*)-1)),6) as density, round((count(*) filter (od=0))::double/count(*),6) as leaf_share, sum(lp)::bigint as self_loops, "
       "any_value(be) as back_edges, max(od)::bigint as max_out, max(id)::bigint as max_in, round(stddev_pop(od),6) as std_out, count(*) filter (id>0) as callees from d join b using (graph) group by 1"))
def graph_stats(spark, d):
    return rounded(gr.graph_stats(edges(spark, d)), "avg_degree", "density", "leaf_share", "std_out")


FLOW = ("fn as (select l_orderkey as hash, row_number() over () as f, (l_quantity::integer)%6+1 as n, l_partkey%3 as k, l_suppkey%5 as m from lineitem), "
        "eg as (select hash, f, i as s, (i*k+1)%n as d from fn, range(0,6) t(i) where i<n union all select hash, f, i, (i+m)%n from fn, range(0,6,2) t(i) where i<n), "
        "rc as (select distinct hash, f, s, d from eg union select rc.hash, rc.f, rc.s, eg.d from rc join eg on eg.hash=rc.hash and eg.f=rc.f and eg.s=rc.d), "
        "cy as (select a.hash, a.f, a.s, min(a.d) as c from rc a join rc b on b.hash=a.hash and b.f=a.f and b.s=a.d and b.d=a.s group by 1,2,3), "
        "lp as (select hash, f, count(*) as loops, max(z) as largest from (select hash, f, c, count(*) as z from cy group by 1,2,3) group by 1,2), "
        "ec as (select hash, f, count(*) as e, count(*) filter (d<=s) as back from eg group by 1,2)")


@query("agg_28_flow_stats", "with recursive " + FLOW + " select hash::varchar as hash, sum(n)::bigint as blocks, sum(e)::bigint as block_edges, round(sum(e)::double/sum(n),6) as edges_per_block, max(n)::integer as max_blocks, round(avg(n),6) as mean_blocks, round(stddev_pop(n),6) as std_blocks, sum(back)::bigint as back_edges, count(*) as functions, "
       "round(sum(n)::double/count(*),6) as blocks_per_function, round(sum(e)::double/count(*),6) as edges_per_function, round(sum(back)::double/count(*),6) as back_per_function, count(*) filter (loops>0) as looping, sum(coalesce(loops,0))::bigint as loops, max(coalesce(largest,0))::integer as largest_loop "
       "from fn join ec using (hash, f) left join lp using (hash, f) group by 1")
def flow_stats(spark, d):
    """Every order is a sample, every line a function with one to six blocks."""
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("hash"), (F.col("l_quantity").cast("int") % 6 + 1).alias("n"), (F.col("l_partkey") % 3).alias("k"), (F.col("l_suppkey") % 5).alias("m"))
    i = F.sequence(F.lit(0).cast("bigint"), (F.col("n") - 1).cast("bigint"))
    even = F.filter(i, lambda x: x % 2 == 0)
    n = F.col("n").cast("bigint")
    ends = F.array(F.concat(i, even), F.concat(F.transform(i, lambda x: (x * F.col("k") + 1) % n), F.transform(even, lambda x: (x + F.col("m")) % n)))
    graphs = own.select("hash", F.struct(F.col("n").alias("block_number"), ends.alias("block_edges")).alias("f")).groupBy("hash").agg(F.collect_list("f").alias("acfg_list"))
    return rounded(gr.flow_stats(graphs), "edges_per_block", "mean_blocks", "std_blocks", "blocks_per_function", "edges_per_function", "back_per_function")


# no shortest path is longer than 12 calls in these tables; the walk itself has no limit
DEPTH = ("b as (select distinct graph, src as root, src as node, 0 as depth from e union select b.graph, b.root, e.dst, b.depth+1 from b join e on e.graph=b.graph and e.src=b.node where b.depth<12), "
         "n as (select graph, root, node, min(depth) as depth from b group by 1,2,3), r as (select graph, root, max(depth) as depth from n group by 1,2)")


@query("agg_29_graph_depth", "with recursive " + EDGES + ", " + DEPTH + " select graph, max(depth) as max_depth, round(avg(depth),6) as mean_depth from r group by 1")
def graph_depth(spark, d):
    return rounded(gr.graph_depth(edges(spark, d)), "mean_depth")


VOCAB = "vc as (select token, count(*) as c from tok group by 1 having count(*)>=2 order by c desc, token limit 500), vb as (select token, (row_number() over (order by c desc, token)+1)::integer as idx, c from vc)"


@query("agg_30_vocab", sql(TOKENS, VOCAB, "select token, idx, c as count from vb union all select '<unk>', 0, 0 union all select '<pad>', 1, 0"))
def vocab(spark, d):
    return ct.build_vocab(tokens(spark, d), "token", 500, 2)


@query("agg_30_encode", sql(TOKENS, VOCAB, "select sample_id, count(*) as n, count(*) filter (coalesce(idx,0)=0) as unknown, sum(coalesce(idx,0)*(pos%7+1))::bigint as checksum from tok left join vb using (token) group by 1"))
def encode(spark, d):
    t = tokens(spark, d)
    e = ct.encode(t, "token", ct.build_vocab(t, "token", 500, 2))
    return e.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("idx") == 0).cast("int")).alias("unknown"), F.sum(F.col("idx") * (F.col("pos") % 7 + 1)).cast("bigint").alias("checksum"))


@query("agg_31_vectorise", None)
def vectorise(spark, d):
    return vz.checksums(vz.vectorise(vz.records(table(spark, d, "documents"))))


SECTIONS = ("se as (select l_orderkey, l_linenumber as ord, 4+l_quantity/12 as entropy, case when l_suppkey%9=0 then 3758096384 else 1610612736 end as flags, l_linenumber*4096 as lo, l_linenumber*4096+4096 as hi from lineitem), "
            "im as (select o_orderkey as l_orderkey, o_custkey%60 as n_imports, (o_orderkey%7+1)*4096+100 as point from orders), "
            "lr as (select l_orderkey, arg_max(struct_pack(lo:=lo,hi:=hi), struct_pack(h:=hi,o:=-ord)) as r from se group by 1), "
            "sc as (select l_orderkey, max(entropy) as top, count(*) filter (entropy>=6.5) as many, bool_or(flags&3758096384=3758096384) as rwx from se group by 1), "
            "he as (select l_orderkey, least(40,(case when top>=7 then 10 else 0 end)+(case when many>=2 then 10 else 0 end)+(case when n_imports between 1 and 15 then 15 else 0 end)+(case when rwx then 15 else 0 end)+(case when point>=lr.r.lo and point<lr.r.hi then 15 else 0 end)) as heuristic "
            "from sc left join im using (l_orderkey) left join lr using (l_orderkey)), "
            "ev as (select l_orderkey, l_returnflag as family, sum(l_linenumber%3) as w from lineitem where l_partkey%11=0 and l_linenumber%3>0 group by 1,2), fe as (select l_orderkey, family, w, least(60,20+(w-1)*12) as score, case when w>=3 then 'high' when w>=2 then 'medium' else 'low' end as confidence from ev)")


def sections(spark, d):
    li = table(spark, d, "lineitem")
    # a repeated line number is a repeated section; the statistics take it as it comes
    sec = li.select("l_orderkey", F.col("l_linenumber").alias("ord"), (F.col("l_quantity") / 12 + 4).alias("entropy"), F.when(F.col("l_suppkey") % 9 == 0, F.lit(3758096384)).otherwise(F.lit(1610612736)).alias("flags"),
                    (F.col("l_linenumber") * 4096).alias("lo"), (F.col("l_linenumber") * 4096 + 4096).alias("hi"))
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    imports = o.select("l_orderkey", (F.col("o_custkey") % 60).alias("n_imports"))
    entries = o.select("l_orderkey", ((F.col("l_orderkey") % 7 + 1) * 4096 + 100).alias("point"))
    evidence = li.where("l_partkey % 11 = 0 and l_linenumber % 3 > 0").select("l_orderkey", F.col("l_returnflag").alias("family"), (F.col("l_linenumber") % 3).alias("weight"))
    return sec, imports, entries, evidence


@query("agg_32_family_evidence", sql(SECTIONS, "select l_orderkey, family, w::bigint as weight, score::integer as score, confidence from fe"))
def family_evidence(spark, d):
    return gr.family_evidence(sections(spark, d)[3], "l_orderkey")


@query("agg_32_anomaly_score", sql(SECTIONS, "fs as (select l_orderkey, least(60,sum(score)) as exact, bool_or(confidence='high') as hi, bool_or(confidence='medium') as med from fe group by 1), "
       "j as (select l_orderkey, coalesce(heuristic,0)::integer as heuristic, coalesce(exact,0)::integer as exact, hi, med, least(100,coalesce(heuristic,0)+coalesce(exact,0))::integer as packed_score from he full join fs using (l_orderkey)), "
       "k as (select *, case when hi is not null then case when hi or packed_score>=65 then 'high' when med then 'medium' else 'low' end when heuristic>=35 then 'medium' end as confidence from j)",
       "select l_orderkey, heuristic, exact, packed_score, confidence is not null as detected, confidence from k"))
def anomaly_score(spark, d):
    return gr.anomaly_score(*sections(spark, d), "l_orderkey")


@query("agg_33_set_fingerprint", sql(TOKENS, "select sample_id, md5(string_agg(token, ',' order by token)) as fingerprint from (select distinct sample_id, token from tok) group by 1"))
def set_fingerprint(spark, d):
    return ct.set_fingerprint(tokens(spark, d), "sample_id", "token")


@query("agg_33_group_key", "select doc_id, case when doc_id%3=0 then 'imp:'||md5(lang) when doc_id%3=1 then 'raw:'||substr(md5(source),1,16) else 'sha:'||sha256(text) end as group_key from documents")
def group_key(spark, d):
    from quorate.operators.corpus import group_key as key
    k = F.col("doc_id") % 3
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    return table(spark, d, "documents").select("doc_id", key("imphash", F.sha2(F.col("text").cast("binary"), 256), F.when(k == 0, md5("lang")), F.when(k == 1, md5("source"))).alias("group_key"))


LEAK = ("lk as (select vec_id, t, g, lo, hi, vec from (select vec_id, embedding::double[] as vec from embeddings), (values ('none'),('head'),('shift')) a(t), (values ('early',0,32),('late',32,64)) b(g,lo,hi)), "
        "ll as (select vec_id, t, g, unnest(vec) as x, generate_subscripts(vec,1)-1 as i, lo, hi from lk), l1 as (select vec_id, t, g, sum(case when i>=lo and i<hi then case when t='shift' then abs(x-(x+0.25)) when t='head' and i<8 then abs(x-0.5) else 0 end else 0 end) as l1 from ll group by 1,2,3)")


@query("agg_34_leakage", sql(LEAK, "select t as transform, g as grp, count(*) as n, round(avg(l1),6) as mean_l1, round(stddev_pop(l1),6) as std_l1, round(max(l1),6) as max_l1, round(avg((l1=0)::integer),6) as zero_rate from l1 group by 1,2"))
def leakage(spark, d):
    v = vectors(spark, d).select("sample_id", "vec")
    change = {"none": lambda x, i: x, "head": lambda x, i: F.when(i < 8, F.lit(0.5)).otherwise(x), "shift": lambda x, i: x + 0.25}
    mod = v.select("sample_id", F.inline(F.array(*[F.struct(F.lit(t).alias("transform"), F.transform("vec", f).alias("vec")) for t, f in change.items()])))
    return rounded(gr.leakage(v, mod, {"early": (0, 32), "late": (32, 64)}), "mean_l1", "std_l1", "max_l1", "zero_rate")


@query("jon_09_locate", "with p as (select o_orderkey as point_id, o_custkey, floor(o_totalprice)::bigint as point from orders), r as (select o_custkey, o_orderkey as ord, floor(o_totalprice)::bigint-300 as lo, floor(o_totalprice)::bigint+700 as hi from orders where o_orderkey%2=0), "
       "h as (select point_id, min(ord) as ord, arg_min(lo,ord) as lo from p join r using (o_custkey) where point>=lo and point<hi group by 1) select point_id, o_custkey, point, ord, case when lo is not null then point-lo else point end as offset from p left join h using (point_id)")
def locate(spark, d):
    o = table(spark, d, "orders")
    at = F.floor("o_totalprice").cast("bigint")
    points = o.select(F.col("o_orderkey").alias("point_id"), "o_custkey", at.alias("point"))
    ranges = o.where("o_orderkey % 2 = 0").select("o_custkey", F.col("o_orderkey").alias("ord"), (at - 300).alias("lo"), (at + 700).alias("hi"))
    return gr.locate(points, ranges, "o_custkey", 1000)


@query("jon_09_in_last_range", sql(SECTIONS, "select l_orderkey, point, coalesce(point>=lr.r.lo and point<lr.r.hi,false) as in_last from im left join lr using (l_orderkey)"))
def in_last_range(spark, d):
    sec, _, entries, _ = sections(spark, d)
    return gr.in_last_range(entries, sec.select("l_orderkey", "ord", "lo", "hi"), "l_orderkey")


REGION_VIEWS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("jon_10_isolation", "with r as (select o_custkey, o_orderpriority as view, floor(o_totalprice)::bigint as lo, floor(o_totalprice)::bigint+500+o_orderkey%9000 as hi from orders), v as (select distinct o_orderpriority as x from orders), "
       "h as (select a.view as va, b.view as vb, count(distinct o_custkey) as keys from r a join r b using (o_custkey) where a.view<b.view and a.lo<b.hi and b.lo<a.hi group by 1,2) "
       "select a.x as va, b.x as vb, coalesce(keys,0) as keys, keys is null as isolated from v a join v b on a.x<b.x left join h on h.va=a.x and h.vb=b.x")
def isolation(spark, d):
    at = F.floor("o_totalprice").cast("bigint")
    r = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("view"), at.alias("lo"), (at + 500 + F.col("o_orderkey") % 9000).alias("hi"))
    return gr.overlaps(r, "o_custkey", REGION_VIEWS)
