"""The pipeline against plain versions of its stages, and its contract."""

from collections import defaultdict

import regex

import corpus_pipeline
from quorate.llm import decontamination, packing, pii, quality_rules
from test_training_operators import plain_distance, plain_groups

FOLDER = "/root/testdata/sf0.001"


def plain_quality(rows):
    failed = {r.doc_id: (lambda s: s[0] < 50 or 100 * s[4] > 50 * s[0])(quality_rules.text_stats(r.text)) for r in rows}
    hosts = defaultdict(list)
    for r in rows:
        hosts[r.source].append(failed[r.doc_id])
    n, f = sum(map(len, hosts.values())), sum(map(sum, hosts.values()))
    m, free = f / n, len(hosts) - 1
    spread = sum(sum(h) ** 2 / len(h) for h in hosts.values()) - m * f
    below = m * (1 - m) * (n - sum(len(h) ** 2 for h in hosts.values()) / n - free)
    corr = max(1e-4, min(0.9999, (spread - m * (1 - m) * free) / below if below > 0 else 1e-4))
    k = (1 - corr) / corr
    ok = {s: (sum(h) + m * k) / (len(h) + k) <= 0.5 for s, h in hosts.items()}
    return [r for r in rows if not failed[r.doc_id] and ok[r.source]]


def contaminated(text, items):
    words = decontamination.WORD.findall((text or "").lower())
    grams = set(zip(words, words[1:], words[2:]))
    for item in items:
        w = decontamination.WORD.findall((item or "").lower())
        # an item within a fifth of its length shares a run of three words or is too short for that
        if len(w) >= decontamination.MIN_WORDS and (len(w) < 15 or grams & set(zip(w, w[1:], w[2:]))) and plain_distance(w, words) <= int(0.2 * len(w)):
            return True
    return False


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = plain_quality(docs.collect())
    groups = plain_groups([(r.doc_id, r.text) for r in rows], 5, 85)
    rows = [r for r in rows if groups[r.doc_id][1] == r.doc_id]
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = [r for r in rows if not contaminated(r.text, items)]
    field = pii.fit(spark.createDataFrame([(r.text,) for r in rows], "text string"))
    want = {}
    for r in rows:
        spans, text, at = pii.find(r.text, field)[1], "", 0
        for a, k, b in spans:
            text += r.text[at:a] + f"[{pii.KINDS[k]}]" if a >= at else ""
            at = max(at, b)
        want[r.doc_id] = len(regex.findall(packing.TOKEN, text + r.text[at:]))
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        got[r.doc_id] += r.n_tokens
        assert r.n_tokens <= packing.MAX_LENGTH and r.bucket >= 0
    assert dict(got) == want


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).withColumn("score", docs_extra()).withColumn("key", docs_extra())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() <= docs.count()
        stage(spark, docs.limit(0), FOLDER).count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dup", "decontamination", "pii", "packing"]


def docs_extra():
    from pyspark.sql import functions as F
    return F.lit("x")
