"""Digest and similarity-hash lookups against large signature tables.

Signatures are unique per digest, so a lookup never multiplies samples.  The join is a plain equi-join: adaptive
execution broadcasts whichever side turns out small, splits a digest shared by many samples, and the runtime Bloom
filter prunes the signature scan when the sample side is selective.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.columns import positive

TIERS = ["sha256_db", "md5_db", "fuzzy_db"]


def size_agrees(sample: Column, signature: Column) -> Column:
    """A missing size on either side means any size."""
    return sample.isNull() | signature.isNull() | (sample == signature)


def first_signature(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key, without a per-key sort."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__s")).select(*keys, "__s.*")


def match_exact(samples: DataFrame, sigs: DataFrame, digest: str) -> DataFrame:
    """Samples whose digest is a signature of a compatible size; adds ``sig_size``.

    Whether a runtime Bloom filter runs before the join is a setting of the session (``session.DEFAULTS`` turns it on).
    """
    s = sigs.select(F.col("digest").alias(digest), F.col("size").alias("sig_size"))
    return samples.join(s, digest).where(size_agrees(F.col("size"), F.col("sig_size")))


def known(samples: DataFrame, sigs: DataFrame, digest: str) -> DataFrame:
    """Existence only."""
    s = sigs.select(F.col("digest").alias("__g"), F.col("size").alias("__z"))
    return samples.join(s, (F.col(digest) == F.col("__g")) & size_agrees(F.col("size"), F.col("__z")), "left_semi")


def match_fuzzy(samples: DataFrame, fsigs: DataFrame, types: list[str], key: str = "sample_id") -> DataFrame:
    """One row per hit (sample, hash type) on similarity hashes with the size rule."""
    long = samples.select(key, "size", F.inline(F.array(*[F.struct(F.lit(t).alias("hash_type"), F.col(t).alias("value")) for t in types])))
    sig = fsigs.select("hash_type", "value", F.col("size").alias("sig_size"), "name")
    return long.where(F.col("value").isNotNull()).join(sig, ["hash_type", "value"]).where(size_agrees(F.col("size"), F.col("sig_size"))) \
        .select(key, "hash_type", "value", "name")


def match_tiered(samples: DataFrame, sha: DataFrame, md5: DataFrame, fuzzy: DataFrame, fuzzy_types: list[str], key: str = "sample_id") -> DataFrame:
    """First tier that hits wins: sha256, then md5, then similarity hash (types in order).

    Signatures are unique, so every lookup is a left join on the same row: the samples are read once and nothing is looked up
    twice or grouped again.
    """
    rows = samples.select(key, "size", "sha256", "md5", *fuzzy_types)
    looked = [("sha256", sha.select("digest", F.lit(True).alias("__hit"), F.lit("KnownMalware").alias("__name"), F.col("size").alias("__size")), 0, ""),
              ("md5", md5.select("digest", F.lit(True).alias("__hit"), F.lit("KnownMalware").alias("__name"), F.col("size").alias("__size")), 1, "")]
    looked += [(t, fuzzy.where(F.col("hash_type") == t).select(F.col("value").alias("digest"), F.lit(True).alias("__hit"), F.col("name").alias("__name"), F.col("size").alias("__size")), 2, t) for t in fuzzy_types]
    for i, (column, sigs, _, _) in enumerate(looked):
        sigs = sigs.select(F.col("digest").alias(f"__d{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("__hit", "__name", "__size")])
        rows = rows.join(sigs, F.col(column) == F.col(f"__d{i}"), "left").drop(f"__d{i}")
    hits = [F.when(F.col(f"__hit{i}") & size_agrees(F.col("size"), F.col(f"__size{i}")), F.struct(F.lit(TIERS[tier]).alias("source"), F.col(f"__name{i}").alias("name"), F.lit(kind).alias("hash_type")))
            for i, (_, _, tier, kind) in enumerate(looked)]
    return rows.select(key, F.coalesce(*hits).alias("h")).where("h is not null").select(key, "h.*")


def signature_stats(sigs: DataFrame, prefix: int = 2) -> DataFrame:
    """Counts per type and digest prefix, per type and in all."""
    return sigs.withColumn("shard", F.substring("digest", 1, prefix)).rollup("algo", "shard").agg(F.count(F.lit(1)).alias("n"))


def verdicts(samples: DataFrame, hits: DataFrame, scored: DataFrame, key: str = "sample_id") -> DataFrame:
    """Verdict per sample: a hit scores 1.0 and names its source, otherwise ensemble score, evidence and top view decide.

    ``scored`` has (key, score, is_drift, drift_type, view).
    """
    from quorate.operators.corpus import status, status_label
    from quorate.operators.scores import label_name
    h = hits.select(key, "source", F.col("name").alias("__name"))
    j = samples.join(h, key, "left").join(scored, key, "left")
    hit = F.col("source").isNotNull()
    score = F.when(hit, F.lit(1.0)).otherwise(F.col("score"))
    failed = ~hit & F.col("score").isNull()
    pred = F.when(hit | (F.col("score") > 0.5), 1).otherwise(0)
    code = status(pred, F.coalesce(F.col("is_drift"), F.lit(False)), failed)
    out = j.select(key, F.coalesce(F.col("source"), F.lit("ensemble")).alias("source"), score.alias("score"), code.alias("status"),
                   F.when(hit, F.col("__name")).when(code > 0, label_name(F.col("drift_type"), F.col("view"), F.col("sha256"))).otherwise("").alias("detection"))
    return out.withColumn("status_label", status_label(F.col("status")))


def scan_summary(verdict: DataFrame, seconds: str) -> DataFrame:
    """Totals and time statistics of a scan; the median is the upper one, found by rank rather than by a sorted list."""
    from quorate.operators.ordering import value_at
    ok = F.col("status") != -1
    timed = F.when(ok & (F.col(seconds) > 0), F.col(seconds))
    a = verdict.agg(F.count(F.lit(1)).alias("total"), positive(F.col("status") == 1).alias("malicious"), positive(ok & (F.col("status") != 1)).alias("benign"),
                    positive(F.col("status") == -1).alias("errors"), F.min(timed).alias("min_time"), F.max(timed).alias("max_time"), F.avg(timed).alias("avg_time"),
                    (F.count(F.lit(1)) / F.sum(seconds)).alias("throughput"))
    times = verdict.where(ok & (F.col(seconds) > 0)).select(F.col(seconds).alias("__s"))
    return a.crossJoin(F.broadcast(value_at(times, [], "__s", F.floor(F.col("n") / 2), "median_time")))
