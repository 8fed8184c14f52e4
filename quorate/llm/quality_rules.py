"""Quality rules with host verdicts.

Every document is held against word-level rules.  The failures are summed by host, each host's failure rate is shrunk with
a beta prior estimated from all hosts (empirical Bayes, method of moments for the beta-binomial), and hosts whose shrunk
rate is too high lose all their documents.

Defined cases: NULL or empty text has no words and fails; a NULL host is a host of its own; repeated rows count as often as
they stand; an empty table gives an empty result; other columns pass through ``judge`` whatever their names, as all added
columns begin with ``q_``-underscored names that are dropped before the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm.common import BROADCAST_ROWS, stored, with_arrays

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
SALTS = 64
BLANKS = b" \t\n\r\x0b\f"
SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, and words inside 3-word windows that stand twice or more."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - len(raw) + len(raw.translate(None, BLANKS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        number: dict[bytes, int] = {}
        codes = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        pairs = codes[:-1] * len(number) + codes[1:]
        if len(number) > 1_000_000:
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, which, times = np.unique(pairs[:-1] * len(number) + codes[2:], return_inverse=True, return_counts=True)
        twice = times[which] > 1
        if twice.any():
            covered = np.zeros(n, dtype=bool)
            covered[:-2] |= twice
            covered[1:-1] |= twice
            covered[2:] |= twice
            repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def _stats(texts: pa.Array) -> list[pa.Array]:
    rows = [text_stats(t) for t in texts.to_pylist()]
    return [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]


def rule_stats(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Append the five counts and ``base_failed`` (all named with ``prefix``)."""
    out = with_arrays(docs, [text], [T.StructField(prefix + c, T.LongType()) for c in STATS], _stats)
    n, rep = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return out.withColumn(prefix + "base_failed", (n < MIN_WORDS) | (rep * 100 > n * MAX_REPEAT_PERCENT))


def host_verdicts(stats: DataFrame, host: str, failed: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, host_ok): one row per host.

    Prior: mean m of all failures; intra-host correlation from the weighted spread of the host rates, kept in
    [1e-4, 0.9999]; concentration k = (1 - r) / r; shrunk rate = (failures + m k) / (documents + k).
    """
    hosts = stats.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    whole = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count(F.lit(1)).alias("h"),
                      F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("n2"),
                      F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n_docs")).alias("fp"))
    m = F.col("f") / F.col("n")
    spread = F.col("fp") - m * F.col("f")
    free = F.col("h") - 1
    below = m * (1 - m) * (F.col("n") - F.col("n2") / F.col("n") - free)
    corr = F.when(below > 0, (spread - m * (1 - m) * free) / below).otherwise(F.lit(1e-4))
    corr = F.greatest(F.lit(1e-4), F.least(F.lit(0.9999), corr))
    prior = whole.select(m.alias("m"), ((1 - corr) / corr).alias("k"))
    rate = (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k"))
    return (hosts.crossJoin(F.broadcast(prior)).withColumn("shrunk_rate", rate)
            .select("host", "n_docs", "n_failed", "shrunk_rate", (F.col("shrunk_rate") <= max_rate).alias("host_ok")))


def attach_verdicts(rows: DataFrame, verdicts: DataFrame, host: str, ok: str = "host_ok", key: str = "doc_id") -> DataFrame:
    """Join host verdicts back to rows as column ``ok``.

    Few hosts are broadcast.  Beyond ``BROADCAST_ROWS`` hosts each verdict stands once per salt and a host's rows are
    dealt over the salts, so that no host's rows meet in one task.
    """
    flags = verdicts.select(F.col("host").alias("__q_host"), F.col("host_ok").alias(ok))
    if verdicts.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(flags), rows[host].eqNullSafe(flags["__q_host"]), "left").drop("__q_host")
    salted = flags.withColumn("__q_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__q_salt0", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return (rows.join(salted, rows[host].eqNullSafe(salted["__q_host"]) & (rows["__q_salt0"] == salted["__q_salt"]), "left")
            .drop("__q_host", "__q_salt", "__q_salt0"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``host_ok`` and ``kept``."""
    stats = stored(rule_stats(docs.select(F.col(key), F.col(text).alias("__q_text"), F.col(host).alias("__q_source")), "__q_text").drop("__q_text"))
    verdicts = stored(host_verdicts(stats, "__q_source", "base_failed"))
    return (attach_verdicts(stats, verdicts, "__q_source", key=key)
            .select(key, *STATS, "base_failed", "host_ok", (~F.col("base_failed") & F.col("host_ok")).alias("kept")))


def keep(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Only the documents that pass their own rules and come from an accepted host; the columns of ``docs``."""
    narrow = rule_stats(docs.select(F.col(text).alias("__q_text"), F.col(host).alias("__q_source")), "__q_text").drop("__q_text")
    verdicts = stored(host_verdicts(narrow, "__q_source", "base_failed"))
    judged = rule_stats(docs, text, "__q_").filter(~F.col("__q_base_failed"))
    return attach_verdicts(judged, verdicts, host, "__q_ok").filter("__q_ok").select(*[F.col(f"`{c}`") for c in docs.columns])
