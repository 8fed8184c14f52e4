"""Packing into length buckets that waste least.

Lengths are token counts, capped by splitting: a document longer than ``max_length`` becomes pieces of ``max_length`` and a
rest, so no token is lost.  The histogram of all lengths (one count per length, at most ``max_length`` rows) goes to a dynamic
program that chooses the bucket boundaries with the least total padding.  Inside a bucket every sequence is padded to the
boundary, and a batch takes as many as the token budget allows.

Places inside a bucket are exact ranks in the order of a hash of (doc_id, piece): the bucket is cut into hash cells, the cells
are counted, and a row's rank is the count of the cells before it plus its rank in its own cell.  No task sees a whole bucket,
and only a bucket's last batch is not full.

Defined cases: NULL and empty texts and texts without tokens have length 0 and go into no batch (bucket and batch -1, one
piece); a NULL id is hashed like any other; repeated rows are packed as often as they stand; fewer distinct lengths than buckets
give one bucket per length; an empty table gives an empty result; extra columns are not returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.llm.common import stored

TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"
MAX_LENGTH = 4096
BUCKETS = 12
BUDGET = 65_536
CELL_BITS = 12


def token_count(text: str = "text") -> Column:
    """Words and single other signs, blanks left out."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding sum(count x (bound - length)).

    best[k][j] pads the first j lengths with k buckets; a bucket over lengths i..j-1 costs lengths[j-1] x (their number) minus
    their tokens.  The first of equally good cuts is taken.  All arithmetic is in whole numbers.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    m = len(lengths)
    if not m:
        return []
    number = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths)))
    far = np.iinfo(np.int64).max // 4
    best = np.full(m + 1, far)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, m)):
        now, cut = np.full(m + 1, far), np.zeros(m + 1, dtype=np.int64)
        now[0] = 0
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (number[j] - number[:j]) - (tokens[j] - tokens[:j])
            cut[j] = cost.argmin()
            now[j] = cost[cut[j]]
        best = now
        cuts.append(cut)
    bounds, j = [], m
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def pieces(docs: DataFrame, length: Column, max_length: int = MAX_LENGTH, key: str = "doc_id") -> DataFrame:
    """(key, piece, n_tokens): whole documents, or runs of ``max_length`` tokens and a rest."""
    n = F.col("__k_n")
    return (docs.select(F.col(key), length.cast("long").alias("__k_n"))
            .select(key, "__k_n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((n - 1) / max_length)).cast("long"))).alias("piece"))
            .select(key, F.col("piece").cast("int").alias("piece"), F.least(F.lit(max_length).cast("long"), n - F.col("piece") * max_length).alias("n_tokens")))


def pack(docs: DataFrame, length: Column | None = None, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, key: str = "doc_id") -> DataFrame:
    """(key, piece, n_tokens, bucket, bound, batch, place): where each piece goes; ``batch`` counts within its bucket."""
    if budget < max_length:
        raise ValueError("the token budget must hold one sequence of max_length")
    rows = stored(pieces(docs, token_count() if length is None else length, max_length, key))
    histogram = sorted((r[0], r[1]) for r in rows.filter("n_tokens > 0").groupBy("n_tokens").count().collect())  # at most max_length rows
    bounds = boundaries(np.array([h[0] for h in histogram]), np.array([h[1] for h in histogram]), buckets)
    bucket = F.lit(-1)
    for k, b in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(k)).otherwise(bucket)
    bucket = F.when(F.col("n_tokens") > 0, bucket).otherwise(F.lit(-1))
    bound = F.lit(0)
    for k, b in enumerate(bounds):
        bound = F.when(F.col("bucket") == k, F.lit(b)).otherwise(bound)
    deal = F.xxhash64(key, "piece")
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("__k_deal", deal).withColumn("__k_cell", F.shiftrightunsigned("__k_deal", 64 - CELL_BITS).cast("int"))
    cells = rows.groupBy("bucket", "__k_cell").agg(F.count(F.lit(1)).alias("__k_c"))  # at most (buckets + 1) x 4,096 rows
    before = Window.partitionBy("bucket").orderBy("__k_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("bucket", "__k_cell", F.coalesce(F.sum("__k_c").over(before), F.lit(0)).alias("__k_before"))
    inside = Window.partitionBy("bucket", "__k_cell").orderBy("__k_deal", key, "piece", "n_tokens")
    ranked = rows.withColumn("__k_rank", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["bucket", "__k_cell"])
    place = F.col("__k_before") + F.col("__k_rank")
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bound")))).cast("long")
    out = ranked.withColumn("bound", bound.cast("int")).withColumn("__k_place", place).withColumn("__k_fits", fits)
    live = F.col("bucket") >= 0
    return out.select(key, "piece", "n_tokens", "bucket", "bound",
                      F.when(live, F.floor(F.col("__k_place") / F.col("__k_fits"))).otherwise(-1).cast("long").alias("batch"),
                      F.when(live, F.col("__k_place") % F.col("__k_fits")).otherwise(-1).cast("long").alias("place"))
