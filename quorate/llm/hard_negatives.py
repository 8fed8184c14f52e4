"""Hard negatives by exact integer scores from products modulo small primes.

Each component x becomes floor(SCALE x); a score is the integer inner product of two rows.  For every anchor its best rows of the same
label are positives, and for every positive the best rows of other labels whose score lies between LOW percent of the
positive's score and that score are its hard negatives.  Higher scores come first, ties by smaller id.

1. One pass reads the largest component and the width: they bound all scores by width x largest squared.
2. Residue number system: as many primes below 1,024 are taken as make the product exceed four times that bound.  Rows are
   reduced modulo each prime to at most 510 in size, so sums over 64 places stay below 2^24 and float32 products are exact.
3. Signed scores are rebuilt from the residues: digits of the mixed radix (a form of the Chinese remainder theorem), summed
   modulo 2^64; scores in the upper half of the range are negative.
4. Two passes over all rows for every block of at most ROUND anchors, which is broadcast: the first gives the positives, the second
   the rows inside the windows.  A task keeps 5 rows per anchor or positive and sends them once; few rows meet per anchor.

Defined cases: rows with a NULL id, a NULL label, a NULL vector, or a NULL or non-finite component take no part; shorter vectors
count as padded with zeros, empty ones are zeros; components so large that a score might leave 64 bits put their row out; rows
that share an id are rows of their own, but none is a partner of an anchor with its id; an empty table or one without anchors
gives no rows; other columns do not matter.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorate.llm.common import stored
from quorate.llm.vectors import dense, widened

SCALE = 256
POSITIVES = NEGATIVES = 5
LOW = 80
ROUND = 16_384  # anchors of one broadcast block
TILE_ANCHORS, TILE_ROWS = 512, 4096
PLACES = 64  # summed in float32 at once: 64 x 510^2 < 2^24
NONE = np.iinfo(np.int64).min


def primes(bound: int) -> list[int]:
    """The largest primes below 1,024 whose product exceeds four times ``bound``."""
    out, p = [], 1023
    while math.prod(out) <= 4 * bound:
        p -= 2
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
    return out


def residues(q: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers modulo p, nearest to zero, as float32."""
    r = np.mod(q, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def exact_scores(left: list[np.ndarray], right: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Signed inner products (int64) of all rows of two sets from their residues."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(moduli):
        total = None
        for lo in range(0, max(left[k].shape[1], 1), PLACES):
            part = (left[k][:, lo:lo + PLACES] @ right[k][:, lo:lo + PLACES].T).astype(np.int32)
            total = np.mod(part if total is None else total + part, p, dtype=np.int32)
        for v, before in zip(digits, moduli):
            total = np.mod((total - v) * np.int32(pow(before, -1, p)), p, dtype=np.int32)
        digits.append(total)
    weight, value, size = 1, np.zeros(digits[0].shape, dtype=np.uint64), np.zeros(digits[0].shape)
    for v, p in zip(digits, moduli):
        value += v.astype(np.uint64) * np.uint64(weight % 2**64)
        size += v * float(weight)
        weight *= p
    value[size > weight / 2] -= np.uint64(weight % 2**64)
    return value.view(np.int64)


def _whole(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(SCALE * x)


def _extent(batches):
    """Width and largest component of each batch (as text: it may exceed any whole type)."""
    for b in batches:
        usable, x = dense(b.column(0))
        q = np.abs(_whole(x[usable]))
        q = q[np.isfinite(q).all(axis=1)] if q.size else q
        yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int64()), pa.array([float(q.max()) if q.size else 0.0])], names=["width", "most"])


class Anchors:
    """A block of anchors: ids, labels and whole components; with windows in the second pass."""

    def __init__(self, ids, labels, q, moduli, most):
        self.ids, self.labels, self.moduli, self.most, self.width = ids, labels, moduli, most, q.shape[1]
        self.residues = [residues(q, p) for p in moduli]
        self.low = self.high = None


def _first(place: np.ndarray, score: np.ndarray, ident: np.ndarray, n: int) -> np.ndarray:
    """Indices of the first n entries of each place: higher scores first, then smaller ids."""
    order = np.lexsort((ident, ~score, place))
    own = place[order]
    start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[rank < n]


def _tiles(anchors: Anchors, b: pa.RecordBatch):
    """(first anchor, scores, ids, same label) of tiles of anchors and rows of a batch."""
    usable, x = dense(b.column(2))
    q = _whole(widened(x, anchors.width))
    usable &= (np.abs(q) <= anchors.most).all(axis=1)
    if not usable.any():
        return
    ids, labels, q = np.asarray(b.column(0).to_numpy())[usable], np.asarray(b.column(1).to_numpy())[usable], q[usable]
    for lo in range(0, len(ids), TILE_ROWS):
        right = [residues(q[lo:lo + TILE_ROWS], p) for p in anchors.moduli]
        for a in range(0, len(anchors.ids), TILE_ANCHORS):
            score = exact_scores([r[a:a + TILE_ANCHORS] for r in anchors.residues], right, anchors.moduli)
            yield a, score, ids[lo:lo + TILE_ROWS], anchors.labels[a:a + TILE_ANCHORS, None] == labels[None, lo:lo + TILE_ROWS]


def _kept(batches, anchors: Anchors, pick, n: int):
    """The first n rows of each place over all batches of a task."""
    state = [np.zeros(0, dtype=np.int64)] * 3
    for b in batches:
        found = [state]
        for tile in _tiles(anchors, b):
            place, score, ident = pick(*tile)
            best = _first(place, score, ident, n)
            found.append([place[best], score[best], ident[best]])
        merged = [np.concatenate(c) for c in zip(*found)]
        best = _first(*merged, n)
        state = [c[best] for c in merged]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in state], names=["place", "score", "other"])


def _positives(shared):
    def run(batches):
        anchors = shared.value

        def pick(a, score, ids, same):
            same &= anchors.ids[a:a + len(score), None] != ids[None]
            masked = np.where(same, score, NONE)
            if masked.shape[1] > POSITIVES:  # ties with the last of the first five stay until ids decide
                same &= masked >= np.partition(masked, -POSITIVES, axis=1)[:, -POSITIVES, None]
            i, j = np.nonzero(same)
            return i + a, score[i, j], ids[j]

        yield from _kept(batches, anchors, pick, POSITIVES)
    return run


def _negatives(shared):
    def run(batches):
        anchors = shared.value

        def pick(a, score, ids, same):
            low, high = anchors.low[a:a + len(score)], anchors.high[a:a + len(score)]
            i, j = np.nonzero(~same & (score >= low.min(axis=1)[:, None]) & (score <= high.max(axis=1)[:, None]))
            s = score[i, j]
            parts = [np.flatnonzero((s >= low[i, p]) & (s <= high[i, p])) for p in range(POSITIVES)]
            place = np.concatenate([(i[k] + a) * POSITIVES + p for p, k in enumerate(parts)])
            every = np.concatenate(parts)
            return place, s[every], ids[j[every]]

        yield from _kept(batches, anchors, pick, NEGATIVES)
    return run


def _top(rows: DataFrame, n: int) -> DataFrame:
    """The first n of each place, of the few that every task has kept."""
    own = Window.partitionBy("place").orderBy(F.desc("score"), F.asc("other"))
    return rows.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= n)


def mine(rows: DataFrame, is_anchor: Column, ident: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where ``is_anchor`` holds."""
    spark = rows.sparkSession
    kinds = "place long, score long, other long"
    open_rows = rows.withColumn("__anchor", F.coalesce(is_anchor, F.lit(False))).select(
        F.col(ident).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), F.col("__anchor").alias("anchor"))
    open_rows = open_rows.filter("id is not null and label is not null and vector is not null")
    extent = open_rows.select("vector").mapInArrow(_extent, "width long, most double").agg(F.max("width"), F.max("most")).first()
    width, most = int(extent[0] or 0), int(extent[1] or 0)
    most = min(most, math.isqrt((2**63 - 1) // max(width, 1)))
    moduli = primes(max(width, 1) * most * most)

    anchors = open_rows.filter("anchor").select("id", "label", "vector")
    rounds = max(1, math.ceil(anchors.count() / ROUND))
    data, out = open_rows.select("id", "label", "vector"), []
    for k in range(rounds):
        block = anchors if rounds == 1 else anchors.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == k)
        own = block.toArrow().combine_chunks()
        usable, x = dense(own.column("vector").combine_chunks())
        q = _whole(widened(x, width))
        usable &= (np.abs(q) <= most).all(axis=1)
        ids, labels, q = own.column("id").to_numpy()[usable], own.column("label").to_numpy()[usable], q[usable]
        if not len(ids):
            continue
        sent = Anchors(ids, labels, q, moduli, most)
        found = _top(data.mapInArrow(_positives(spark.sparkContext.broadcast(sent)), kinds), POSITIVES)
        best = stored(found.select("place", F.col("rank").cast("int").alias("p"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))
        low, high = (np.full((len(ids), POSITIVES), fill, dtype=np.int64) for fill in (np.iinfo(np.int64).max, NONE))
        for place, p, _, score in zip(*[c.to_pylist() for c in best.toArrow().columns]):
            low[place, p - 1], high[place, p - 1] = -(-LOW * score // 100), score
        sent.low, sent.high = low, high
        near = _top(data.mapInArrow(_negatives(spark.sparkContext.broadcast(sent)), kinds), NEGATIVES)
        names = spark.createDataFrame(pa.table({"place": np.arange(len(ids)), "anchor_id": ids}))
        out.append(near.select(F.expr(f"place div {POSITIVES}").alias("a"), (F.pmod("place", F.lit(POSITIVES)) + 1).cast("int").alias("p"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
                   .join(best.withColumnRenamed("place", "a"), ["a", "p"]).join(names.withColumnRenamed("place", "a"), "a")
                   .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, out)
