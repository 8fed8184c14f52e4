"""Collocations of each language by best-first branch-and-bound growth.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``.  A candidate is a
phrase of two to four words with a = f(phrase) >= 30; its score is the least of floor(2000000 a / (l + r)) over its cuts into a
first part (l) and the rest (r).  Candidates that stand inside a longer one of at least 0.8 times their count are dropped; the
best 2,000 of each language stay.

1. Words are counted exactly.  Their counts go into hashed cells (least and greatest count of the frequent words in it): a table of
   at most MOST_CELLS, sent to every task, that bounds the count of any word from both sides.
2. Growth needs frequent parts.  Two sketches count hashed n-grams of frequent words (first pairs, then three and four words whose
   pairs may all be frequent).  A cell keeps one byte, the least level (steps of four percent) that its count does not exceed:
   an upper bound for every phrase in it; level 0 proves f < 30.
3. Best first: a phrase none of whose parts occurs more than m times (by words and cells) and whose first or last word occurs at
   least x times cannot score above 2000000 m / (m + max(m, x)).  In each round every unsettled language takes from the
   frontier all phrases whose bound lies in [t, previous t) and counts them exactly (by their words, not by hashes); a second
   scan counts the parts that the scores need, and all extensions by one word, which decide about drops.
4. A language is settled when 2,000 phrases have survived with scores of t or more: all that is left in the frontier has lower
   bounds, so the 2,000th score and its ties are known.  The last step is t = 0, where everything is counted.

A phrase inside a much longer one also stands in one that is a word longer, so extensions by one word decide.  Sets of phrases travel
to the tasks as bits too, at most MOST_BITS; false hits are counted for nothing and change no result.

Defined cases: a NULL language is ``und``; NULL and empty texts have no words; long texts are worked on in slices that end at piece
borders; repeated rows count again; ties go by score, count, then phrase in byte order; an empty table gives no rows; further
columns do not matter.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quorate.llm.common import stored

LEAST = 30
LONGEST = 4
TOP = 2000
STEPS = (125_000, 8_000, 0)  # thresholds of the rounds
SLICE = 4_000_000  # bytes of text that are cut into words at once
MOST_CELLS = 1 << 20  # hashed word counts
MOST_LEVELS = 1 << 25  # hashed counts of phrases
MOST_BITS = 1 << 27  # hashed sets of phrases
STEP = 1.04  # from one level to the next
BUCKETS = 512  # equal ranges of these cells
FLUSH = 3_000_000
SATURATED = 65_535
SALTS = 64
BREAKS = bytes.maketrans(b".;:!?\n\x0b\x0c\r\t", b",,,,,,,,, ")
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from the hashes of their words, place by place."""
    h = np.full(len(words[0]), np.uint64(len(words)))
    for w in words:
        h = _mix(h * M3 + w)
    return h


def slices(batch: pa.RecordBatch):
    """(lang, words) of a batch of (lang, text), in slices; a comma among the words is a border of pieces."""
    by: dict[str, list[str]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if text:
            by.setdefault("und" if lang is None else lang, []).append(text)
    for lang, texts in by.items():
        data = ",".join(texts).encode().lower().translate(BREAKS)
        lo = 0
        while lo < len(data):
            hi = data.find(b",", lo + SLICE)
            hi = len(data) if hi < 0 else hi
            yield lang, data[lo:hi].replace(b",", b" , ").split()
            lo = hi


def _words(batches):
    counts: dict[str, Counter] = {}

    def rows():
        out = [(lang, w.decode(), n) for lang, own in counts.items() for w, n in own.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "f"])

    for b in batches:
        for lang, words in slices(b):
            counts.setdefault(lang, Counter()).update(words)
            counts[lang].pop(b",", None)
            if sum(map(len, counts.values())) > FLUSH // 10:
                yield rows()
    yield rows()


def room(entries: int, most: int) -> int:
    """Cells for so many entries: a power of two, eight times as many at least, up to a fixed size."""
    size = 8 * BUCKETS
    while size < min(8 * entries, most):
        size *= 2
    return size


def _word_cells(cells: int):
    def run(batches):
        for b in batches:
            cell = np.zeros(b.num_rows, dtype=np.int64)
            langs, words = np.array(b.column(0).to_pylist(), dtype=object), np.array([w.encode() for w in b.column(1).to_pylist()], dtype=object)
            for lang in set(langs.tolist()):
                own = np.flatnonzero(langs == lang)
                cell[own] = (word_hashes(lang, words[own].tolist()) & np.uint64(cells - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(2)], names=["cell", "f"])
    return run


class Bits:
    """A set of hashes in so many bits."""

    def __init__(self, size: int):
        self.size, self.raw = size, np.zeros(size // 8, dtype=np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        cell = h & np.uint64(self.size - 1)
        return (self.raw[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


# the largest count of each level; counts above the last one are not bounded
LEVELS = np.append(np.append(LEAST - 1, np.ceil(LEAST * STEP ** np.arange(254))).astype(np.int64), np.iinfo(np.int64).max)


class Sent:
    """What goes to every task; its size is bounded by MOST_CELLS and MOST_LEVELS."""

    def __init__(self, low: np.ndarray, high: np.ndarray, frequent: np.ndarray):
        self.low, self.high, self.frequent = low, high, frequent


class Slice:
    """The words of one slice as numbers, with hashes and bounds of their counts."""

    def __init__(self, lang: str, tokens: list[bytes], sent: Sent):
        self.names = list(dict.fromkeys(tokens))
        place = {w: k for k, w in enumerate(self.names)}
        self.ids = np.fromiter(map(place.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        own = word_hashes(lang, self.names)
        cell = (own & np.uint64(len(sent.low) - 1)).astype(np.int64)
        high = sent.high[cell].copy()
        if b"," in place:
            high[place[b","]] = 0
        self.hash, self.high, self.low = own[self.ids], high[self.ids], sent.low[cell][self.ids]
        self.frequent = sent.frequent

    def starts(self, n: int, flagged: int) -> np.ndarray:
        """Places where n frequent words stand together and all parts of 2 to ``flagged`` words may be frequent."""
        count = len(self.ids) - n + 1
        if count <= 0:
            return np.zeros(0, dtype=np.int64)
        good = self.high >= LEAST
        all_of = good[:count].copy()
        for k in range(1, n):
            all_of &= good[k:count + k]
        at = np.flatnonzero(all_of)
        for size in range(2, flagged + 1):
            for k in range(n - size + 1):
                at = at[self.level(at + k, size) > 0]
        return at

    def level(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.frequent[(self.of(at, n) & np.uint64(len(self.frequent) - 1)).astype(np.int64)]

    def of(self, at: np.ndarray, n: int) -> np.ndarray:
        return phrase_hash([self.hash[at + k] for k in range(n)])

    def bound(self, at: np.ndarray, n: int) -> np.ndarray:
        """No phrase at these places can score more."""
        least = self.high[at].copy()
        for k in range(1, n):
            np.minimum(least, self.high[at + k], out=least)
        for size in range(2, n + 1):
            for k in range(n - size + 1):
                np.minimum(least, LEVELS[self.level(at + k, size)], out=least)
        least = least.astype(float)
        ends = np.maximum(self.low[at], self.low[at + n - 1]).astype(float)
        return np.floor(2_000_000 * least / (least + np.maximum(least, ends))) + 1

    def counted(self, at: np.ndarray, n: int) -> tuple[list[str], np.ndarray]:
        """Phrases at these places and how often each stands there; equal means equal words."""
        code, room = self.ids[at], len(self.names)
        top = room
        for k in range(1, n):
            if top * room >= 2**62:
                values, code = np.unique(code, return_inverse=True)
                top = len(values)
            code, top = code * room + self.ids[at + k], top * room
        _, first, count = np.unique(code, return_index=True, return_counts=True)
        rows = np.stack([self.ids[at[first] + k] for k in range(n)], axis=1).tolist()
        return [b" ".join(map(self.names.__getitem__, r)).decode() for r in rows], count


def _sketch(sent, sizes: tuple[int, ...], flagged: int, bits: int):
    """Counts of hashed n-grams, by range of cells: (bucket, cells, counts).  A count that reaches SATURATED stands for any."""
    width = bits // BUCKETS

    def run(batches):
        cells, counts, held = [], [], 0

        def merged():
            both, add = np.concatenate(cells), np.concatenate(counts)
            order = np.argsort(both, kind="stable")
            both, add = both[order], add[order]
            first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
            return both[first], np.minimum(np.add.reduceat(add.astype(np.int64), first), SATURATED).astype(np.uint16)

        def rows(own, add):
            cut = np.searchsorted(own, np.arange(BUCKETS + 1) * width)
            some = [k for k in range(BUCKETS) if cut[k] < cut[k + 1]]
            return pa.RecordBatch.from_arrays([
                pa.array(some, pa.int32()), pa.array([(own[cut[k]:cut[k + 1]] - k * width).astype(np.uint32).tobytes() for k in some], pa.binary()),
                pa.array([add[cut[k]:cut[k + 1]].tobytes() for k in some], pa.binary())], names=["bucket", "cells", "counts"])

        for b in batches:
            for lang, tokens in slices(b):
                part = Slice(lang, tokens, sent.value)
                for n in sizes:
                    at = part.starts(n, flagged)
                    if len(at):
                        own, add = np.unique((part.of(at, n) & np.uint64(bits - 1)).astype(np.int64), return_counts=True)
                        cells.append(own)
                        counts.append(np.minimum(add, SATURATED).astype(np.uint16))
                        held += len(own)
                if held > FLUSH:
                    own, add = merged()
                    cells, counts, held = [own], [add], len(own)
                    if held > FLUSH // 2:
                        yield rows(own, add)
                        cells, counts, held = [], [], 0
        if held:
            yield rows(*merged())
    return run


def _levels(width: int):
    """Levels of the cells of each bucket; the rows of a bucket stand together."""
    def level(total: np.ndarray) -> bytes:
        return np.where(total < LEAST, 0, np.maximum(np.searchsorted(LEVELS, total, side="left"), 1)).astype(np.uint8).tobytes()

    def run(batches):
        bucket, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([level(total)], pa.binary())], names=["bucket", "levels"])
        for b in batches:
            for k, cells, counts in zip(*[b.column(i).to_pylist() for i in range(3)]):
                if k != bucket:
                    if bucket is not None:
                        yield row()
                    bucket, total = k, np.zeros(width, dtype=np.int64)
                add = np.frombuffer(counts, dtype=np.uint16).astype(np.int64)
                total[np.frombuffer(cells, dtype=np.uint32)] += np.where(add == SATURATED, 1 << 40, add)  # cells are distinct within a row
        if bucket is not None:
            yield row()
    return run


def _bucket_row(bucket: int, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bucket", "bits"])


def _exact(sent, grow):
    """Exact counts of the phrases at the places that ``grow(part, lang, n)`` gives: (lang, phrase, words, f)."""
    def run(batches):
        counts: dict[tuple[str, int], Counter] = {}

        def rows():
            out = [(lang, w, n, f) for (lang, n), own in counts.items() for w, f in own.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["lang", "phrase", "words", "f"])

        for b in batches:
            for lang, tokens in slices(b):
                part = Slice(lang, tokens, sent.value)
                for n in range(2, LONGEST + 1):
                    at = grow(part, lang, n)
                    if len(at):
                        own = counts.setdefault((lang, n), Counter())
                        for phrase, f in zip(*part.counted(at, n)):
                            own[phrase] += int(f)
                if sum(map(len, counts.values())) > FLUSH // 10:
                    yield rows()
        yield rows()
    return run


def _hashed(bits: int):
    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows, dtype=np.int64)
            for k, (lang, phrase) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                h = word_hashes(lang, phrase.encode().split(b" "))
                out[k] = int(phrase_hash([h[i:i + 1] for i in range(len(h))])[0] & np.uint64(bits - 1))
            yield pa.RecordBatch.from_arrays([pa.array(out)], names=["cell"])
    return run


def _bits_of(phrases: DataFrame, bits: int) -> Bits:
    """The set of all phrases (lang, phrase) as bits: at most MOST_BITS / 8 bytes come to the driver."""
    width = bits // BUCKETS

    def run(batches):
        bucket, own = None, None
        for b in batches:
            for k, cell in zip(*[b.column(i).to_pylist() for i in range(2)]):
                if k != bucket:
                    if bucket is not None:
                        yield _bucket_row(bucket, own)
                    bucket, own = k, np.zeros(width, dtype=bool)
                own[cell - k * width] = True
        if bucket is not None:
            yield _bucket_row(bucket, own)

    cells = phrases.mapInArrow(_hashed(bits), "cell long").distinct().withColumn("bucket", F.expr(f"cast(cell div {width} as int)"))
    return _collected(cells.select("bucket", "cell").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, bits binary"), bits)


def _collected(rows: DataFrame, bits: int) -> Bits:
    out, size = Bits(bits), bits // BUCKETS // 8
    for r in rows.collect():
        out.raw[r.bucket * size:(r.bucket + 1) * size] |= np.frombuffer(r.bits, dtype=np.uint8)
    return out


def _cuts(phrases: DataFrame) -> DataFrame:
    """Each cut of each phrase: lang, phrase, k, first, rest."""
    w = F.split("phrase", " ")
    k = F.col("k")
    return (phrases.select("lang", "phrase", w.alias("w"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
            .select("lang", "phrase", "k", F.array_join(F.slice("w", F.lit(1), k), " ").alias("first"), F.array_join(F.slice("w", k + 1, F.size("w") - k), " ").alias("rest")))


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def _survivors(grown: DataFrame, known: DataFrame, words: DataFrame) -> DataFrame:
    """Scores of the grown phrases that no longer phrase drops: lang, phrase, a, l, r, score."""
    counts = known.select("lang", "phrase", "f").union(words.select("lang", "phrase", "f"))
    cuts = (_cuts(grown).join(grown.select("lang", "phrase", F.col("f").alias("a")), ["lang", "phrase"])
            .join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    cuts = cuts.withColumn("a20", _wide("a")).withColumn("sum", (_wide("l") + _wide("r")).cast("decimal(21,0)"))
    scored = (cuts.withColumn("score", F.expr("(a20 * 2000000) div sum").cast("long"))
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    w = F.split("phrase", " ")
    longer = known.filter("words > 2").select("lang", "f", F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.array_join(F.slice(w, F.lit(2), F.size(w) - 1), " "))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(most, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * 80))
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language, ranked in salted parts before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    some = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def mine(docs: DataFrame, top: int = TOP, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` collocations of each language of ``docs``."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("text is not null")
    every = stored(texts.mapInArrow(_words, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")))
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = every.filter(F.col("f") >= LEAST)
    size = words.agg(F.count(F.lit(1)), F.sum("f")).first()
    cells, bits = room(size[0], MOST_CELLS), room(size[1] or 0, MOST_LEVELS)
    counted = words.mapInArrow(_word_cells(cells), "cell long, f long").groupBy("cell").agg(F.min("f").alias("low"), F.max("f").alias("high")).toArrow()
    low, high = np.zeros(cells, dtype=np.int64), np.zeros(cells, dtype=np.int64)
    at = counted.column("cell").to_numpy()
    low[at], high[at] = counted.column("low").to_numpy(), counted.column("high").to_numpy()

    frequent = np.zeros(bits, dtype=np.uint8)
    for sizes, flagged in (((2,), 1), (tuple(range(3, LONGEST + 1)), 2)):
        sent = spark.sparkContext.broadcast(Sent(low, high, frequent))
        rows = texts.mapInArrow(_sketch(sent, sizes, flagged, bits), "bucket int, cells binary, counts binary")
        found = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_levels(bits // BUCKETS), "bucket int, levels binary").collect()
        sent.destroy()
        frequent = frequent.copy()
        for r in found:
            # phrases of all lengths share the cells; the higher level bounds each of them
            own = frequent[r.bucket * (bits // BUCKETS):(r.bucket + 1) * (bits // BUCKETS)]
            np.maximum(own, np.frombuffer(r.levels, dtype=np.uint8), out=own)
        del found
    sent = spark.sparkContext.broadcast(Sent(low, high, frequent))

    kinds = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("f", T.LongType())])

    def exact(open_texts: DataFrame, grow) -> DataFrame:
        rows = open_texts.mapInArrow(_exact(sent, grow), kinds)
        return stored(rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= LEAST))

    settled: list[str] = []
    done, grown, known, before = None, None, None, float("inf")
    for step in STEPS:
        open_texts = texts.filter(~F.col("lang").isin(settled)) if settled else texts

        def frontier(part, name, n, lo=step, hi=before):
            found = part.starts(n, n)
            best = part.bound(found, n)
            return found[(best >= lo) & (best < hi)]

        fresh = exact(open_texts, frontier)
        parts = _cuts(fresh).select("lang", F.explode(F.array("first", "rest")).alias("phrase")).filter(F.col("phrase").contains(" ")).distinct()
        wanted = room(4 * fresh.count(), MOST_BITS)
        sets = spark.sparkContext.broadcast((_bits_of(parts, wanted), _bits_of(fresh.filter(F.col("words") < LONGEST), wanted)))

        def support(part, name, n, sets=sets):
            needed, extended = sets.value
            found = part.starts(n, n)
            take = needed.has(part.of(found, n))
            if n > 2:
                take |= extended.has(part.of(found, n - 1)) | extended.has(part.of(found + 1, n - 1))
            return found[take]

        grown = fresh if grown is None else stored(grown.union(fresh))
        more = exact(open_texts, support).union(fresh)
        sets.destroy()
        known = stored((more if known is None else known.union(more)).dropDuplicates(["lang", "phrase"]))
        open_grown = grown.filter(~F.col("lang").isin(settled)) if settled else grown
        best = stored(_best(_survivors(open_grown, known, words).filter(F.col("score") >= step), top))
        ready = [r.lang for r in best.groupBy("lang").count().collect() if r["count"] >= top or step == 0]
        part = best.filter(F.col("lang").isin(ready)) if ready else None
        done = part if done is None else done if part is None else done.unionByName(part)
        settled += ready
        before = step
        if step == 0 or texts.filter(~F.col("lang").isin(settled)).isEmpty():
            break
    sent.destroy()
    if done is None:
        done = best
    return done.join(F.broadcast(totals) if totals.count() <= MOST_CELLS else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
