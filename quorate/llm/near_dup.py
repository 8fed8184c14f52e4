"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document is the set of its distinct word shingles (lower-case A-Z, words are runs without ASCII blanks), as 64-bit hashes.

1. Equal sets form a class, represented by its smallest doc_id; only representatives go on.
2. SuperMinHash: every shingle draws one permutation of the signature's places; at its j-th place it offers the rank j plus a
   random fraction, and each place keeps the least offer.  As later ranks cannot beat earlier ones, a document stops
   after the first rank at which all places are filled.
3. Bands of places are hashed to keys; documents that share a key are candidates.  ``layout`` takes the most rows a band with which
   a pair at the threshold shares no key with a probability of at most MISS: 84 bands of 12 for 85 percent, 90 of 9 for 80.
4. Links are confirmed on the full sets.  First every member of a bucket is held against the bucket's smallest member.
   Buckets that are then not all of one component are looked at again: members with a partner in another component whose
   byte sketch allows the threshold (five standard deviations of room) send their sets to the bucket, where all pairs from
   different components are confirmed and only a forest of links leaves the task, never the pairs.  A bucket is compared in blocks
   of BLOCK members, each pair of blocks on its own, so a bucket of any size is whole and no task holds it all.
5. Components: union-find inside the tasks, then alternating large-star and small-star rounds between them.

Defined cases: NULL, empty and blank texts have the empty set and link with nothing; fewer words than a shingle are one shingle
of the whole sequence; rows that share an id are one document (linked with each other); a row without id links with nothing,
has no component and is kept; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm.common import BROADCAST_ROWS, semi_by_id, stored

PLACES = 1024
MISS = 2.6e-6  # of a pair at the threshold
MOST_ROWS = 12
SKETCH = 256
BLOCK = 2000
UNIT_SETS = 5000  # sets of one block in a unit of verification
GROUP = 60_000  # shingles that are signed together
EMPTY = np.int64(2**62)
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out = _mix(out * M3 + h[i:len(h) - k + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, PLACES) SuperMinHash values: rank in the high bits, random fraction in the low 32."""
    out = np.full((len(sets), PLACES), EMPTY, dtype=np.int64)
    flat = out.reshape(-1)
    at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    seed = _mix(x + M3)
    first, stride = seed & np.uint64(PLACES - 1), (seed >> np.uint64(20)) | np.uint64(1)  # a permutation of 2^10 places
    rank = 0
    while len(at):
        place = ((first + stride * np.uint64(rank)) & np.uint64(PLACES - 1)).astype(np.int64)
        offer = (_mix(x + np.uint64((rank + 1) * int(M2) % 2**64)) >> np.uint64(32)).astype(np.int64) + (np.int64(rank) << np.int64(32))
        np.minimum.at(flat, at * PLACES + place, offer)
        rank += 1
        if rank % 4 == 0 or rank < 3 or rank == PLACES:
            live = np.unique(at)
            full = np.zeros(len(sets), dtype=bool)
            full[live] = out[live].max(axis=1) < EMPTY
            stay = ~full[at]
            if not stay.all():
                at, x, first, stride = at[stay], x[stay], first[stay], stride[stay]
    return out


def layout(percent: int) -> tuple[int, int]:
    """(bands, rows a band) for a threshold.  ValueError if PLACES are too few for it."""
    s = percent / 100
    for rows in range(MOST_ROWS, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-s ** rows)) if s < 1 else 1
        if bands * rows <= PLACES:
            return bands, rows
    raise ValueError(f"{PLACES} places are too few for a similarity of {percent} percent")


def band_keys(sig: np.ndarray, percent: int) -> np.ndarray:
    bands, rows = layout(percent)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64) * M3, (len(sig), bands)).copy()
    cut = sig[:, :bands * rows].reshape(len(sig), bands, rows).astype(np.uint64)
    for r in range(rows):
        h = _mix(h + cut[:, :, r])
    return h.astype(np.int64)


def _sign(width: int, percent: int):
    def run(batches):
        for b in batches:
            cache: dict[bytes, int] = {}
            ids, texts = b.column(0), b.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                sets, total = [], 0
                while lo + len(sets) < len(texts) and total < GROUP and len(sets) < 1000:
                    sets.append(shingle_set(texts[lo + len(sets)], width, cache))
                    total += len(sets[-1])
                sig = signatures(sets)
                keys = band_keys(sig, percent)
                sketch = _mix(sig[:, :SKETCH].astype(np.uint64)).astype(np.uint8)
                marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                halves = np.frombuffer(b"".join(marks), dtype=np.int64).reshape(-1, 2)
                some = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                    pa.array([k if s else None for k, s in zip(keys, some)], pa.list_(pa.int64())), pa.array([k.tobytes() if s else None for k, s in zip(sketch, some)], pa.binary())],
                    names=["doc_id", "n", "d1", "d2", "keys", "sketch"])
                lo += len(sets)
    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            cache: dict[bytes, int] = {}
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, width, cache).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "s"])
    return run


def full_sets(docs: DataFrame, ids: DataFrame, count: int, width: int) -> DataFrame:
    """(id, s): the whole set of every row of ``docs`` whose id is among the ``count`` distinct ``ids``."""
    kinds = T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.BinaryType())])
    return stored(semi_by_id(docs.select("doc_id", "text"), ids, "doc_id", count).mapInArrow(_sets(width), kinds))


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold: 100 x intersection >= percent x union."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    count = ids.count()
    sets = full_sets(docs, ids, count, width)

    # ids are dealt into blocks; a pair belongs to the unit of its two blocks, and a set is sent once to each unit that asks for it
    blocks = max(16, -(-count // UNIT_SETS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    placed = pairs.select("a", "b", block("a").alias("x"), block("b").alias("y")).select("a", "b", (F.least("x", "y") * blocks + F.greatest("x", "y")).cast("long").alias("unit"))
    asked = placed.select("unit", F.col("a").alias("id")).union(placed.select("unit", "b")).distinct().join(sets, "id").select("unit", F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "s")
    rows = asked.unionByName(placed.select("unit", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("s")))
    rows = rows.repartition("unit").sortWithinPartitions("unit", "kind")

    def run(batches):
        unit, own = None, {}
        for batch in batches:
            keep_a, keep_b = [], []
            for u, kind, a, b, raw in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                if u != unit:
                    unit, own = u, {}
                if kind == 0:
                    own.setdefault(a, []).append(np.frombuffer(raw, dtype=np.uint64))
                elif any(alike(x, y, percent) for x in own.get(a, ()) for y in own.get(b, ())):
                    keep_a.append(a)
                    keep_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], names=["a", "b"])

    return stored(rows.mapInArrow(run, "a long, b long").distinct())


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 x intersection >= percent x union, for sorted distinct hashes."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
    return 100 * both >= percent * (len(x) + len(y) - both)


def _forest(batches):
    """Union-find over one task's edges: each node with its root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if parent[x] != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every node that is not the smallest of its component; edges (a, b)."""
    e = stored(edges.select("a", "b").mapInArrow(_forest, "u long, v long"))
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = stored(small.filter("u > v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
        before = now


def _units(batches):
    """The rows of each unit (key, x, y), which stand together, as one table."""
    held, unit = [], None
    for b in batches:
        key, x, y = (b.column(k).to_numpy() for k in (0, 1, 2))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            if lo == hi:
                continue
            name = (key[lo], x[lo], y[lo])
            if name != unit and held:
                yield pa.Table.from_batches(held)
                held = []
            unit = name
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _near(batches, percent: int):
    """Members of each unit (two blocks of one bucket) with a partner in another component whose size and sketch allow the threshold."""
    s = percent / 100
    # 1/256 of unequal bytes agree by chance; five standard deviations at the threshold
    enough = SKETCH * (s - 5 * (s * (1 - s) / SKETCH) ** 0.5)
    for unit in _units(batches):
        ids, comp, n, block = (unit.column(k).to_numpy() for k in (3, 4, 5, 6))
        values, counts = np.unique(comp, return_counts=True)
        if len(values) < 2:
            continue
        sk = np.frombuffer(b"".join(unit.column(7).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
        odd = np.flatnonzero(comp != values[counts.argmax()])
        one, near = block.min() == block.max(), np.zeros(len(ids), dtype=bool)
        for lo in range(0, len(odd), 64):
            x = odd[lo:lo + 64]
            ok = (comp[x][:, None] != comp[None]) & (100 * np.minimum(n[x][:, None], n[None]) >= percent * np.maximum(n[x][:, None], n[None]))
            if not one:
                ok &= block[x][:, None] != block[None]
            i, j = np.nonzero(ok)
            for k in range(0, len(i), 50_000):
                good = (sk[x[i[k:k + 50_000]]] == sk[j[k:k + 50_000]]).sum(axis=1) >= enough
                near[x[i[k:k + 50_000][good]]] = True
                near[j[k:k + 50_000][good]] = True
        _, first = np.unique(ids[near], return_index=True)  # an id may have several sets
        yield pa.RecordBatch.from_arrays([unit.column(k).combine_chunks().take(pa.array(np.flatnonzero(near)[first])) for k in (0, 1, 2, 3, 4, 6)], names=["key", "x", "y", "id", "comp", "block"])


def _linked(batches, percent: int):
    """Links of each unit on the full sets, as a forest over its components: fewer links than members, though every pair is looked at."""
    for unit in _units(batches):
        ids, comp, block = (unit.column(k).to_numpy() for k in (3, 4, 5))
        sets = [np.frombuffer(r, dtype=np.uint64) for r in unit.column(6).to_pylist()]
        n = np.array([len(v) for v in sets])
        values, counts = np.unique(comp, return_counts=True)
        if len(values) < 2:
            continue
        every, place = np.unique(np.concatenate(sets), return_inverse=True)
        first, mark = np.cumsum(n) - n, np.zeros(len(every), dtype=bool)
        one, a, b = block.min() == block.max(), [], []
        root = comp.copy()
        for x in np.flatnonzero(comp != values[counts.argmax()]).tolist():
            ok = (root != root[x]) & (100 * np.minimum(n[x], n) >= percent * np.maximum(n[x], n))
            j = np.flatnonzero(ok if one else ok & (block != block[x]))
            if not len(j):
                continue
            own = place[first[x]:first[x] + n[x]]
            mark[own] = True
            starts = np.cumsum(n[j]) - n[j]
            both = np.add.reduceat(mark[place[np.repeat(first[j] - starts, n[j]) + np.arange(n[j].sum())]], starts, dtype=np.int64)
            mark[own] = False
            for k in j[100 * both >= percent * (n[x] + n[j] - both)].tolist():
                if root[k] != root[x]:
                    a.append(min(ids[x], ids[k]))
                    b.append(max(ids[x], ids[k]))
                    root[root == root[k]] = root[x]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _mixed_units(buckets: DataFrame, comps: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, dealt into units of two blocks and sorted by unit."""
    placed = buckets.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("key")
    own = F.pmod(F.xxhash64("id"), F.col("g").cast("long")).cast("int")
    units = (placed.join(mixed, "key", "left_semi").withColumn("g", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
             .join(sizes, "id")
             .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "comp", "n", F.col("own").alias("block"), "sketch"))
    return units.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Pairs link from ``percent`` on; bands and sketch bound are laid out for it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = "doc_id long, n long, d1 long, d2 long, keys array<long>, sketch binary"
    signed = stored(docs.mapInArrow(_sign(width, percent), kinds))
    classes = stored(signed.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))
    # rows of representatives; an id that stands on several rows brings all its sets
    reps = signed.filter("n > 0").join(classes.withColumnRenamed("rep", "doc_id"), ["d1", "d2", "doc_id"], "left_semi")
    members = reps.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    shared = members.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("size")).filter("low < high")
    buckets = stored(members.join(shared, "key").distinct())
    stars = buckets.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    links = verified(stars, docs, width, percent)
    # an id that stands on several sets holds their classes together: it is linked with the representative of each
    named = signed.filter("n > 0 and doc_id is not null").join(classes, ["d1", "d2"]).select(F.col("doc_id").alias("b"), F.col("rep").alias("a")).distinct()
    several = named.groupBy("b").agg(F.min("a").alias("a0"), F.max("a").alias("a1")).filter("a0 < a1").select("b")
    ties = named.join(several, "b", "left_semi").filter("a <> b").select("a", "b")
    links = stored(links.union(ties))
    comps = stored(components(links))
    # one row per set: an id with several sets is held against the others with each of them
    sizes = reps.groupBy(F.col("doc_id").alias("id"), "d1", "d2").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")).drop("d1", "d2")
    # sketches tell which members may link; their whole sets go to the units and the links come back
    near = stored(_mixed_units(buckets, comps, sizes).mapInArrow(lambda batches: _near(batches, percent), "key long, x int, y int, id long, comp long, block int"))
    ids = stored(near.select(F.col("id").alias("doc_id")).distinct())
    count = ids.count()
    if count:
        units = near.join(full_sets(docs, ids, count, width), "id").select("key", "x", "y", "id", "comp", "block", "s").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        more = units.mapInArrow(lambda batches: _linked(batches, percent), "a long, b long").distinct()
        comps = stored(components(links.union(more)))

    placed = signed.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2"], "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("comp", "rep"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """One document of each group, the one with the smallest id; the columns of ``docs``."""
    gone = stored(near_duplicates(docs, width, percent).filter("not kept").select("doc_id").distinct())
    rows = gone.count()
    return docs.join(F.broadcast(gone) if rows <= BROADCAST_ROWS else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
