"""Near-duplicate vectors: links by collision counting on sorted projections.

Vectors link from a cosine of ``threshold`` on.

1. Equal vectors form a class, so copies cost one comparison however many they are.
2. Every table draws random lines.  The sides of a vector on the first of them name its cell, the place on the last one orders
   the cell.  Two vectors collide in a table if they share its cell and the second lies in the window of WINDOW standard
   deviations (of a pair at the threshold) around the first.  Without cells every window would hold a fixed share of all rows,
   so the number of collisions would grow with the square of the input.
3. ``layout`` takes cells, tables and the least count of collisions together: the cheapest layout in which a pair
   exactly at the threshold reaches the count COUNT with a probability of RECALL; closer pairs reach it more often.
4. In each cell, sorted by place on its line, windows are read off; the collisions of each pair in them are counted over all tables
   from the cells and places that travel with the vectors.  The pair is looked at only in the first table in which it collides,
   and verified there by its cosine in double precision if its count suffices.  So no pair leaves a task: what
   leaves is a number of links and a root of the union-find forest per vector.
5. Cells of more than BLOCK members are dealt into blocks; each pair of blocks is a unit of its own, so no task holds
   a hot cell.  Sums of links and components (large-star and small-star rounds) complete the result.

Members of a large group of different near copies are compared pair by pair, as the number of links asks for it, but in blocks.

Defined cases: NULL, empty and zero vectors and those with NULL or non-finite components link with nothing and are kept; a row without
id links with nothing, has no component and is kept; shorter vectors count as padded with zeros; rows that share an id belong
to one component, each with the links of its own vector; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm.common import BROADCAST_ROWS, stored
from quorate.llm.near_dup import components
from quorate.llm.vectors import dense, widened

RECALL = 0.999
COUNT = 2
WINDOW = 2.0
STEPS = 1024  # a window in steps of the stored places
MOST_BITS = 24
ROW_COST, PAIR_COST = 20.0, 0.15  # of a row in a table and of a pair in a window; their ratio decides the size of cells
BLOCK = 1024
PAIRS = 100_000  # pairs that are counted at once
TABLE_BITS = 32  # a cell's key is its table above these bits


def _reaches(tables: int, p: float, count: int) -> float:
    """Probability of ``count`` or more collisions in so many tables."""
    return 1 - sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(count))


def collision(cosine: float, bits: int, threshold: float) -> float:
    """Probability that a pair of this cosine collides in one table."""
    width = WINDOW * math.sqrt(2 - 2 * threshold)
    gap = math.sqrt(max(2 - 2 * cosine, 1e-300))
    return (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** bits * math.erf(width / gap / math.sqrt(2))


def layout(rows: int, threshold: float) -> tuple[int, int]:
    """(lines that name a cell, tables) of the least cost for so many vectors."""
    best = None
    for bits in range(min(MOST_BITS, max(0, math.ceil(math.log2(max(rows, 1))))) + 1):
        p = collision(threshold, bits, threshold)
        tables = COUNT
        while _reaches(tables, p, COUNT) < RECALL:
            tables += max(1, tables // 50)
        cost = tables * (ROW_COST + PAIR_COST * rows * collision(0.0, bits, threshold) / 2)
        if best is None or cost < best[0]:
            best = (cost, bits, tables)
    return best[1], best[2]


def _signed(bits: int, tables: int, width: int, threshold: float):
    """cls, rep, size, vec with cells (one key per table) and places (in steps) of each vector."""
    step = STEPS / (WINDOW * math.sqrt(2 - 2 * threshold))

    def run(batches):
        lines = np.random.default_rng(20_011).standard_normal((tables * (bits + 1), width))
        weights = (1 << np.arange(bits, dtype=np.int64))
        for b in batches:
            if not b.num_rows:
                continue
            _, x = dense(b.column(3))
            x = _unit(widened(x, width))
            h = (x @ lines.T).reshape(len(x), tables, bits + 1)
            cells = (h[:, :, :bits] > 0) @ weights
            places = np.clip(np.rint(h[:, :, bits] * step), -32_767, 32_767).astype(np.int16)
            keys = cells + (np.arange(tables, dtype=np.int64) << TABLE_BITS)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in x], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))),
                pa.array([c.tobytes() + p.tobytes() for c, p in zip(cells.astype(np.int32), places)], pa.binary())], names=["cls", "rep", "size", "unit", "keys", "signature"])
    return run


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    most = np.abs(x).max(axis=1, keepdims=True) if x.shape[1] else np.ones((len(x), 1))
    x = x / np.where(most == 0, 1, most)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def _windows(places: np.ndarray, own: np.ndarray | None):
    """Pairs (i, j) of the members of a cell whose places are at most a window apart, in portions; across blocks only, if given."""
    order = np.argsort(places, kind="stable")
    line = places[order].astype(np.int32)
    end = np.searchsorted(line, line + STEPS, side="right")
    counts = end - np.arange(len(line)) - 1
    total = np.cumsum(counts)
    lo = 0
    while lo < len(line):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, side="right")))
        n = counts[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        i, j = order[i], order[j]
        if own is not None:
            cross = own[i] != own[j]
            i, j = i[cross], j[cross]
        if len(i):
            yield i, j
        lo = hi


def _judged(table: int, rep, size, unit, signature, own, tables: int, threshold: float):
    """Of one unit: links of each member found here, and the root of its forest."""
    signs = np.frombuffer(b"".join(signature), dtype=np.uint8).reshape(len(signature), 6 * tables)
    cells = np.ascontiguousarray(signs[:, :4 * tables]).view(np.int32)
    places = np.ascontiguousarray(signs[:, 4 * tables:]).view(np.int16)
    x = np.frombuffer(b"".join(unit), dtype=np.float64).reshape(len(unit), -1)
    links, parent = np.zeros(len(rep), dtype=np.int64), np.arange(len(rep))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    wide = places.astype(np.int32)
    for i, j in _windows(places[:, table], own):
        if table:  # those that collided in an earlier table were looked at there
            new = np.ones(len(i), dtype=bool)
            for t in range(table):
                left = np.flatnonzero(new)
                new[left] = (cells[i[left], t] != cells[j[left], t]) | (np.abs(wide[i[left], t] - wide[j[left], t]) > STEPS)
            i, j = i[new], j[new]
        hits = np.ones(len(i), dtype=np.int32)
        for t in range(table + 1, tables):
            hits += (cells[i, t] == cells[j, t]) & (np.abs(wide[i, t] - wide[j, t]) <= STEPS)
        enough = hits >= COUNT
        i, j = i[enough], j[enough]
        near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        i, j = i[near], j[near]
        np.add.at(links, i, size[j])
        np.add.at(links, j, size[i])
        for a, b in zip(i.tolist(), j.tolist()):
            a, b = root(a), root(b)
            if a != b:
                a, b = (a, b) if rep[a] <= rep[b] else (b, a)
                parent[b] = a
    some = np.flatnonzero(links)
    return some, links[some], np.array([rep[root(k)] for k in some.tolist()], dtype=np.int64)


def _units(tables: int, threshold: float):
    """Judges the units (key, x, y) whose rows stand together: cls, rep, links, root."""
    def run(batches):
        held: list[tuple] = []
        unit = None

        def judged():
            cls, rep, size, own = (np.array([r[k] for r in held], dtype=np.int64) for k in (3, 4, 5, 6))
            key, x, y = unit
            some, links, roots = _judged(key >> TABLE_BITS, rep, size, [r[7] for r in held], [r[8] for r in held], own if x != y else None, tables, threshold)
            return cls[some], rep[some], links, roots

        def sent(parts):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["cls", "rep", "links", "root"])

        parts = []
        for b in batches:
            for r in zip(*[b.column(k).to_pylist() for k in range(9)]):
                if r[:3] != unit:
                    if len(held) > 1:
                        parts.append(judged())
                    held, unit = [], r[:3]
                held.append(r)
            if parts:
                yield sent(parts)
                parts = []
        if len(held) > 1:
            yield sent([judged()])
    return run


def _blocked(points: DataFrame) -> DataFrame:
    """One row per vector and unit: key, x, y (the unit's blocks), then what a unit needs."""
    entries = points.select(F.explode("keys").alias("key"), "cls", "rep", "size", "unit", "signature")
    counts = points.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(counts.filter(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("g")))
    entries = entries.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, "key", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    own = F.pmod(F.xxhash64("cls"), F.col("g").cast("long")).cast("int")
    entries = entries.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return entries.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "cls", "rep", "size", F.col("own").cast("long").alias("own"), "unit", "signature")


def links(rows: DataFrame, threshold: float = 0.9, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(ident, n_links, component_id, kept) of every row."""
    kind = rows.schema[vector].dataType.elementType
    kind = kind if isinstance(kind, T.FloatType) else T.DoubleType()
    plain = rows.select(F.col(ident).alias("id"), F.transform(F.col(vector).cast(T.ArrayType(kind)), lambda x: x + F.lit(0.0).cast(kind)).alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    open_rows = plain.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & sound).withColumn("id", F.col("id").cast("long"))
    classes = open_rows.groupBy("vec").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count(F.lit(1)).alias("size"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()))
    facts = classes.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    bits, tables = layout(facts[0], threshold)
    kinds = "cls long, rep long, size long, unit binary, keys array<long>, signature binary"
    points = stored(classes.select("cls", "rep", "size", "vec").mapInArrow(_signed(bits, tables, int(facts[1] or 0), threshold), kinds))
    units = _blocked(points).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    found = stored(units.mapInArrow(_units(tables, threshold), "cls long, rep long, links long, root long"))
    totals = found.groupBy("cls").agg(F.sum("links").alias("links"))
    own = classes.select("vec", "cls", "rep", "size").join(totals, "cls", "left")
    placed = stored(open_rows.join(own, "vec").select("id", "rep", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    # rows of one id hold their classes together
    several = placed.groupBy("id").agg(F.min("rep").alias("r0"), F.max("rep").alias("r1")).filter("r0 < r1").select("id")
    ties = placed.join(several, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    edges = found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).union(ties.filter("a <> b")).distinct()
    comps = components(edges)
    placed = placed.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n_links", F.coalesce("comp", "rep").alias("component_id"))
    rest = plain.filter(~(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(sound, F.lit(False)))).select(F.col("id").cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    rest = rest.join(several.withColumn("several", F.lit(True)), "id", "left").drop("several")
    return placed.unionByName(rest).select(F.col("id").alias(ident), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
