"""Call-graph and region statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions.columns import positive, ratio
from quorate.operators.ordering import Measure, real_digits, running


def degrees(edges: DataFrame, graph: str = "graph") -> DataFrame:
    """(graph, node, outdeg, indeg, loop) over distinct edges: one aggregation of both edge ends."""
    ends = edges.select(graph, F.inline(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), (F.col("src") == F.col("dst")).cast("int").alias("l")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("l")))))
    return ends.groupBy(graph, "node").agg(F.sum("o").alias("outdeg"), F.sum("i").alias("indeg"), F.max("l").alias("loop"))


def graph_stats(edges: DataFrame, graph: str = "graph") -> DataFrame:
    """Nodes, edges, average degree, density, leaf share, self loops, back edges, extreme and typical degrees."""
    deg = degrees(edges, graph)
    g = deg.groupBy(graph).agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("outdeg").alias("edges"), positive(F.col("outdeg") == 0).alias("leaves"), F.sum("loop").alias("self_loops"),
        F.max("outdeg").alias("max_out"), F.max("indeg").alias("max_in"), F.stddev_pop("outdeg").alias("std_out"), positive(F.col("indeg") > 0).alias("callees"))
    back = edges.groupBy(graph).agg(positive(F.col("dst") <= F.col("src")).alias("back_edges"))
    n = F.col("nodes")
    return g.join(back, graph).select(graph, "nodes", "edges", ratio(F.col("edges"), n).alias("avg_degree"), ratio(F.col("edges"), n * (n - 1)).alias("density"),
                                      ratio(F.col("leaves"), n).alias("leaf_share"), "self_loops", "back_edges", "max_out", "max_in", "std_out", "callees")


LANES = 8  # words of 64 roots in one row, less where no graph has so many


def _numbered(edges: DataFrame, graph: str) -> DataFrame:
    """Add ``number`` and ``first`` to rows (graph, node, dst): callers numbered through, those of a graph next to each other.

    Rows are sorted by caller in range partitions, so callers of near numbers lie in one task.  A graph may begin at any number.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext
    from pyspark.sql import types as T

    def run(batches):
        # numbers of different partitions lie far apart; ``at`` is the last caller's in this one
        base, at, last = TaskContext.get().partitionId() << 33, -1, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in (b.column(0), b.column(1)):
                x, y = c.slice(1), c.slice(0, n - 1)
                new[1:] |= pc.coalesce(pc.not_equal(x, y), pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
            ends = [(b.column(0)[i].as_py(), b.column(1)[i].as_py()) for i in (0, n - 1)]
            new[0] = ends[0] != last
            number = at + np.cumsum(new)
            at, last = int(number[-1]), ends[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base + number), pa.array(new)], names=[*b.schema.names, "number", "first"])

    kind = T.StructType([*edges.schema.fields, T.StructField("number", T.LongType()), T.StructField("first", T.BooleanType())])
    return edges.repartitionByRange(graph, "node").sortWithinPartitions(graph, "node").mapInArrow(run, kind)


def graph_depth(edges: DataFrame, max_depth: int | None = None, fanout: int | None = None, roots: int | None = None, graph: str = "graph") -> DataFrame:
    """Greatest call depth per graph, from every caller along every callee; limits hold only where the caller sets them.

    Breadth-first from a block of roots at a time: a node carries one bit per root of the block, set if the root has reached it.
    A round sends the new bits along the edges and removes those already there, so a node counts at its shortest distance and
    a round has at most nodes x blocks rows.  After the first round only callees send bits, so later rounds see their edges alone.
    A root brings its bit to a new node in every round up to its depth, so the bits of all rounds add up to the depths.
    Every round is written to the shared folder, which keeps plans flat.
    """
    from functools import reduce

    from quorate.session import reliable_table
    per_node = Window.partitionBy(graph, "src").orderBy("dst")
    kept = edges.select(graph, "src", "dst").distinct()
    if fanout is not None:
        kept = kept.withColumn("__r", F.row_number().over(per_node)).where(F.col("__r") <= fanout)
    kept = reliable_table(kept.select(graph, F.col("src").alias("node"), "dst"))
    callers = kept
    if roots is not None:
        start = kept.select(graph, "node").distinct()
        start = start.withColumn("__r", F.row_number().over(Window.partitionBy(graph).orderBy("node"))).where(F.col("__r") <= roots).drop("__r")
        callers = kept.join(start, kept[graph].eqNullSafe(start[graph]) & kept["node"].eqNullSafe(start["node"]), "left_semi")
    callers = reliable_table(_numbered(callers, graph))
    per_graph = callers.groupBy(graph).agg(positive(F.col("first")).alias("roots"))
    most = per_graph.agg(F.max("roots")).first()[0] or 0
    lanes = range(min(LANES, max(1, -(-most // 64))))
    size = 64 * len(lanes)
    callers = callers.withColumns({"block": F.expr(f"number div {size}"), "place": F.expr(f"cast(number % {size} as int)")})
    callees = reliable_table(kept.select(graph, F.col("dst").alias("node")).distinct())
    inner = reliable_table(kept.join(callees, [graph, "node"], "left_semi"))
    at, zero = [graph, "block", "node"], F.lit(0).cast("bigint")
    word = lambda i: F.when(F.shiftright("place", 6) == i, F.expr("shiftleft(1L, place % 64)")).otherwise(zero)
    # a root itself is no new node; that matters where it is a callee
    seen = callers.where("first").join(callees, [graph, "node"], "left_semi").select(*at, *[word(i).alias(f"had{i}") for i in lanes])
    sent = callers.where(F.col(graph).isNotNull() & F.col("node").isNotNull()).select(graph, "block", F.col("dst").alias("node"), *[word(i).alias(f"new{i}") for i in lanes])
    levels, level = [], 0
    while max_depth is None or level < max_depth:
        level += 1
        both = sent.select(*at, *[f"new{i}" for i in lanes], *[zero.alias(f"had{i}") for i in lanes]).unionByName(seen.select(*at, *[zero.alias(f"new{i}") for i in lanes], *[f"had{i}" for i in lanes]))
        both = both.groupBy(*at).agg(*[F.bit_or(f"{k}{i}").alias(f"{k}{i}") for k in ("new", "had") for i in lanes])
        fresh = [F.col(f"new{i}").bitwiseAND(F.bitwise_not(f"had{i}")).alias(f"new{i}") for i in lanes]
        state = reliable_table(both.select(*at, *fresh, *[F.col(f"new{i}").bitwiseOR(F.col(f"had{i}")).alias(f"had{i}") for i in lanes]))
        frontier = state.where(reduce(lambda a, b: a | b, [F.col(f"new{i}") != 0 for i in lanes])).select(*at, *[f"new{i}" for i in lanes])
        if frontier.isEmpty():
            break
        levels.append(frontier.groupBy(graph, "block").agg(*[F.bit_or(f"new{i}").alias(f"new{i}") for i in lanes]).withColumn("level", F.lit(level)))
        seen = state
        # nodes of a block lie together, so their bits meet before the next shuffle
        sent = frontier.repartition(graph, "block").join(inner, [graph, "node"]).select(graph, "block", F.col("dst").alias("node"), *[f"new{i}" for i in lanes])
    if not levels:
        return per_graph.select(graph, F.lit(0).alias("max_depth"), F.lit(0.0).alias("mean_depth"))
    per_block = reduce(DataFrame.unionByName, levels)
    depths = per_block.groupBy(graph).agg(F.max("level").alias("__m"), F.sum(reduce(lambda a, b: a + b, [F.bit_count(f"new{i}").cast("bigint") for i in lanes])).alias("__s"))
    # a null graph has roots and no rounds
    return per_graph.join(depths, graph, "left").select(graph, F.coalesce("__m", F.lit(0)).alias("max_depth"), (F.coalesce("__s", zero) / F.col("roots")).alias("mean_depth"))


def cycles(n: int, src: list[int], dst: list[int]) -> list[int]:
    """Sizes of the strongly connected components of one function's blocks that hold a cycle (Tarjan, without recursion)."""
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(src, dst):
        if 0 <= a < n and 0 <= b < n:
            out[a].append(b)
    order, low, on = [-1] * n, [0] * n, [False] * n
    stack: list[int] = []
    sizes, count = [], 0
    for first in range(n):
        if order[first] >= 0:
            continue
        work = [(first, 0)]
        while work:
            v, k = work.pop()
            if k == 0:
                order[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            elif on[out[v][k - 1]]:
                low[v] = min(low[v], low[out[v][k - 1]])
            while k < len(out[v]) and order[out[v][k]] >= 0:
                if on[out[v][k]]:
                    low[v] = min(low[v], order[out[v][k]])
                k += 1
            if k < len(out[v]):
                work += [(v, k + 1), (out[v][k], 0)]
            elif low[v] == order[v]:
                part = [stack.pop()]
                while part[-1] != v:
                    part.append(stack.pop())
                for w in part:
                    on[w] = False
                if len(part) > 1 or v in out[v]:
                    sizes.append(len(part))
    return sizes


def loops_of(functions: DataFrame) -> DataFrame:
    """Add ``loops`` and ``largest_loop`` to rows (block_number, block_edges): cycles of one function's blocks, batch by batch.

    Many functions have the same small graph; a batch walks each different one once.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            names = b.schema.names
            counts, ends = b.column(names.index("block_number")).to_pylist(), b.column(names.index("block_edges"))
            inner = ends.values
            outer, cuts, flat = (x.to_numpy(zero_copy_only=False) for x in (ends.offsets, inner.offsets, inner.values))
            there, whole = ends.is_valid().to_numpy(zero_copy_only=False), inner.is_valid().to_numpy(zero_copy_only=False)
            walked: dict = {}
            found = []
            for i, n in enumerate(counts):
                at = outer[i]
                lo, mid, hi = cuts[at:at + 3] if there[i] and outer[i + 1] - at == 2 and whole[at:at + 2].all() else (0, 0, 0)
                form = (n or 0, mid - lo, flat[lo:hi].tobytes())
                if form not in walked:
                    walked[form] = cycles(n or 0, flat[lo:mid].tolist(), flat[mid:hi].tolist())
                found.append(walked[form])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(f) for f in found], pa.int32()), pa.array([max(f, default=0) for f in found], pa.int32())], names=[*names, "loops", "largest_loop"])

    return functions.mapInArrow(run, T.StructType([*functions.schema.fields, T.StructField("loops", T.IntegerType()), T.StructField("largest_loop", T.IntegerType())]))


def flow_stats(graphs: DataFrame, key: str = "hash") -> DataFrame:
    """Control-flow statistics per sample from its functions' blocks, the second half of the graph statistics.

    Blocks, edges between blocks and their ratio; largest, mean and deviation of blocks per function; back edges (to a block
    that is not later); functions; blocks, edges and back edges per function; functions with loops, loops and the largest
    one.  ``graphs`` has (key, acfg_list) as ``parse_graphs`` gives it; samples without functions have zeros.
    """
    per = graphs.select(key, F.explode_outer("acfg_list").alias("f")).select(key, F.col("f").isNotNull().cast("int").alias("is_function"), F.coalesce("f.block_number", F.lit(0)).alias("block_number"), F.col("f.block_edges").alias("block_edges"))
    ends = F.arrays_zip(F.get("block_edges", F.lit(0)).alias("s"), F.get("block_edges", F.lit(1)).alias("d"))
    per = loops_of(per.withColumns({"edges": F.coalesce(F.size(F.get("block_edges", F.lit(0))), F.lit(0)), "back": F.coalesce(F.size(F.filter(ends, lambda x: x["d"] <= x["s"])), F.lit(0))}).withColumn("edges", F.greatest("edges", F.lit(0))).withColumn("back", F.greatest("back", F.lit(0))))
    own = F.when(F.col("is_function") == 1, F.col("block_number"))
    g = per.groupBy(key).agg(F.sum("block_number").alias("blocks"), F.sum("edges").alias("block_edges"), F.max(own).alias("max_blocks"), F.avg(own).alias("mean_blocks"), F.stddev_pop(own).alias("std_blocks"), F.sum("back").alias("back_edges"),
                             F.sum("is_function").alias("functions"), positive(F.col("loops") > 0).alias("looping"), F.sum("loops").alias("loops"), F.max("largest_loop").alias("largest_loop"))
    some = lambda c: F.coalesce(c, F.lit(0.0))
    return g.select(key, "blocks", "block_edges", some(ratio(F.col("block_edges"), F.col("blocks"))).alias("edges_per_block"), F.coalesce("max_blocks", F.lit(0)).alias("max_blocks"), some(F.col("mean_blocks")).alias("mean_blocks"),
                    some(F.col("std_blocks")).alias("std_blocks"), "back_edges", "functions", some(ratio(F.col("blocks"), F.col("functions"))).alias("blocks_per_function"), some(ratio(F.col("block_edges"), F.col("functions"))).alias("edges_per_function"),
                    some(ratio(F.col("back_edges"), F.col("functions"))).alias("back_per_function"), "looping", "loops", "largest_loop")


def locate(points: DataFrame, ranges: DataFrame, key: str, width: int) -> DataFrame:
    """First range (smallest ``ord``) of the same key that contains each point, NULL where none does.

    ``points``: (key, point_id, point); ``ranges``: (key, ord, lo, hi) with half-open [lo, hi).  Both sides meet in bins, so a key
    with many ranges is spread over them.  Bins have ``width`` times a power of two: a range takes the first size not below its
    own length, so it lies in three bins at most however wide it is, and a point looks into one bin of every size in use.
    """
    level = F.when(F.col("hi") - F.col("lo") > width, F.ceil(F.log2((F.col("hi") - F.col("lo")) / float(width)))).otherwise(0).cast("int")
    bin_of = lambda x: F.floor(x / (F.pow(F.lit(2.0), F.col("__level")) * float(width)))
    r = ranges.where("hi > lo").select(key, "ord", "lo", "hi", level.alias("__level"))
    sizes = sorted(x[0] for x in r.select("__level").distinct().collect())  # at most one row per power of two
    r = r.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("lo")), bin_of(F.col("hi")))))
    p = points.withColumn("__level", F.explode(F.array(*[F.lit(s) for s in sizes]).cast("array<int>"))).withColumn("__bin", bin_of(F.col("point")))
    hit = p.join(r, [key, "__level", "__bin"]).where((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
    first = hit.groupBy(key, "point_id").agg(F.min("ord").alias("ord"), F.min_by("lo", "ord").alias("lo"))
    return points.join(first, [key, "point_id"], "left").select("point_id", key, "point", "ord", F.when(F.col("lo").isNotNull(), F.col("point") - F.col("lo")).otherwise(F.col("point")).alias("offset"))


def in_last_range(points: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Whether the point of each key lies in the range with the greatest end (first such range on ties)."""
    last = ranges.groupBy(key).agg(F.max_by(F.struct("lo", "hi"), F.struct(F.col("hi"), -F.col("ord"))).alias("r"))
    return points.join(last, key, "left").select(key, "point", F.coalesce((F.col("point") >= F.col("r.lo")) & (F.col("point") < F.col("r.hi")), F.lit(False)).alias("in_last"))


def overlaps(regions: DataFrame, key: str, views: list[str]) -> DataFrame:
    """(va, vb, overlapping keys, isolated) for every pair of views, va < vb; intervals are half-open [lo, hi).

    Two regions overlap exactly when the later-starting one starts before the other ends.  A running maximum of the ends
    per view over regions in start order finds that in one ordered pass, without pairing regions.
    """
    base = regions.where("hi > lo").select(key, "view", "lo", "hi")
    # equal starts always overlap; ordering them by view keeps each pair visible from its later member
    rank = F.array_position(F.array(*[F.lit(v) for v in views]), F.col("view")).cast("int")
    measures = [Measure(f"__e{i}", F.when(F.col("view") == v, F.col("hi")), "max") for i, v in enumerate(views)]
    ran = running(base.withColumn("__v", rank), [key], real_digits(F.col("lo")), [F.col("lo"), F.col("__v"), F.col("hi")], measures, inclusive=False)
    seen = ran.select(key, "view", F.array(*[F.coalesce(F.col(f"__e{i}") > F.col("lo"), F.lit(False)) for i in range(len(views))]).alias("__o"))
    pairs = seen.select(key, F.col("view").alias("x"), F.posexplode("__o").alias("__i", "__hit")).where("__hit") \
        .select(key, "x", F.element_at(F.array(*[F.lit(v) for v in views]), F.col("__i") + 1).alias("y")).where("x <> y")
    hit = pairs.select(key, F.least("x", "y").alias("va"), F.greatest("x", "y").alias("vb")).distinct().groupBy("va", "vb").agg(F.count(F.lit(1)).alias("keys"))
    from quorate.functions.rows import literal_rows
    every = literal_rows(regions.sparkSession, [(a, b) for a in views for b in views if a < b], "va string, vb string")
    return F.broadcast(every).join(hit, ["va", "vb"], "left").select("va", "vb", F.coalesce("keys", F.lit(0)).alias("keys"), F.col("keys").isNull().alias("isolated"))


# Weights and limits of the packing heuristics.
HIGH_ENTROPY, HIGH_ENTROPY_POINTS = 7.0, 10
MANY_ENTROPY, MANY_ENTROPY_POINTS = 6.5, 10
FEW_IMPORTS, FEW_IMPORTS_POINTS = 15, 15
WRITABLE_CODE, WRITABLE_CODE_POINTS = 0xE0000000, 15
ENTRY_LAST_POINTS = 15
HEURISTIC_CAP, EXACT_CAP, DETECT_AT = 40, 60, 35


def heuristic_score(sections: DataFrame, imports: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Heuristic points per sample from section entropies, import count, writable code and entry position.

    ``sections``: (key, ord, entropy, flags, lo, hi); ``imports``: (key, n_imports); ``entries``: (key, point).
    """
    s = sections.groupBy(key).agg(F.max("entropy").alias("top"), positive(F.col("entropy") >= MANY_ENTROPY).alias("many"),
                                  F.max(F.col("flags").bitwiseAND(F.lit(WRITABLE_CODE)) == WRITABLE_CODE).alias("rwx"))
    last = in_last_range(entries, sections.select(key, "ord", "lo", "hi"), key)
    j = s.join(imports, key, "left").join(last, key, "left")
    pts = lambda cond, n: F.when(cond, n).otherwise(0)
    total = (pts(F.col("top") >= HIGH_ENTROPY, HIGH_ENTROPY_POINTS) + pts(F.col("many") >= 2, MANY_ENTROPY_POINTS)
             + pts(F.col("n_imports").between(1, FEW_IMPORTS), FEW_IMPORTS_POINTS) + pts(F.col("rwx"), WRITABLE_CODE_POINTS) + pts(F.col("in_last"), ENTRY_LAST_POINTS))
    return j.select(key, F.least(total, F.lit(HEURISTIC_CAP)).alias("heuristic"))


def family_evidence(evidence: DataFrame, key: str) -> DataFrame:
    """Score and confidence per (sample, family) from summed evidence weights."""
    w = evidence.groupBy(key, "family").agg(F.sum("weight").alias("weight"))
    return w.select(key, "family", "weight", F.least(F.lit(EXACT_CAP), 20 + (F.col("weight") - 1) * 12).cast("int").alias("score"),
                    F.when(F.col("weight") >= 3, "high").when(F.col("weight") >= 2, "medium").otherwise("low").alias("confidence"))


def anomaly_score(sections: DataFrame, imports: DataFrame, entries: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Combined packing verdict per sample."""
    heur = heuristic_score(sections, imports, entries, key)
    fam = family_evidence(evidence, key).groupBy(key).agg(
        F.least(F.lit(EXACT_CAP), F.sum("score")).alias("exact"), F.max(F.col("confidence") == "high").alias("high"), F.max(F.col("confidence") == "medium").alias("medium"))
    j = heur.join(fam, key, "full_outer").withColumns({"heuristic": F.coalesce("heuristic", F.lit(0)), "exact": F.coalesce("exact", F.lit(0)).cast("int")})
    total = F.least(F.lit(100), F.col("exact") + F.col("heuristic"))
    conf = (F.when(F.col("high").isNotNull(), F.when(F.col("high") | (total >= 65), "high").when(F.col("medium"), "medium").otherwise("low"))
            .when(F.col("heuristic") >= DETECT_AT, "medium"))
    return j.select(key, "heuristic", "exact", total.alias("packed_score"), conf.isNotNull().alias("detected"), conf.alias("confidence"))


def leakage(original: DataFrame, modified: DataFrame, groups: dict[str, tuple[int, int]], key: str = "sample_id") -> DataFrame:
    """Mean, population deviation and maximum of the L1 change per (transform, feature group), and the share of exact zeros."""
    j = original.select(key, F.col("vec").alias("a")).join(modified.select(key, "transform", F.col("vec").alias("b")), key)
    diff = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    j = j.select("transform", diff.alias("__d"))
    l1 = lambda lo, hi: F.aggregate(F.slice("__d", lo + 1, hi - lo), F.lit(0.0), lambda acc, x: acc + x)
    long = j.select("transform", F.inline(F.array(*[F.struct(F.lit(g).alias("grp"), l1(lo, hi).alias("l1")) for g, (lo, hi) in groups.items()])))
    return long.groupBy("transform", "grp").agg(F.count(F.lit(1)).alias("n"), F.avg("l1").alias("mean_l1"), F.stddev_pop("l1").alias("std_l1"), F.max("l1").alias("max_l1"),
                                                F.avg((F.col("l1") == 0).cast("double")).alias("zero_rate"))
