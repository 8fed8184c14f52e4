"""Ranks, running totals, percentiles and rank statistics over orders of any size.

A plain ``Window.orderBy`` pulls a whole group into one task.  Here the order key is cut into *digits*, small
integers that refine the order from left to right.  Totals are kept per digit prefix, so every window sees one
prefix only.  Texts have no fixed number of digits; they are ranked over range partitions instead (``rank_text``).  Results equal the plain window, also when one group holds
most of the rows.  Group columns must not be NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.session import reliable_table


@dataclass(frozen=True)
class Measure:
    """A running measure: ``kind`` is ``sum``, ``max`` or ``min`` of ``col``."""

    name: str
    col: Column
    kind: str = "sum"

    def agg(self, col: Column) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](col)

    def combine(self, a: Column, b: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        return F.greatest(a, b) if self.kind == "max" else F.least(a, b)


def hash_digits(hex_col: Column) -> list[Column]:
    """Digits of a hex digest: already uniform, two levels of 4,096."""
    return [F.conv(F.substring(hex_col, 1 + 3 * i, 3), 16, 10).cast("int") for i in range(2)]


def real_digits(value: Column) -> list[Column]:
    """Digits of any real number, in order: sign, exponent and 36 bits of the mantissa, cut into three.

    At most 65,536 different values share a full prefix, whatever their size or closeness; NaN comes last, as Spark sorts it.
    Logarithm and quotient are monotone, so an exponent that is one off next to a power of two does not break the order:
    the mantissa then lies just outside [1, 2), for which the digits leave room.
    """
    v = value.cast("double")
    # infinity and NaN share the digits of the largest double; the order column decides there
    size = F.least(F.abs(v), F.lit(1.7976931348623157e308))
    # 2 to the exponent must not overflow, and below 2^-1022 quotients would lose their order; the logarithm of 0 is NULL
    exponent = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022))
    mantissa = F.floor((size / F.pow(F.lit(2.0), exponent.cast("double")) + 0.1) * float(1 << 36)).cast("bigint")
    positive = F.coalesce(F.when(size > 0, (exponent + 1023) * (1 << 38) + mantissa), (v * 0).cast("bigint"))
    key = positive * F.when(v < 0, -1).otherwise(1)
    return [F.shiftright(key, 32).cast("int")] + [F.shiftright(key, s).bitwiseAND(F.lit(65535)).cast("int") for s in (16, 0)]


def id_digits(value: Column) -> list[Column]:
    """Digits of a non-negative integer key; at most 65,536 keys share a full prefix."""
    v = value.cast("bigint")
    return [F.shiftright(v, 32).cast("int"), F.shiftright(v, 16).bitwiseAND(F.lit(65535)).cast("int")]


def _digit_columns(df: DataFrame, digits: list[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"__d{i}" for i in range(len(digits))]
    return df.select("*", *[d.alias(n) for d, n in zip(digits, names)]), names


def running(df: DataFrame, keys: list[str], digits: list[Column], order: list[Column], measures: list[Measure],
            inclusive: bool = True) -> DataFrame:
    """Add running measures per ``keys`` in the order (digits, ``order``); ``inclusive`` counts the row itself."""
    base, ds = _digit_columns(df, digits)
    raw = [f"__m{i}" for i in range(len(measures))]
    base = base.select("*", *[m.col.alias(r) for m, r in zip(measures, raw)])

    totals: list[DataFrame] = []
    source = base
    for depth in range(len(ds), 0, -1):
        source = source.groupBy(*keys, *ds[:depth]).agg(*[m.agg(F.col(r)).alias(r) for m, r in zip(measures, raw)])
        totals.append(source)
    totals.reverse()

    offsets: DataFrame | None = None
    offset_names = [f"__o{i}" for i in range(len(measures))]
    for depth, total in enumerate(totals):
        prefix = keys + ds[:depth]
        w = Window.partitionBy(*prefix).orderBy(ds[depth]).rowsBetween(Window.unboundedPreceding, -1)
        level = total.select(*prefix, ds[depth], *[m.agg(F.col(r)).over(w).alias(f"__l{i}")
                                                  for i, (m, r) in enumerate(zip(measures, raw))])
        if offsets is None:
            offsets = level.select(*prefix, ds[depth], *[F.col(f"__l{i}").alias(o) for i, o in enumerate(offset_names)])
        else:
            offsets = level.join(offsets, prefix).select(
                *prefix, ds[depth],
                *[m.combine(F.col(o), F.col(f"__l{i}")).alias(o) for i, (m, o) in enumerate(zip(measures, offset_names))])

    prefix = keys + ds
    w = Window.partitionBy(*prefix).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    leaf = base.select("*", *[m.agg(F.col(r)).over(w).alias(f"__l{i}") for i, (m, r) in enumerate(zip(measures, raw))])
    joined = leaf.join(offsets, prefix)
    return joined.select(*df.columns, *[m.combine(F.col(o), F.col(f"__l{i}")).alias(m.name)
                                        for i, (m, o) in enumerate(zip(measures, offset_names))])


def rank0(df: DataFrame, keys: list[str], digits: list[Column], order: list[Column], name: str = "rank0") -> DataFrame:
    """Zero-based ``row_number`` per ``keys``."""
    return running(df, keys, digits, order, [Measure(name, F.lit(1).cast("bigint"))], inclusive=False)


def rank_text(df: DataFrame, col: str, name: str = "rank0") -> DataFrame:
    """Zero-based rank of distinct strings: range partitions, numbered inside and shifted by the rows before them.

    The range bounds come from a sample, so the partitions are written once before both numbers are read from them.
    """
    parts = reliable_table(df.repartitionByRange(F.col(col)).sortWithinPartitions(col).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")))
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__first"))  # one row per partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("__p", (before - F.col("__first")).alias("__shift"))
    return parts.join(F.broadcast(shift), "__p").select(*df.columns, (F.col("__m") + F.col("__shift")).cast("bigint").alias(name))


def _fold(df: DataFrame, keys: list[str], ds: list[str], order: str, before: dict[str, str], agg) -> DataFrame:
    """Collapse ordered rows prefix by prefix.  ``before`` maps new column -> column summed over earlier siblings."""
    current = df
    for depth in range(len(ds), -1, -1):
        prefix = keys + ds[:depth]
        w = Window.partitionBy(*prefix).orderBy(order if depth == len(ds) else ds[depth]) \
            .rowsBetween(Window.unboundedPreceding, -1)
        current = current.select("*", *[F.coalesce(F.sum(src).over(w), F.lit(0)).alias(dst) for dst, src in before.items()])
        current = current.groupBy(*prefix).agg(*agg)
    return current


def auc(df: DataFrame, keys: list[str], score: str, label: str, name: str = "auc") -> DataFrame:
    """ROC AUC with average ranks for ties, NULL where only one class is present.

    Equal scores are merged before the shuffle; then pairs won are folded up the digit prefixes.
    """
    leaf = (df.where(F.col(score).isNotNull())
            .groupBy(*keys, F.col(score).alias("__v"))
            .agg(F.sum(F.col(label).cast("double")).alias("pos"), F.sum(F.lit(1.0) - F.col(label)).alias("neg")))
    leaf, ds = _digit_columns(leaf.withColumn("wins", F.col("pos") * F.col("neg") * 0.5), real_digits(F.col("__v")))
    folded = _fold(leaf, keys, ds, "__v", {"below": "neg"},
                   [F.sum(F.col("wins") + F.col("pos") * F.col("below")).alias("wins"), F.sum("pos").alias("pos"),
                    F.sum("neg").alias("neg")])
    pairs = F.col("pos") * F.col("neg")
    return folded.select(*keys, F.when(pairs > 0, F.col("wins") / pairs).alias(name))


def ks_statistic(df: DataFrame, keys: list[str], value: str, side: str, name: str = "ks") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per ``keys``; ``side`` is 0 or 1.  Also returns both sample sizes."""
    leaf = df.groupBy(*keys, F.col(value).alias("__v")).agg(
        F.sum(F.lit(1.0) - F.col(side)).alias("a"), F.sum(F.col(side).cast("double")).alias("b"))
    sizes = leaf.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    leaf = leaf.join(F.broadcast(sizes), keys) if keys else leaf.crossJoin(F.broadcast(sizes))
    gap = F.coalesce(F.col("a") / F.nullif(F.col("na"), F.lit(0.0)), F.lit(0.0)) - F.coalesce(
        F.col("b") / F.nullif(F.col("nb"), F.lit(0.0)), F.lit(0.0))
    leaf = leaf.select(*keys, "__v", "a", "b", gap.alias("gap"), gap.alias("hi"), gap.alias("lo"))
    leaf, ds = _digit_columns(leaf, real_digits(F.col("__v")))
    folded = _fold(leaf, keys, ds, "__v", {"before": "gap"},
                   [F.max(F.col("before") + F.col("hi")).alias("hi"), F.min(F.col("before") + F.col("lo")).alias("lo"),
                    F.sum("gap").alias("gap"), F.sum("a").alias("a"), F.sum("b").alias("b")])
    return folded.select(*keys, F.greatest(F.abs("hi"), F.abs("lo")).alias(name), F.col("a").cast("bigint").alias("n_a"),
                         F.col("b").cast("bigint").alias("n_b"))


def ks_against(ref: DataFrame, df: DataFrame, keys: list[str], value: str, name: str = "ks") -> DataFrame:
    """Kolmogorov-Smirnov distance of every group of ``df`` to all rows of one reference; also both sample sizes.

    Between two values of a group its distribution stands still and the reference's can only rise, so the largest gaps lie at the
    group's own values.  One ordered fold over all values therefore serves every group: it carries one count of the reference
    and one per group.  Rows are range partitioned by value; a partition reports per group its counts and its largest gaps
    from its own start, and the partitions (so many rows per group, which is what comes to the driver) are joined in order.
    Groups are few: they are report periods.
    """
    spark = df.sparkSession
    own = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    base = ref.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    base = base.select(*[F.lit(None).cast(t).alias(k) for k, t in own.dtypes if k in keys], "__v", "__n", F.lit(True).alias("__ref"))
    rows = reliable_table(own.select(*keys, "__v", "__n", F.lit(False).alias("__ref")).union(base))
    sizes = rows.groupBy("__ref", *keys).agg(F.sum("__n").alias("n")).collect()
    n_a = sum(r["n"] for r in sizes if r["__ref"])
    groups = sorted(((tuple(r[k] for k in keys), r["n"]) for r in sizes if not r["__ref"]), key=repr)
    schema = ", ".join([f"{k} {t}" for k, t in own.dtypes if k in keys] + [f"{name} double", "n_a bigint", "n_b bigint"])
    if not groups:
        return spark.createDataFrame([], schema)
    number = F.create_map(*[x for i, (g, _) in enumerate(groups) for x in (F.struct(*[F.lit(v).cast(dict(own.dtypes)[k]).alias(k) for k, v in zip(keys, g)]).cast("string"), F.lit(i))])
    flat = rows.select("__v", "__n", F.when(F.col("__ref"), -1).otherwise(number[F.struct(*keys).cast("string")]).alias("__g"))
    n_b = [n for _, n in groups]

    def fold(batches):
        count_a, count_b = 0, np.zeros(len(n_b))
        high, low = np.full(len(n_b), -np.inf), np.full(len(n_b), -np.inf)
        first, last = None, (None, 0)  # last value of the reference and how often it stands there
        for b in batches:
            v, n, g = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(v):
                continue
            first = v[0] if first is None else first
            mine = g < 0
            upto = count_a + np.cumsum(np.where(mine, n, 0))
            at_v, at_n = (np.append(last[0], v[mine]), np.append(last[1], n[mine])) if last[0] is not None else (v[mine], n[mine])
            place = np.searchsorted(at_v, v) if len(at_v) else np.zeros(len(v), dtype=int)
            inside = place < len(at_v)
            here = np.zeros(len(v))
            here[inside] = np.where(at_v[place[inside]] == v[inside], at_n[place[inside]], 0)
            for k in np.unique(g[~mine]):
                own_rows = g == k
                c = count_b[k] + np.cumsum(n[own_rows])
                high[k] = max(high[k], (c / n_b[k] - upto[own_rows] / max(n_a, 1)).max())
                low[k] = max(low[k], ((upto - here)[own_rows] / max(n_a, 1) - (c - n[own_rows]) / n_b[k]).max())
                count_b[k] = c[-1]
            count_a = upto[-1]
            if mine.any():
                last = (v[mine][-1], n[mine][-1])
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n_b), first)), pa.array(np.full(len(n_b), float(count_a))), pa.array(np.arange(len(n_b), dtype=np.int32)), pa.array(count_b), pa.array(high), pa.array(low)],
                                             names=["first", "a", "g", "b", "high", "low"])

    # the reference comes before the groups at the same value
    parts = flat.repartitionByRange("__v").sortWithinPartitions("__v", "__g").mapInArrow(fold, "first double, a double, g int, b double, high double, low double").toPandas()
    out = []
    for k, (group, n) in enumerate(groups):
        p = parts[parts.g == k].sort_values("first")
        start = (p.b.cumsum() - p.b) / n - (p.a.cumsum() - p.a) / max(n_a, 1)
        gap = max((p.high + start).max(), (p.low - start).max(), 0.0)
        out.append((*group, float(gap), int(n_a), int(n)))
    return spark.createDataFrame(out, schema)


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation; ``points`` maps output name -> fraction."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    cum = running(counts, keys, real_digits(F.col("__v")), [F.col("__v")], [Measure("__c", F.col("__n"))])
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__t"))
    cum = cum.join(F.broadcast(total), keys) if keys else cum.crossJoin(F.broadcast(total))
    aggs, outs = [], []
    for i, (name, p) in enumerate(points.items()):
        at = F.lit(float(p)) * (F.col("__t") - 1)
        aggs += [F.min(F.when(F.col("__c") > F.floor(at), F.col("__v"))).alias(f"__lo{i}"),
                 F.min(F.when(F.col("__c") > F.ceil(at), F.col("__v"))).alias(f"__hi{i}"),
                 F.first(at - F.floor(at)).alias(f"__f{i}")]
        outs.append((F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}")).alias(name))
    return cum.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def value_at(df: DataFrame, keys: list[str], value: str, position: Column, name: str) -> DataFrame:
    """The value at a zero-based position of the sorted column; ``position`` may use the row count ``n``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    cum = running(counts, keys, real_digits(F.col("__v")), [F.col("__v")], [Measure("__c", F.col("__n"))])
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("n"))
    cum = cum.join(F.broadcast(total), keys) if keys else cum.crossJoin(F.broadcast(total))
    return cum.groupBy(*keys).agg(F.min(F.when(F.col("__c") > position, F.col("__v"))).alias(name))
