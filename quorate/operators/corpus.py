"""Building labelled, deduplicated corpora split by period."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions.columns import finite, positive, ratio, seeded_order
from quorate.functions.rows import literal_rows
from quorate.operators.ordering import hash_digits, id_digits, rank0, running, Measure, rank_text

# ---- projections and filters -------------------------------------------------------------------------------------


def labelled(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) >= 0)


def binarise(col: Column) -> Column:
    return F.when(col > 0, 1).otherwise(0)


def binarise_class(col: Column) -> Column:
    """Text class to label: everything but "benign" (any case) is 1."""
    return F.when(F.lower(col) != "benign", 1).otherwise(0)


def clean_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in cols})


def clean_vector(col: Column) -> Column:
    return F.transform(col, lambda x: finite(x))


def index_category(df: DataFrame, col: str, name: str = "idx") -> DataFrame:
    """Dense integer of a category in sorted order, from the distinct values only."""
    cats = df.select(col).where(F.col(col).isNotNull()).distinct()
    ranked = rank_text(cats, col, name)
    return df.join(ranked, col, "left")


# Width by file size, upper bounds exclusive in bytes.
WIDTH_STEPS = [(10 * 1024, 32), (30 * 1024, 64), (60 * 1024, 128), (100 * 1024, 256), (200 * 1024, 384), (500 * 1024, 512),
               (1000 * 1024, 768)]
WIDTH_LAST = 1024


def size_bucket(size: Column) -> Column:
    out = F.lit(WIDTH_LAST)
    for bound, width in reversed(WIDTH_STEPS):
        out = F.when(size < bound, width).otherwise(out)
    return out


# Verdict codes.
STATUS_LABELS = {-1: "Error", 0: "Benign", 1: "Malicious", 2: "DriftSuspect"}


def status(pred: Column, drift_candidate: Column, failed: Column | None = None) -> Column:
    code = F.when(pred == 1, 1).when(drift_candidate, 2).otherwise(0)
    return code if failed is None else F.when(failed, -1).otherwise(code)


def status_label(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv]), code)


# ---- deduplication and grouping keys -------------------------------------------------------------------------------


def dedup_content(df: DataFrame, digest: str = "sha256", path: str = "path") -> DataFrame:
    """One row per digest, first path wins, with the number of dropped copies.

    An aggregate with map-side combine, so a digest shared by a third of all rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in (digest, path)]
    best = df.groupBy(digest).agg(F.min_by(F.struct(path, *rest), F.struct(path, *rest[:1])).alias("__b"), F.count(F.lit(1)).alias("__n"))
    return best.select(digest, "__b.*", (F.col("__n") - 1).alias("duplicates"))


def group_key(mode: str, sha256: Column, imphash: Column | None = None, prefix: Column | None = None) -> Column:
    """Near-family key: import-set hash first, then content prefix hash, then the digest itself."""
    keys = []
    if mode == "imphash" and imphash is not None:
        keys.append(F.when(F.length(imphash) > 0, F.concat(F.lit("imp:"), imphash)))
    if prefix is not None:
        keys.append(F.when(F.length(prefix) > 0, F.concat(F.lit("raw:"), F.substring(prefix, 1, 16))))
    keys.append(F.concat(F.lit("sha:"), sha256))
    return F.coalesce(*keys)


# ---- summaries ---------------------------------------------------------------------------------------------------


def contingency(df: DataFrame) -> DataFrame:
    """Counts per period and class plus share and zero-class flag."""
    g = df.groupBy("period").agg(F.count(F.lit(1)).alias("n"), positive(F.col("label") == 1).alias("malware"),
                                 positive(F.col("label") == 0).alias("benign"), positive(F.col("label") < 0).alias("unknown"))
    return g.withColumn("malware_ratio", ratio(F.col("malware"), F.col("malware") + F.col("benign"))) \
        .withColumn("class_is_zero", (F.col("malware") == 0) | (F.col("benign") == 0))


def split_totals(df: DataFrame, train: list[int], evaluation: list[int]) -> DataFrame:
    """Class totals per split (train or eval)."""
    side = F.when(F.col("period").isin(train), "train").when(F.col("period").isin(evaluation), "eval")
    return df.withColumn("split", side).where(F.col("split").isNotNull()).groupBy("split").agg(
        positive(F.col("label") == 1).alias("malware"), positive(F.col("label") == 0).alias("benign")) \
        .withColumn("class_is_zero", (F.col("malware") == 0) | (F.col("benign") == 0))


def summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), positive(F.col("label") == 1).alias("malware"), positive(F.col("label") == 0).alias("benign"),
                  F.countDistinct("family").alias("n_families")).withColumn("malware_ratio", F.round(ratio(F.col("malware"), F.col("n")), 4))


def validate(df: DataFrame, vec: str | None = None, train: list[int] | None = None, evaluation: list[int] | None = None, offsets: DataFrame | None = None) -> DataFrame:
    """Dataset contract as rows (check, ok, detail) from a single aggregation pass.

    With ``vec`` the vectors must not all be zero; with ``train`` or ``evaluation`` some period of each must have rows; with
    ``offsets`` (period, start, count) the counts must add up to the rows.  Details are the offending or supporting counts.
    """
    zero_row = F.lit(False) if vec is None else ~F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))
    of = lambda periods: positive(F.col("period").isin(list(periods or [])))
    a = df.agg(F.count(F.lit(1)).alias("n"), positive(~F.col("label").isin(0, 1)).alias("bad_labels"), positive(F.col("label") == 1).alias("mal"),
               F.countDistinct("period").alias("periods"), F.min("period").alias("first"), positive(zero_row).alias("zero_rows"),
               of(train).alias("train_rows"), of(evaluation).alias("eval_rows"))
    if offsets is not None:
        a = a.crossJoin(F.broadcast(offsets.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("offset_rows"))))
    share = ratio(F.col("mal"), F.col("n"))
    rows = [("not_empty", F.col("n") > 0, F.col("n")), ("labels_binary", F.col("bad_labels") == 0, F.col("bad_labels")),
            ("class_share", (share > 0.01) & (share < 0.99), F.col("mal")), ("two_periods", F.col("periods") >= 2, F.col("periods")),
            ("positive_periods", F.col("first") > 0, F.col("first").cast("bigint")),
            ("not_all_zero", F.col("zero_rows") < F.col("n"), F.col("zero_rows"))]
    rows += [(f"{name}_periods", F.col(f"{name}_rows") > 0, F.col(f"{name}_rows")) for name, given in (("train", train), ("eval", evaluation)) if given is not None]
    if offsets is not None:
        rows.append(("offsets_total", F.col("offset_rows") == F.col("n"), F.col("offset_rows")))
    return a.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("ok"), det.cast("bigint").alias("detail")) for n, ok, det in rows])))


def coverage(df: DataFrame, views: list[str], column: str = "views", allow_partial: bool = False) -> DataFrame:
    """Share of samples that provide each view and the resulting gate: full, partial or none."""
    a = df.agg(F.count(F.lit(1)).alias("n"), *[positive(F.array_contains(F.map_keys(column), v)).alias(f"v{i}") for i, v in enumerate(views)])
    long = a.select(F.inline(F.array(*[F.struct(F.lit(v).alias("view"), F.col(f"v{i}").alias("present"), F.col("n").alias("n")) for i, v in enumerate(views)])))
    share = ratio(F.col("present"), F.col("n"))
    gate = F.when(F.col("present") == 0, "downgrade").when((F.col("present") < F.col("n")) & F.lit(not allow_partial), "fail").otherwise("pass")
    return long.select("view", "present", "n", share.alias("coverage"), gate.alias("gate"))


def period_offsets(df: DataFrame) -> DataFrame:
    """Start and count of each period in sorted order."""
    counts = df.groupBy("period").agg(F.count(F.lit(1)).alias("count"))
    w = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("period", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("start"), "count")


# ---- period assignment ---------------------------------------------------------------------------------------------


def _with_total(df: DataFrame, keys: list[str], name: str = "__total") -> DataFrame:
    """Attach the number of rows of each split or class: a handful of rows, so the rows themselves don't move."""
    totals = F.broadcast(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)))
    return df.join(totals, keys) if keys else df.crossJoin(totals)


def _others(df: DataFrame, name: str) -> list[str]:
    return [c for c in df.columns if c != name]


def equal_blocks(rank: Column, total: Column, n: int | Column) -> Column:
    """Block of a rank when ``total`` rows are cut into ``n`` equal blocks, the remainder in the last one."""
    n = F.lit(n) if isinstance(n, int) else n
    per = F.greatest(F.floor(total / n), F.lit(1))
    return F.least(F.floor(rank / per) + 1, n).cast("int")


def assign_periods(df: DataFrame, time: str, time_digits: list[Column], row: str, lo: int = 6, hi: int = 18, name: str = "period") -> DataFrame:
    """Equal-count periods in time order; their number is the distinct times clamped to [lo, hi]."""
    stats = df.agg(F.count(F.lit(1)).alias("__total"), F.countDistinct(time).alias("__times"))
    ranked = rank0(df, [], time_digits + id_digits(F.col(row)), [F.col(time), F.col(row)], "__r")
    n = F.greatest(F.least(F.col("__times").cast("int"), F.lit(hi)), F.lit(lo))
    return ranked.crossJoin(F.broadcast(stats)).select(*_others(df, name), equal_blocks(F.col("__r"), F.col("__total"), n).alias(name))


def assign_split_periods(df: DataFrame, split: str, row: str, train_blocks: int = 13, eval_blocks: int = 3, name: str = "period") -> DataFrame:
    """Row-order blocks inside each split; ``split`` is 0 for train and 1 for eval."""
    ranked = _with_total(rank0(df, [split], id_digits(F.col(row)), [F.col(row)], "__r"), [split])
    block = F.when(F.col(split) == 0, equal_blocks(F.col("__r"), F.col("__total"), train_blocks)).otherwise(
        equal_blocks(F.col("__r"), F.col("__total"), eval_blocks) + train_blocks)
    return ranked.select(*_others(df, name), block.alias(name))


def round_robin(df: DataFrame, parts: list[str], row: str, n: int = 12, seed: int = 42, name: str = "period") -> DataFrame:
    """Deal rows of each part over ``n`` periods in seeded order."""
    with_key = df.withColumn("__h", seeded_order(F.col(row), seed))
    ranked = rank0(with_key, parts, hash_digits(F.col("__h")), [F.col("__h"), F.col(row)], "__r")
    return ranked.select(*_others(df, name), (F.col("__r") % n + 1).cast("int").alias(name))


def _attach_groups(df: DataFrame, groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.drop(name).join(groups.select(*keys, name), keys)


def assign_grouped(df: DataFrame, label: str, group: str, n: int = 12, seed: int = 42, name: str = "period") -> DataFrame:
    """Whole groups dealt over periods per label, so no group crosses a period."""
    groups = df.select(label, group).distinct().withColumn("__h", seeded_order(F.col(group), seed))
    ranked = rank0(groups, [label], hash_digits(F.col("__h")), [F.col("__h"), F.col(group)], "__r")
    return _attach_groups(df, ranked.withColumn(name, (F.col("__r") % n + 1).cast("int")), [label, group], name)


def assign_balanced(df: DataFrame, label: str, group: str, n: int = 12, seed: int = 42, name: str = "period") -> DataFrame:
    """Whole groups, largest first, dealt 1..n then n..1 per label, which keeps the period loads even."""
    groups = df.groupBy(label, group).agg(F.count(F.lit(1)).alias("__size")).withColumn("__h", seeded_order(F.col(group), seed))
    size = F.col("__size")
    power = F.floor(F.log2(size)).cast("int")
    within = F.floor((size / F.pow(F.lit(2.0), power) - 1) * 1024).cast("int")
    # below 1,024 rows the two digits are the exact size, and groups of one size, usually most, spread by their hash; above, equal
    # digits may hide different sizes, whose order comes first
    exact = size < 1024
    spread = [F.when(exact, digit).otherwise(0) for digit in hash_digits(F.col("__h"))]
    ranked = rank0(groups, [label], [-power, -within, *spread], [F.col("__size").desc(), F.col("__h"), F.col(group)], "__r")
    turn = (F.col("__r") % (2 * n)).cast("int")
    return _attach_groups(df, ranked.withColumn(name, F.when(turn < n, turn + 1).otherwise(F.lit(2 * n) - turn).cast("int")), [label, group], name)


def ramp_quota(total: int, malware: int, n: int = 12, lo: float = 0.15, hi: float = 0.85) -> list[tuple[int, int, int]]:
    """Rows (period, malware, benign): class share rising from ``lo`` to ``hi``, shortage filled from the other class.

    By definition: after k periods of ``total // n`` rows (the last takes the remainder), the malware handed out is the running
    sum of the wanted shares, bounded by what exists above and by what the benign rows leave open below.
    """
    size = [total // n] * (n - 1) + [total - (n - 1) * (total // n)]
    benign = total - malware
    out, given, used = [], 0, 0
    for k, rows in enumerate(size):
        wanted = math.floor(rows * (lo + (hi - lo) * k / max(n - 1, 1)))
        upper = min(malware, given + rows)
        lower = given + max(0, rows - (benign - (used - given)))
        now = min(upper, max(lower, min(given + wanted, malware)))
        out.append((k + 1, now - given, min(rows - (now - given), benign - (used - given))))
        used += out[-1][1] + out[-1][2]
        given = now
    return out


def assign_ramp(df: DataFrame, label: str, row: str, n: int = 12, lo: float = 0.15, hi: float = 0.85, seed: int = 42, name: str = "period") -> DataFrame:
    """Periods with a rising malware share.  Two class counts are read first; they fix an ``n``-row quota table."""
    c = df.agg(F.count(F.lit(1)).alias("n"), positive(F.col(label) == 1).alias("m")).first()
    quota = ramp_quota(c["n"], c["m"], n, lo, hi)
    bounds = {}
    for cls, at in ((1, 1), (0, 2)):
        ends, acc = [], 0
        for q in quota:
            acc += q[at]
            ends.append(acc)
        bounds[cls] = F.array(*[F.lit(e) for e in ends])
    with_key = df.withColumn("__h", seeded_order(F.col(row), seed))
    ranked = rank0(with_key, [label], hash_digits(F.col("__h")), [F.col("__h"), F.col(row)], "__r")
    ends = F.when(F.col(label) == 1, bounds[1]).otherwise(bounds[0])
    passed = F.size(F.filter(ends, lambda e: e <= F.col("__r")))
    # rows beyond the last quota keep the first period, as in the source data layout
    return ranked.select(*_others(df, name), F.when(passed >= n, 1).otherwise(passed + 1).cast("int").alias(name))


def sample_by_period(df: DataFrame, n: int, row: str, keys: list[str] = ["period", "label"], seed: int = 42) -> DataFrame:
    """At most ``n`` rows per (period, label) in seeded order; tasks keep only their own first ``n`` before the shuffle.

    Both ways give the same rows: a small ``n`` lets Spark cut each task's part first, a large one is ranked without a window
    over a whole group.
    """
    with_key = df.withColumn("__h", seeded_order(F.col(row), seed))
    if n <= 1000:
        w = Window.partitionBy(*keys).orderBy("__h", row)
        return with_key.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).select(*df.columns)
    ranked = rank0(with_key, keys, hash_digits(F.col("__h")), [F.col("__h"), F.col(row)], "__r")
    return ranked.where(F.col("__r") < n).select(*df.columns)


def balance(df: DataFrame, row: str, label: str = "label", seed: int = 42) -> DataFrame:
    """Cut the larger class so both classes have the same number of rows."""
    smallest = df.groupBy(label).count().agg(F.min("count").alias("__cap"))
    with_key = df.withColumn("__h", seeded_order(F.col(row), seed))
    ranked = rank0(with_key, [label], hash_digits(F.col("__h")), [F.col("__h"), F.col(row)], "__r")
    return ranked.crossJoin(F.broadcast(smallest)).where(F.col("__r") < F.col("__cap")).select(*df.columns)


def dense_periods(df: DataFrame, time: str, name: str = "period") -> DataFrame:
    """Dense period numbers over sorted time labels, one row per label."""
    w = Window.orderBy(time)
    return df.select(time).distinct().withColumn(name, F.row_number().over(w))


def train_eval_months(df: DataFrame, time: str) -> DataFrame:
    """Period number and split per time label: the first max(2, floor(2n/3)) periods train, the rest evaluate."""
    periods = dense_periods(df, time)
    n = F.max("period").over(Window.partitionBy())
    cut = F.greatest(F.lit(2), F.floor(n * 2 / 3))
    return periods.withColumn("split", F.when(F.col("period") <= cut, "train").otherwise("eval"))


def split(df: DataFrame, periods: list[int]) -> DataFrame:
    return df.where(F.col("period").isin(periods))


# ---- sorts and samples ---------------------------------------------------------------------------------------------


def sort_periods(df: DataFrame, row: str) -> DataFrame:
    """Order by period, original row order inside (a range-partitioned sort)."""
    return df.orderBy("period", row)


def sortedness(df: DataFrame, row: str) -> DataFrame:
    """Whether periods never decrease in row order, from per-block minima and maxima instead of a global window."""
    bounds = running(df, [], id_digits(F.col(row)), [F.col(row)], [Measure("__seen", F.col("period"), "max")], inclusive=False)
    return bounds.agg(positive(F.col("period") < F.col("__seen")).alias("descents")).withColumn("is_sorted", F.col("descents") == 0)


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def subsample(df: DataFrame, n: int, row: str, seed: int = 42) -> DataFrame:
    """Seeded sample of ``n`` rows without replacement."""
    return df.orderBy(seeded_order(F.col(row), seed), row).limit(n)


def first_rows(df: DataFrame, n: int, row: str) -> DataFrame:
    return df.orderBy(row).limit(n)


# ---- sets ----------------------------------------------------------------------------------------------------------


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def common_views(features: DataFrame) -> DataFrame:
    """Every view with the number of periods that have it; ``common`` if all do."""
    pairs = features.select("view", "period").distinct()
    n = pairs.agg(F.countDistinct("period").alias("__n"))
    return pairs.groupBy("view").agg(F.count(F.lit(1)).alias("periods")).crossJoin(F.broadcast(n)).select(
        "view", "periods", (F.col("periods") == F.col("__n")).alias("common"))


def partition_models(models: DataFrame, views: DataFrame, only: list[str] = [], exclude: list[str] = [], special: list[str] = []) -> DataFrame:
    """Role of every model: trainable, passthrough (special, kept as is), frozen (view missing) or skipped (by list)."""
    have = views.select("view").distinct().withColumn("__have", F.lit(True))
    m = models.join(have, "view", "left")
    skip = F.lit(False)
    if only:
        skip = ~F.col("model").isin(only)
    if exclude:
        skip = skip | F.col("model").isin(exclude)
    role = F.when(F.col("__have").isNull(), "frozen").when(skip, "skipped")
    if special:
        role = role.when(F.col("model").isin(special), "passthrough")
    return m.select(*models.columns, role.otherwise("trainable").alias("role"))


def set_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys only in ``a`` (missing from b), only in ``b`` (extra) and in both."""
    left = a.select(key).distinct().withColumn("__a", F.lit(1))
    right = b.select(key).distinct().withColumn("__b", F.lit(1))
    side = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").otherwise("both")
    return left.join(right, key, "full_outer").select(key, side.alias("side"))


# ---- incremental work, registries, dimensions -----------------------------------------------------------------------


def todo(items: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Items whose key is in none of the given tables."""
    out = items
    for d in done:
        out = out.join(d.select(key), key, "left_anti")
    return out


def enrich(df: DataFrame, meta: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Attach columns by key, never by row position."""
    return df.join(meta.select(key, *cols), key, "left")


def diff_registry(base: DataFrame, cand: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Differences between two inventories: missing, extra, or changed in the compared columns."""
    b = base.select(key, F.struct(*compare).alias("__b"))
    c = cand.select(key, F.struct(*compare).alias("__c"))
    changed = [F.when(~F.col(f"__b.{x}").eqNullSafe(F.col(f"__c.{x}")), x) for x in compare]
    kind = F.when(F.col("__c").isNull(), "missing").when(F.col("__b").isNull(), "extra").when(~F.col("__b").eqNullSafe(F.col("__c")), "changed")
    return b.join(c, key, "full_outer").select(key, kind.alias("kind"), F.when(F.col("__b").isNotNull() & F.col("__c").isNotNull(),
                                               F.concat_ws(",", *changed)).otherwise("").alias("changed")).where(F.col("kind").isNotNull())


def check_dims(produced: DataFrame, expected: DataFrame) -> DataFrame:
    """Problems per view: missing, inconsistent over periods, not the expected width, below the lower bound.

    ``produced``: (view, period, width); ``expected``: (view, width, lower), either bound may be NULL.
    """
    p = produced.groupBy("view").agg(F.countDistinct("width").alias("__k"), F.min("width").alias("__min"), F.max("width").alias("__max"))
    problem = (F.when(F.col("__k").isNull(), "missing").when(F.col("__k") > 1, "inconsistent")
               .when(F.col("width") != F.col("__max"), "unexpected").when(F.col("__min") < F.col("lower"), "too_small"))
    return expected.join(p, "view", "full_outer").select("view", problem.alias("problem"), F.col("__min").alias("got_min"), F.col("__max").alias("got_max")) \
        .where(F.col("problem").isNotNull())


