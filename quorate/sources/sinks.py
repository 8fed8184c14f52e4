"""Publishing data sets, reports and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions.columns import finite


def write_dataset(df: DataFrame, path: str, order: str = "sample_id", files_per_period: int | None = None) -> None:
    """One partition folder per period, rows ordered inside files.

    Rows are dealt by ranges of (period, order), so a period that holds most rows is written by many tasks and the files of a
    period follow each other in order.  ``files_per_period`` sets a fixed number of writers instead.
    """
    if files_per_period is None:
        dealt = df.repartitionByRange("period", order)
    else:
        dealt = df.withColumn("__slot", F.pmod(F.xxhash64(order), F.lit(files_per_period))).repartition("period", "__slot").drop("__slot")
    dealt.sortWithinPartitions("period", order) \
        .write.mode("overwrite").partitionBy("period").parquet(path)


def index_lines(df: DataFrame) -> DataFrame:
    """Light index: one JSON object (month, label, family) per sample."""
    return df.select(F.to_json(F.struct(F.col("period").alias("month"), "label", "family")).alias("value"))


def write_index(df: DataFrame, path: str) -> None:
    index_lines(df).write.mode("overwrite").text(path)


def report_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text; NaN and infinities become null."""
    cols = [finite(F.col(c), None).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def fixed(col: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", col)


def yes_no(col: Column) -> Column:
    return F.when(col, "Y").otherwise("N")


def summary_rows(df: DataFrame, four: list[str] = [], two: list[str] = [], flags: list[str] = []) -> DataFrame:
    """Flat text columns with the fixed report formats."""
    out = []
    for c in df.columns:
        if c in four:
            out.append(fixed(F.col(c)).alias(c))
        elif c in two:
            out.append(fixed(F.col(c), 2).alias(c))
        elif c in flags:
            out.append(yes_no(F.col(c)).alias(c))
        else:
            out.append(F.col(c).cast("string").alias(c))
    return df.select(*out)


def write_report(df: DataFrame, path: str, **formats: list[str]) -> None:
    report_json(df).write.mode("overwrite").text(f"{path}/results_json")
    summary_rows(df, **formats).write.mode("overwrite").option("header", "true").csv(f"{path}/summary_csv")


def manifest_counts(df: DataFrame) -> DataFrame:
    """Sample count per (period, label) with totals; the small head of a manifest."""
    return df.rollup("period", "label").agg(F.count(F.lit(1)).alias("n"))


def manifest_digests(df: DataFrame, digest: str = "sha256") -> DataFrame:
    """Sorted digest list of the manifest as rows (period, digest), a distributed sort rather than one array per period."""
    return df.select("period", digest).orderBy("period", digest)


def manifest_checksums(df: DataFrame, digest: str = "sha256") -> DataFrame:
    """Order-free checksum of the digests per period: count and wrapped sum of the leading 60 bits."""
    head = F.conv(F.substring(F.col(digest), 1, 12), 16, 10).cast("bigint")
    return df.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum(head.cast("decimal(38,0)")).cast("string").alias("checksum"))


def manifest_fields(df: DataFrame, expected: dict[str, int], train: list[int], evaluation: list[int], counts: dict[int, int] | None = None, views: str = "views") -> DataFrame:
    """The rest of the manifest as rows (field, name, value): what was produced, what was expected, and what differs.

    ``view_width`` (all widths that occur, ascending), ``missing_view`` (expected and never produced), ``train_period`` and
    ``eval_period`` with their rows, and ``problem``: another width than expected, another number of rows than the metadata of a
    period (``counts``) says.  ``df`` has (period, views map); only its widths and periods are aggregated.
    """
    spark = df.sparkSession
    widths = df.select(F.explode(views).alias("view", "vec")).groupBy("view", F.size("vec").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    found: dict[str, list[int]] = {}
    for r in sorted(widths.collect(), key=lambda r: (r["view"], r["width"])):  # a row per view and width
        found.setdefault(r["view"], []).append(r["width"])
    own = {r["period"]: r["n"] for r in df.where(F.col("period").isin([*train, *evaluation, *(counts or {})])).groupBy("period").agg(F.count(F.lit(1)).alias("n")).collect()}
    shown = {v: ",".join(map(str, w)) for v, w in found.items()}
    rows = [("view_width", v, w) for v, w in shown.items()]
    rows += [("missing_view", v, "") for v in sorted(expected) if v not in found]
    rows += [(f"{name}_period", str(p), str(own.get(p, 0))) for name, periods in (("train", train), ("eval", evaluation)) for p in periods]
    rows += [("problem", v, f"{shown[v]} instead of {w}") for v, w in sorted(expected.items()) if v in found and found[v] != [w]]
    rows += [("problem", f"period {p}", f"{own.get(p, 0)} rows instead of {n}") for p, n in sorted((counts or {}).items()) if own.get(p, 0) != n]
    return spark.createDataFrame(rows, "field string, name string, value string")


def source_checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256) of the metadata files that a data set was built from."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_manifest(df: DataFrame, path: str) -> None:
    manifest_counts(df).coalesce(1).write.mode("overwrite").json(f"{path}/counts")
    manifest_checksums(df).coalesce(1).write.mode("overwrite").json(f"{path}/checksums")
    manifest_digests(df).write.mode("overwrite").partitionBy("period").text(f"{path}/digests")


def split_rejects(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a reject reason."""
    tagged = df.withColumn("reason", reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def reject_counts(rejects: DataFrame, n: int = 10) -> DataFrame:
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(n)
