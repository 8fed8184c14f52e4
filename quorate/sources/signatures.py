"""Text signature imports.  Parsing is a projection, so an import reads and splits each line once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hex length per digest algorithm.
HEX_LENGTH = {"md5": 32, "sha1": 40, "sha256": 64}
FUZZY_TYPES = ["ssdeep", "vhash", "authentihash", "imphash", "rich_header_hash"]


def _field(parts: Column, i: int) -> Column:
    return F.trim(F.get(parts, F.lit(i)))


def _size(text: Column) -> Column:
    """``*`` and ``0`` mean any size."""
    return F.when(~text.isin("*", "0"), text.try_cast("bigint"))


def split_hash_lines(lines: DataFrame, algo: str, column: str = "value") -> DataFrame:
    """Every usable line with its outcome: ``kept`` for this algorithm, ``skipped`` for another valid length."""
    line = F.trim(F.col(column))
    parts = F.split(line, ":")
    digest = F.lower(_field(parts, 0))
    rows = lines.where((line != "") & ~line.startswith("#") & (F.size(parts) >= 3)).select(
        *[c for c in lines.columns if c != column], digest.alias("digest"), _size(_field(parts, 1)).alias("size"))
    n = F.length("digest")
    own = (n == HEX_LENGTH[algo]) & F.col("digest").rlike("^[0-9a-f]+$")
    other = (n != HEX_LENGTH[algo]) & n.isin(list(HEX_LENGTH.values()))
    return rows.withColumn("outcome", F.when(own, "kept").when(other, "skipped")).where(F.col("outcome").isNotNull())


def hash_signatures(lines: DataFrame, algo: str, order: str, column: str = "value", existing: DataFrame | None = None) -> DataFrame:
    """Signatures (digest, size) to insert: the first line per digest wins, known digests are left out."""
    kept = split_hash_lines(lines, algo, column).where("outcome = 'kept'")
    first = kept.groupBy("digest").agg(F.min_by(F.struct("size"), order).alias("__s")).select("digest", "__s.size")
    return first if existing is None else first.join(existing.select("digest"), "digest", "left_anti")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with an order column: file, start of the split in it, line inside the split."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", place.alias("row_id"))


def read_hash_signatures(spark: SparkSession, path: str, algo: str, existing: DataFrame | None = None) -> DataFrame:
    return hash_signatures(read_lines(spark, path), algo, "row_id", existing=existing)


def _hex_value(text: Column) -> Column:
    v = F.lower(F.trim(text))
    return F.when((v != "") & (F.length(v) % 2 == 0) & v.rlike("^[0-9a-f]+$"), v)


def fuzzy_signatures(lines: DataFrame, order: str, column: str = "value") -> DataFrame:
    """Eight-field lines to one row per non-empty similarity hash; the first row per (type, value) wins."""
    line = F.trim(F.col(column))
    parts = F.split(line, ":")
    sha = F.lower(_field(parts, 0))
    rows = lines.where((line != "") & ~line.startswith("#") & (F.size(parts) >= 8)).where(sha.rlike("^[0-9a-f]{64}$"))
    values = [F.nullif(_field(parts, 3), F.lit(""))] + [_hex_value(F.get(parts, F.lit(i))) for i in range(4, 8)]
    long = rows.select(F.col(order).alias("__o"), sha.alias("sha256"), _size(_field(parts, 1)).alias("size"), _field(parts, 2).alias("name"),
                       F.inline(F.array(*[F.struct(F.lit(t).alias("hash_type"), v.alias("value")) for t, v in zip(FUZZY_TYPES, values)])))
    best = long.where(F.col("value").isNotNull()).groupBy("hash_type", "value").agg(F.min_by(F.struct("size", "name", "sha256"), "__o").alias("__s"))
    return best.select("hash_type", "value", "__s.*")


def read_fuzzy_signatures(spark: SparkSession, path: str) -> DataFrame:
    return fuzzy_signatures(read_lines(spark, path), "row_id")
