"""Readers for labelled file corpora, their metadata, feature records and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate import schemas
from quorate.functions.columns import positive
from quorate.sources.matrix import read_float_matrix, write_float_matrix  # noqa: F401

# Directory names that carry a label, and accepted file extensions.
POSITIVE_DIRS = ["malicious", "malware", "positive", "mal", "1"]
NEGATIVE_DIRS = ["benign", "clean", "negative", "ben", "goodware", "0"]
EXTENSIONS = [".exe", ".dll", ".sys", ".scr", ".ocx", ".bin", ""]


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root`` (any URI scheme)."""
    bare = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/")
    return F.regexp_replace(path, "^.*?" + _quote(bare) + "/+", "")


def _quote(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in text)


def label_from_path(rel: Column) -> Column:
    """Label from the first path component, -1 when it is not a label directory."""
    first = F.lower(F.split_part(rel, F.lit("/"), F.lit(1)))
    return F.when(first.isin(POSITIVE_DIRS), 1).when(first.isin(NEGATIVE_DIRS), 0).otherwise(-1)


def extension(rel: Column) -> Column:
    return F.lower(F.regexp_extract(rel, r"(\.[^./]*)$", 1))


def label_files(files: DataFrame, rel: Column, max_depth: int | None = None, exts: list[str] = EXTENSIONS) -> DataFrame:
    """Add rel_path and label; keep allowed extensions, and only ``max_depth`` directories deep where that is set."""
    out = files.withColumn("rel_path", rel)
    depth = F.size(F.split("rel_path", "/")) - 1
    fits = extension(F.col("rel_path")).isin(exts)
    return out.where(fits if max_depth is None else fits & (depth <= max_depth)).withColumn("label", label_from_path(F.col("rel_path")))


def year_from_path(path: Column) -> Column:
    """Collection year from a four-digit directory, NULL when there is none."""
    return F.try_element_at(F.regexp_extract_all(path, F.lit(r"(?:^|/)(\d{4})(?=/)"), 1), F.lit(1)).cast("int")


def read_corpus(spark: SparkSession, root: str, exts: list[str] = EXTENSIONS, max_depth: int | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return label_files(files, relative_path(F.col("path"), root), max_depth, exts)


def read_year_corpus(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = relative_path(F.col("path"), root)
    return files.withColumn("year", year_from_path(rel)).where(F.col("year").isNotNull())


def _blank(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def parse_metadata(lines: DataFrame, base: str = "", column: str = "value") -> DataFrame:
    """Metadata records from JSON text with key fallbacks; blank and unreadable lines are skipped."""
    r = lines.where(_blank(F.col(column)).isNotNull()).select("*", F.from_json(column, schemas.METADATA_JSON).alias("__r"))
    g = lambda *names: F.coalesce(*[_blank(F.col(f"__r.{n}")) for n in names])
    path = g("path", "file", "sha256")
    full = F.when(path.startswith("/") | F.lit(base == ""), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    label = F.lower(g("label", "y", "malware"))
    label = F.when(label == "true", 1).when(label == "false", 0).otherwise(label.try_cast("int"))
    rest = [c for c in lines.columns if c != column]
    return r.where(path.isNotNull()).select(*rest, full.alias("path"), F.coalesce(label, F.lit(0)).alias("label"),
                                            F.coalesce(g("month", "appeared_month").try_cast("int"), F.lit(0)).alias("period"),
                                            F.coalesce(g("family", "avclass"), F.lit("unknown")).alias("family"))


def read_metadata_jsonl(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    return parse_metadata(spark.read.text(path), base)


def read_metadata_csv(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Metadata CSV with a header; columns may use any of the JSON key names."""
    raw = spark.read.option("header", "true").csv(path)
    return parse_metadata(raw.select(F.to_json(F.struct(*raw.columns)).alias("value")), base)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """First source that has rows: metadata.jsonl, metadata.csv, label directories."""
    for name, reader in (("metadata.jsonl", read_metadata_jsonl), ("metadata.csv", read_metadata_csv)):
        try:
            df = reader(spark, f"{folder}/{name}", folder)
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            continue
        if not df.isEmpty():
            return df
    return read_corpus(spark, folder).select("path", "label", F.lit(0).alias("period"), F.lit("unknown").alias("family"))


class ErrorRateExceeded(ValueError):
    pass


def parse_features(lines: DataFrame, column: str = "value") -> DataFrame:
    """Nested feature records; an unreadable row is flagged and keeps label -1 and the default time."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    r = lines.select("*", F.from_json(column, schemas.FEATURE_JSON + ", _bad string", opts).alias("__r"))
    bad = F.col("__r").isNull() | F.col("__r._bad").isNotNull()
    names = [f.split(" ")[0] for f in _top_level(schemas.FEATURE_JSON)]
    rest = [c for c in lines.columns if c != column]
    keep = [F.when(~bad, F.col(f"__r.{n}")).alias(n) for n in names if n not in ("label", "appeared")]
    return r.select(*rest, bad.alias("is_bad"), F.when(~bad, F.coalesce(F.col("__r.label"), F.lit(-1))).otherwise(-1).alias("label"),
                    F.coalesce(F.when(~bad, F.col("__r.appeared")), F.lit("1970-01")).alias("appeared"), *keep)


def _top_level(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(schema[start:i].strip())
            start = i + 1
    return out


def check_error_rate(parsed: DataFrame, max_rate: float = 0.10) -> DataFrame:
    """Bad-row count and verdict; callers that must stop use ``require_error_rate``."""
    a = parsed.agg(F.count(F.lit(1)).alias("n"), positive(F.col("is_bad")).alias("bad"))
    return a.withColumn("failed", F.col("bad") > F.col("n") * max_rate)


def require_error_rate(parsed: DataFrame, max_rate: float = 0.10) -> DataFrame:
    row = check_error_rate(parsed, max_rate).first()
    if row["failed"]:
        raise ErrorRateExceeded(f"{row['bad']} of {row['n']} feature rows are unreadable")
    return parsed


def read_feature_jsonl(spark: SparkSession, path: str, max_error_rate: float = 0.10) -> DataFrame:
    return require_error_rate(parse_features(spark.read.text(path)), max_error_rate)


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def tabular(df: DataFrame, label_col: str, exclude: list[str] = []) -> DataFrame:
    """Numeric columns (any case of the excluded names left out) as a vector, label = class is not "benign"."""
    skip = {c.lower() for c in exclude} | {label_col.lower()}
    cols = [c for c, t in df.dtypes if c.lower() not in skip and (t in NUMERIC or t.startswith("decimal"))]
    keep = [c for c, t in df.dtypes if c not in cols and c.lower() != label_col.lower()]
    label = F.when(F.lower(F.col(label_col).cast("string")) != "benign", 1).otherwise(0)
    return df.select(*keep, label.alias("label"), F.array(*[F.col(c).cast("double") for c in cols]).alias("vec"))


def read_tabular(spark: SparkSession, path: str, label_col: str, exclude: list[str] = []) -> DataFrame:
    return tabular(spark.read.parquet(path), label_col, exclude)


def parse_graphs(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(column, schemas.GRAPH).alias("g")).where("g.hash is not null").select("g.*")


def graph_edges(graphs: DataFrame) -> DataFrame:
    """(hash, src, dst) from the two parallel endpoint lists."""
    pairs = F.arrays_zip(F.get("function_edges", F.lit(0)).alias("src"), F.get("function_edges", F.lit(1)).alias("dst"))
    return graphs.select("hash", F.inline(pairs).alias("src", "dst"))


def graph_blocks(graphs: DataFrame) -> DataFrame:
    return graphs.select("hash", F.posexplode("acfg_list").alias("function", "f")).select(
        "hash", "function", F.posexplode("f.block_features").alias("block", "features"))


def graph_names(graphs: DataFrame) -> DataFrame:
    """Function names; the first ``size(acfg_list)`` are local, the rest external."""
    return graphs.select("hash", F.size("acfg_list").alias("locals"), F.posexplode("function_names").alias("pos", "name")) \
        .select("hash", "pos", "name", (F.col("pos") >= F.col("locals")).alias("external"))


def read_graph_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parse_graphs(spark.read.text(path))
