"""Named views over dense feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "__ALL__"

# Feature ranges by vector width.
RANGES_2381 = {"ByteHistogram": (0, 256), "ByteEntropy": (256, 512), "StringInfo": (512, 616), "GeneralInfo": (616, 626), "HeaderInfo": (626, 688),
               "SectionInfo": (688, 943), "ImportInfo": (943, 2223), "ExportInfo": (2223, 2351), "DataDirs": (2351, 2381)}
RANGES_2568 = {"ByteHistogram": (0, 256), "ByteEntropy": (256, 512), "StringInfo": (512, 616), "GeneralInfo": (616, 636), "HeaderInfo": (636, 738),
               "SectionInfo": (738, 1043), "ImportInfo": (1043, 2323), "ExportInfo": (2323, 2451), "DataDirs": (2451, 2491), "RichHeader": (2491, 2531),
               "Authenticode": (2531, 2551), "ParseWarnings": (2551, 2568)}


def ranges_for(width: int) -> dict[str, tuple[int, int]]:
    """Range map for a vector width; narrow tables are a single range."""
    if width >= 2568:
        return RANGES_2568
    return RANGES_2381 if width >= 512 else {"ByteHistogram": (0, width)}


def _view(vec: Column, ranges: dict[str, tuple[int, int]], names: list[str]) -> Column | None:
    names = list(ranges) if ALL in names else [n for n in names if n in ranges]
    parts = [F.slice(vec, lo + 1, hi - lo) for lo, hi in (ranges[n] for n in names)]
    if not parts:
        return None
    joined = parts[0] if len(parts) == 1 else F.concat(*parts)
    return F.when(F.size(joined) > 0, joined)


def _view_structs(vec: Column, ranges, views) -> Column:
    cols = [(v, _view(vec, ranges, names)) for v, names in views.items()]
    return F.array(*[F.struct(F.lit(v).alias("view"), c.alias("vec")) for v, c in cols if c is not None])


def project_views(df: DataFrame, vec: str, ranges: dict[str, tuple[int, int]], views: dict[str, list[str]], name: str = "views") -> DataFrame:
    """Replace a vector by a map view -> sub-vector; views without any known range stay absent.  No shuffle."""
    present = F.filter(_view_structs(F.col(vec), ranges, views), lambda s: s["vec"].isNotNull())
    return df.withColumn(name, F.map_from_entries(present)).drop(vec)


def project_views_long(df: DataFrame, vec: str, ranges, views, keep: list[str]) -> DataFrame:
    """One row (keep..., view, vec) per present view."""
    return df.select(*keep, F.inline(_view_structs(F.col(vec), ranges, views))).where(F.col("vec").isNotNull())


def missing_views(column: str, required: list[str]) -> Column:
    """Reason text for a sample that lacks required views, NULL when complete."""
    gone = F.array_except(F.array(*[F.lit(v) for v in sorted(required)]), F.map_keys(column))
    return F.when(F.size(gone) > 0, F.concat(F.lit("missing: "), F.array_join(gone, ",")))


def require_views(df: DataFrame, required: list[str], column: str = "views") -> tuple[DataFrame, DataFrame]:
    """Complete samples and rejects with their reason."""
    tagged = df.withColumn("reason", missing_views(column, required))
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")


def available_views(df: DataFrame, column: str = "views") -> DataFrame:
    """Views that at least one sample provides, with sample counts."""
    return df.select(F.explode(F.map_keys(column)).alias("view")).groupBy("view").agg(F.count(F.lit(1)).alias("n"))


def adaptive_views(df: DataFrame, required: list[str], column: str = "views") -> tuple[list[str], DataFrame]:
    """Drop required views that no sample has, then require the remaining ones.  Returns (views, complete samples)."""
    have = {r["view"] for r in available_views(df, column).where(F.col("view").isin(required)).collect()}
    kept = [v for v in required if v in have]
    return kept, require_views(df, kept, column)[0]


def conform(vec: Column, dim: Column | int) -> Column:
    """Pad with zeros on the right or cut to ``dim`` entries."""
    dim = F.lit(dim) if isinstance(dim, int) else dim
    return F.slice(F.concat(vec, F.array_repeat(F.lit(0.0), dim)), F.lit(1), dim)


def conform_note(vec: Column, dim: Column | int) -> Column:
    dim = F.lit(dim) if isinstance(dim, int) else dim
    n = F.size(vec)
    kind = F.when(n < dim, "padded").when(n > dim, "truncated")
    return F.when(kind.isNotNull(), F.concat(kind, F.lit(":"), n.cast("string"), F.lit("->"), dim.cast("string")))


def align_dims(df: DataFrame, view: str = "view", vec: str = "vec") -> DataFrame:
    """Bring every vector of a view to the widest one; only the per-view maxima are joined back."""
    widest = df.groupBy(view).agg(F.max(F.size(vec)).alias("__dim"))
    return df.join(widest, view).withColumn(vec, conform(F.col(vec), F.col("__dim"))).drop("__dim")
