"""Small literal tables, and sums over vectors made before any shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, float):
        return f"{v!r}D"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table that lives in the plan itself, so its size is known before the query runs."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    values = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    names = ", ".join(n for n, _ in fields)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def vector_moments(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, dim, n, s, q): count, sum and sum of squares per vector dimension.

    Sums are made batch by batch before any shuffle, so what moves is tasks x groups x dimensions, not rows x dimensions.
    Vectors may differ in length; NULL and NaN entries count nowhere.
    """
    types = dict(df.dtypes)

    def partial(batches):
        for batch in batches:
            lists = batch.column(len(keys))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(int)
            if not len(flat):
                continue
            starts = np.cumsum(sizes) - sizes
            dim = np.arange(len(flat)) - np.repeat(starts, sizes)
            groups = {(): np.arange(len(sizes))} if not keys else batch.select(keys).to_pandas().groupby(keys, dropna=False).indices
            of = np.zeros(len(sizes), dtype=int)
            names = list(groups)
            for g, name in enumerate(names):
                of[groups[name]] = g
            width = int(sizes.max())
            cell = np.repeat(of, sizes) * width + dim
            ok = ~np.isnan(flat)
            n, s, q = (np.bincount(cell[ok], w, len(names) * width) for w in (None, flat[ok], flat[ok] ** 2))
            at = np.flatnonzero(n)
            cols = [pa.array([(names[i // width] if isinstance(names[i // width], tuple) else (names[i // width],))[k] for i in at], type=batch.schema.field(c).type) for k, c in enumerate(keys)]
            cols += [pa.array((at % width).astype(np.int32)), pa.array(n[at].astype(np.int64)), pa.array(s[at]), pa.array(q[at])]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "dim", "n", "s", "q"])

    schema = "".join(f"{k} {types[k]}, " for k in keys) + "dim int, n bigint, s double, q double"
    sums = df.select(*keys, F.col(vec).cast("array<double>").alias(vec)).mapInArrow(partial, schema)
    return sums.groupBy(*keys, "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def product_sums(df: DataFrame, vec: str, size: int) -> DataFrame:
    """(i, j, n, si, sj, sij) for i <= j: sums over rows of full vectors of one size, matrix products batch by batch."""
    def partial(batches):
        i, j = np.triu_indices(size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                s, g = x.sum(axis=0), x.T @ x
                cols = [i.astype(np.int32), j.astype(np.int32), np.full(len(i), len(x), dtype=np.int64), s[i], s[j], g[i, j]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["i", "j", "n", "si", "sj", "sij"])

    sums = df.select(F.col(vec).cast("array<double>").alias(vec)).mapInArrow(partial, "i int, j int, n bigint, si double, sj double, sij double")
    return sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])
