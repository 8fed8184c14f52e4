"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# a frame of at most so many narrow rows (ids and a few numbers) is broadcast; larger ones are joined by shuffle
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset and everything runs in one process (tests), a temporary folder is set; on a cluster it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quorate-llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write a frame once into the shared folder and read it back: no second computation, nothing lost with an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_arrays(df: DataFrame, inputs: list[str], fields: list[T.StructField], fn: Callable[..., list]) -> DataFrame:
    """Append columns that ``fn`` makes, batch by batch, from Arrow arrays of the ``inputs``; all other columns pass through.

    A column that has the name of a new one gives way to it.
    """
    places = [df.columns.index(c) for c in inputs]
    names = {f.name for f in fields}
    stay = [i for i, c in enumerate(df.columns) if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = fn(*[b.column(i) for i in places])
            yield pa.RecordBatch.from_arrays([b.column(i) for i in stay] + list(new), names=[b.schema.names[i] for i in stay] + [f.name for f in fields])

    return df.mapInArrow(run, T.StructType([df.schema.fields[i] for i in stay] + fields))


def remainder(col: str, n: int) -> Column:
    """crc32 of a column's text, modulo n (NULL for NULL)."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def semi_by_id(df: DataFrame, ids: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among the ``rows`` distinct ``ids``: broadcast while these are few, else shuffled."""
    return df.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, key, "left_semi")


CELLS = 65_536


def bounded_labels(labels: DataFrame, target: str, keep: Column, max_rows: int) -> DataFrame:
    """At most ``max_rows`` (doc_id, y, slot) of the labelled documents, the same ones on every run.

    Documents are dealt into 65,536 cells by a hash of their id; one count per cell is read and the first cells that stay
    within the bound are taken.  ``slot`` is a second hash, for splitting.
    """
    rows = (labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & keep)
            .groupBy("doc_id").agg(F.max(target).cast("int").alias("y")))
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(CELLS))
    counts = sorted((r[0], r[1]) for r in rows.groupBy(cell.alias("c")).count().collect())
    total, last = 0, -1
    for c, n in counts:
        if total + n > max_rows:
            break
        total, last = total + n, c
    return rows.filter(cell <= last).withColumn("slot", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1000)).cast("int"))
