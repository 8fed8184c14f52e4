"""Float matrices in raw little-endian float32 files, as a Spark data source that reads and writes Arrow batches.

A matrix is a file, or a folder of files in name order, of rows of one width.  Tasks read ranges of whole rows; the row number comes from the place in the
file, so nothing is numbered afterwards.  Files are opened through pyarrow's file systems (local paths and the schemes it
knows); sizes are read through Hadoop's, on the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "float_matrix"
RANGE = 32 << 20  # bytes of a partition, unless asked for otherwise
BATCH = 4 << 20  # bytes of a batch


def _open(path: str):
    """(file system, path in it) of a path or URI; ``file:/x`` is what Hadoop calls a local file."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    def __init__(self, path: str, start: int, rows: int, first: int):
        self.path, self.start, self.rows, self.first = path, start, rows, first


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.width, self.range = json.loads(options["files"]), int(options["width"]), int(options["range"])

    def partitions(self) -> list[Range]:
        out, first = [], 0
        for path, size in self.files:
            rows = size // (4 * self.width)
            step = max(1, self.range // (4 * self.width))
            out += [Range(path, 4 * self.width * lo, min(step, rows - lo), first + lo) for lo in range(0, rows, step)]
            first += rows
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        system, path = _open(part.path)
        with system.open_input_file(path) as f:
            f.seek(part.start)
            step = max(1, BATCH // (4 * self.width))
            for lo in range(0, part.rows, step):
                n = min(step, part.rows - lo)
                data = f.read(4 * self.width * n)
                if len(data) != 4 * self.width * n:
                    raise ValueError(f"{part.path} ends inside row {part.first + lo + len(data) // (4 * self.width)}")
                values = pa.array(np.frombuffer(data, dtype="<f4"))
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * self.width)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + part.first + lo), pa.ListArray.from_arrays(offsets, values)], names=["row_id", "vec"])


class Written(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class MatrixWriter(DataSourceArrowWriter):
    """One file per partition, under a name of its own until the whole write has succeeded."""

    def __init__(self, options: dict):
        self.path, self.width, self.run = options["path"].rstrip("/"), int(options["width"]), uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext
        context = TaskContext.get()
        final = f"{self.path}/part-{context.partitionId():05d}.f32"
        temporary = f"{self.path}/.{self.run}-{context.taskAttemptId()}"
        system, name = _open(temporary)
        system.create_dir(_open(self.path)[1], recursive=True)
        with system.open_output_stream(name) as f:
            for b in batches:
                vectors = b.column(b.schema.names.index("vec"))
                if vectors.null_count or (len(vectors) and set(vectors.value_lengths().unique().to_pylist()) != {self.width}) or vectors.flatten().null_count:
                    raise ValueError(f"every vector must hold {self.width} numbers")
                f.write(vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
        return Written(temporary, final)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                system, source = _open(m.temporary)
                system.move(source, _open(m.final)[1])

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                system, source = _open(m.temporary)
                system.delete_file(source)


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "row_id bigint, vec array<float>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options)


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files of a matrix with their sizes, in name order; hidden files are left out."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getPath().toString(), s.getLen()) for s in system.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "._"]
    return sorted(found, key=lambda f: f[0])


def read_float_matrix(spark: SparkSession, path: str, rows: int, ndim: int | None = None, range_bytes: int = RANGE) -> DataFrame:
    """Little-endian float32 rows as (row_id, vec).  File size must equal rows * ndim * 4; ndim may be derived from it."""
    files = _files(spark, path)
    size = sum(n for _, n in files)
    if ndim is None:
        if rows <= 0 or size % (4 * rows):
            raise ValueError(f"{size} bytes do not divide into {rows} rows")
        ndim = size // (4 * rows)
    if size != rows * ndim * 4:
        raise ValueError(f"expected {rows * ndim * 4} bytes, found {size}")
    if ndim and any(n % (4 * ndim) for _, n in files):
        raise ValueError("a file ends inside a row")
    spark.dataSource.register(MatrixSource)
    return spark.read.format(FORMAT).option("files", json.dumps(files)).option("width", max(int(ndim), 1)).option("range", range_bytes).load()


def write_float_matrix(df: DataFrame, path: str, vector: str, ndim: int, order: list[str]) -> None:
    """Write the vectors, sorted by ``order``, as files of float32 rows whose names keep that order."""
    spark = df.sparkSession
    spark.dataSource.register(MatrixSource)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = ranged.select(F.lit(0).cast("bigint").alias("row_id"), F.col(vector).cast("array<float>").alias("vec"))
    rows.write.format(FORMAT).option("width", ndim).option("path", path).mode("append").save()
