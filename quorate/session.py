"""Session builder and the few settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that change plans, not results.  Everything also runs on a session built elsewhere.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1g",
    # larger generated methods are never compiled by the JVM; separate projections are several times faster
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "quorate", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session; keyword arguments override ``DEFAULTS`` (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables, named by the cluster in ``spark.checkpoint.dir``.

    Unset, it is an error: a folder of the driver's machine would be another one on every executor.  Only a session that runs
    in a single process has one machine, so there a temporary folder is set once.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quorate-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_written: list[str] = []


def drop_intermediate(spark: SparkSession, *paths: str) -> int:
    """Delete the intermediate tables that this process wrote, or those given; frames built on them can't be read afterwards."""
    gone = 0
    for name in paths or [*_written]:
        _written.remove(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def write_intermediate(df) -> str:
    """Write a frame into the shared folder and return its path there."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quorate-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return path


def reliable_table(df):
    """Write a frame once into the shared folder and read it back: cuts lineage, survives lost executors, one pass."""
    return df.sparkSession.read.schema(df.schema).parquet(write_intermediate(df))
