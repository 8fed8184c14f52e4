"""The monitoring operators on Structured Streaming.  Batch and stream forms give the same final rows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions.columns import positive
from quorate.operators import matching
from quorate.session import shared_dir

# an event time after all others: its row only moves the watermark and is never seen by an operator
CLOSING = "9000-01-01 00:00:00"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_samples(spark: SparkSession, path: str, schema: str, gate: Column | None = None, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Arriving records with an explicit schema; the cheap gate comes before everything else."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.load(path)
    return df if gate is None else df.where(gate)


def with_event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Cast a zone-less time and set the lateness limit; rows past it are dropped and counted in the query progress."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def stream_dedup(df: DataFrame, key: str) -> DataFrame:
    """First arrival per digest within the lateness limit."""
    return df.dropDuplicatesWithinWatermark([key])


def stream_match(df: DataFrame, sigs: DataFrame, digest: str = "sha256") -> DataFrame:
    """Stream against the static signature table."""
    return matching.match_exact(df, sigs, digest)


def stream_counters(df: DataFrame, ts: str, flags: dict[str, Column], size: str = "1 day") -> DataFrame:
    """Running counters per window."""
    return df.groupBy(F.window(ts, size).alias("w")).agg(F.count(F.lit(1)).alias("n"), *[positive(c).alias(k) for k, c in flags.items()]) \
        .select(F.col("w.start").alias("start"), "n", *flags)


def stream_stats(df: DataFrame, ts: str, value: str, size: str, slide: str | None = None) -> DataFrame:
    """Mean and deviation per tumbling or sliding window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")) \
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "sd")


def stream_detect(df: DataFrame, key: str, order: str, z: str, k: float, decay: float = 0.9, limit: float | None = None) -> DataFrame:
    """Per key: CUSUM and an exponential mean that stands still while the CUSUM is above ``limit``.

    Only three numbers are kept per key.  Rows of a key must arrive in order across batches; inside a batch they are sorted.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout
    types = dict(df.dtypes)

    def update(keys, frames, state):
        s, mu, n = state.get if state.exists else (0.0, 0.0, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for at, x in zip(rows[order], rows[z]):
            s = max(0.0, s + max(x, 0.0) - k)
            drift = limit is not None and s > limit
            if not drift:
                mu = x if n == 0 else decay * mu + (1 - decay) * x
                n += 1
            out.append((keys[0], at, s, mu, drift))
        state.update((s, mu, n))
        yield pd.DataFrame(out, columns=[key, order, "cusum", "ema", "in_drift"])

    return df.groupBy(key).applyInPandasWithState(update, f"{key} {types[key]}, {order} {types[order]}, cusum double, ema double, in_drift boolean",
                                                  "s double, mu double, n bigint", "append", GroupStateTimeout.NoTimeout)


def with_close(df: DataFrame, column: str, delay: str) -> tuple[DataFrame, Callable[[], None]]:
    """``with_event_time`` for an input that ends, and a function that ends it.

    Windows and timers only close when the watermark passes them, so the last ones never would.  A second, empty file source is
    joined to the stream; ``close`` puts one row into it whose event time lies after all windows.  The filter names the
    event time, so it stays above the watermark, which sees that row, while no operator does.
    """
    spark = df.sparkSession
    df = df.withColumn(column, F.col(column).cast("timestamp"))
    path = f"{shared_dir(spark).rstrip('/')}/close-{uuid.uuid4().hex}"
    end = [F.lit(CLOSING).cast("timestamp").alias(c) if c == column else F.lit(None).cast(kind).alias(c) for c, kind in df.dtypes]
    spark.createDataFrame([], df.schema).write.parquet(path)

    def close() -> None:
        spark.range(1).select(*end).write.mode("append").parquet(path)

    marks = spark.readStream.schema(df.schema).parquet(path)
    return df.union(marks).withWatermark(column, delay).where(F.col(column) < F.lit(CLOSING).cast("timestamp")), close


def run_closed(df: DataFrame, close: Callable[[], None]) -> tuple[DataFrame, list[dict]]:
    """Append-mode run over everything available, then the closing row: every window and timer ends and leaves the state."""
    base = f"{shared_dir(df.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    _, first = run_available(df, base=base)
    close()
    rows, second = run_available(df, base=base)
    return rows, first + second


class Monitor:
    """What the monitoring of one key remembers, and how a row changes it.

    ``cusum`` adds up max(z, 0) - k and starts again after every clean row; above ``limit`` the key drifts.  ``accumulated`` sums all
    evidence (``gain``).  The baseline is the mean and sample deviation of ``d`` over the last ``window`` clean rows: it stands
    still during drift.
    """

    def __init__(self, k: float, limit: float, window: int, cusum: float = 0.0, accumulated: float = 0.0, ring: list[float] | None = None):
        self.k, self.limit, self.window = k, limit, window
        self.cusum, self.accumulated, self.ring = cusum, accumulated, ring or []

    def add(self, z: float, gain: float, d: float) -> tuple[float, float, float | None, float | None, bool]:
        """(cusum, accumulated, mu, sigma, in_drift) with this row."""
        value = self.cusum = max(0.0, self.cusum + max(z, 0.0) - self.k)
        self.accumulated += gain
        drift = value > self.limit
        if not drift:
            self.ring = (self.ring + [d])[-self.window:]
            self.cusum = 0.0
        n = len(self.ring)
        mu = math.fsum(self.ring) / n if n else None
        sigma = math.sqrt(math.fsum((x - mu) ** 2 for x in self.ring) / (n - 1)) if n > 1 else None
        return value, self.accumulated, mu, sigma, drift


MONITORED = "cusum double, accumulated double, mu double, sigma double, in_drift boolean"


def monitor(df: DataFrame, key: str, at: str, z: str, gain: str, d: str, k: float, limit: float, window: int) -> DataFrame:
    """Batch form of ``stream_monitor``: one row per period and key, so a key is as long as its number of periods."""
    types = dict(df.dtypes)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([at, z, gain, d])
        state = Monitor(k, limit, window)
        out = [state.add(*r) for r in zip(rows[z], rows[gain], rows[d])]
        return pd.concat([rows[[key, at]].reset_index(drop=True), pd.DataFrame(out, columns=["cusum", "accumulated", "mu", "sigma", "in_drift"])], axis=1)

    return df.select(key, at, z, gain, d).groupBy(key).applyInPandas(fold, f"{key} {types[key]}, {at} {types[at]}, {MONITORED}")


def stream_monitor(df: DataFrame, key: str, at: str, z: str, gain: str, d: str, k: float, limit: float, window: int, idle_days: int = 400) -> DataFrame:
    """CUSUM, accumulated shift and a rolling baseline that is frozen during drift, in event-time order whatever the order of arrival.

    A row waits in its key's list until an event-time timer says that the watermark has passed it; then all rows due are taken in
    order.  A key holds two sums, at most ``window`` numbers of its baseline and the rows of the lateness limit; a key
    without rows for ``idle_days`` leaves the state.  ``at`` must carry the watermark; needs the RocksDB state store, which
    ``with_state_store`` sets.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor
    types = dict(df.dtypes)
    idle = idle_days * 86_400_000

    class Ordered(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "at bigint, z double, gain double, d double")
            self.sums = handle.getValueState("sums", "cusum double, accumulated double, last bigint")
            self.ring = handle.getListState("ring", "d double")

        def handleInputRows(self, key, rows, timerValues):
            # by place: a computed column may arrive under a name of the planner's
            new = [(int(t), float(a), float(b), float(c)) for f in rows for t, a, b, c in zip(f.iloc[:, 5], f[z], f[gain], f[d])]
            self.waiting.appendList(new)
            for t in {r[0] // 1000 + 1 for r in new}:
                self.handle.registerTimer(t)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            passed = timerValues.getCurrentWatermarkInMs()
            every = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
            due = [r for r in every if r[0] // 1000 < passed]
            sums = self.sums.get() if self.sums.exists() else (0.0, 0.0, 0)
            if not due:
                if not every and sums[2] // 1000 + idle < passed:
                    for state in (self.waiting, self.sums, self.ring):
                        state.clear()
                return
            state = Monitor(k, limit, window, sums[0], sums[1], [r[0] for r in self.ring.get()] if self.ring.exists() else [])
            out = [(key[0], r[0], *state.add(*r[1:])) for r in due]
            if len(due) < len(every):
                self.waiting.put(every[len(due):])
            else:
                self.waiting.clear()
            self.sums.update((state.cusum, state.accumulated, due[-1][0]))
            if state.ring:
                self.ring.put([(x,) for x in state.ring])
            self.handle.registerTimer(due[-1][0] // 1000 + idle + 1)
            yield pd.DataFrame(out, columns=[name, "__us", "cusum", "accumulated", "mu", "sigma", "in_drift"])

        def close(self) -> None:
            pass

    # times travel as microseconds, so that no session time zone comes between them and the watermark
    name, rows = key, df.select(key, at, z, gain, d, F.unix_micros(at).alias("__us"))
    out = rows.groupBy(key).transformWithStateInPandas(Ordered(), f"{key} {types[key]}, __us bigint, {MONITORED}", "Append", "EventTime")
    return out.select(key, F.timestamp_micros("__us").alias(at), *[f.split(" ")[0] for f in MONITORED.split(", ")])


def with_state_store(spark: SparkSession, run: Callable, *args, provider: str = ROCKSDB):
    """Run a streaming job with this state store and put the session's setting back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        return run(*args)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def route_late(df: DataFrame, column: str, delay: str) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows with their ``batch`` and ``watermark``) of everything available.

    A row is late if its event time lies more than ``delay`` before the latest one of all earlier batches.  The watermark is
    kept per batch beside the rows, so a batch that is run again after a failure gives the same rows, and the count covers
    all batches however many there are.  Rows without an event time are late.  Nothing is dropped: the rows in time can be
    read as a stream again (``rows`` folder of the result), the late ones be mended and fed once more.
    """
    from pyspark.sql import Observation
    spark = df.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/late-{uuid.uuid4().hex}"
    df = df.withColumn(column, F.col(column).cast("timestamp"))
    marks = "batch bigint, latest timestamp"
    spark.createDataFrame([], marks).write.parquet(f"{base}/marks")
    spark.createDataFrame([], df.schema).withColumn("watermark", F.lit(None).cast("timestamp")).withColumn("batch", F.lit(0).cast("bigint")).withColumn("late", F.lit(False)).write.parquet(f"{base}/rows/empty")

    def write(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(marks).parquet(f"{base}/marks", f"{base}/marks/*") if number else spark.createDataFrame([], marks)
        latest = before.where(F.col("batch") < number).agg(F.max("latest").alias("latest"))
        seen = Observation()
        mark = (F.col("latest") - F.expr(f"interval {delay}")).alias("watermark")
        marked = batch.observe(seen, F.max(column).cast("string").alias("latest")).crossJoin(F.broadcast(latest.select(mark)))
        late = F.col(column).isNull() | F.coalesce(F.col(column) < F.col("watermark"), F.lit(False))
        marked.withColumn("batch", F.lit(number).cast("bigint")).withColumn("late", late).write.mode("overwrite").parquet(f"{base}/rows/{number}")
        own = spark.range(1).select(F.lit(number).cast("bigint").alias("batch"), F.lit(seen.get["latest"]).cast("timestamp").alias("latest"))
        own.write.mode("overwrite").parquet(f"{base}/marks/{number}")

    df.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(spark.read.parquet(f"{base}/rows/empty").schema).parquet(f"{base}/rows/*")
    return rows.where(~F.col("late")).select(*df.columns), rows.where("late").select(*df.columns, "batch", "watermark")


def run_available(df: DataFrame, mode: str = "append", base: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Process everything available into a table in the shared folder; returns it with the progress of the last batches.

    ``complete`` results replace the previous batch, so only the last one is read back.  With the ``base`` of an earlier run
    the query goes on where that one ended.  The session keeps the progress of its last 100 batches; ``route_late`` counts
    late rows over all of them.
    """
    spark = df.sparkSession
    base = base or f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").outputMode("append").option("path", f"{base}/rows").start()
    else:
        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/rows")
        q = writer.outputMode(mode).foreachBatch(replace).start()
    q.awaitTermination()
    progress = [dict(numInputRows=p["numInputRows"], dropped=sum(o.get("numRowsDroppedByWatermark", 0) for o in p["stateOperators"]),
                     state_rows=sum(o.get("numRowsTotal", 0) for o in p["stateOperators"])) for p in q.recentProgress]
    return spark.read.schema(df.schema).parquet(f"{base}/rows"), progress
