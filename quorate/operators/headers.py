"""Executable header gates on binary columns, entirely with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the header format and its limits.
MACHINES = [0x14C, 0x8664, 0x1C0, 0xAA64, 0x1C4]
MAX_SIZE = 500 * 1024 * 1024
MAX_HEADER_OFFSET = 0x10000
MAX_SECTIONS = 96
MAX_OPTIONAL = 0x1000
FIRST_STAMP, LAST_STAMP = 1420070400, 1767225600


def read_uint(content: Column, offset: Column | int, size: int) -> Column:
    """Little-endian unsigned integer at a zero-based offset, NULL past the end."""
    pos = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    raw = F.hex(F.substring(content, pos, F.lit(size)))
    flipped = F.concat(*[F.substring(raw, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when(F.length(raw) == 2 * size, F.conv(flipped, 16, 10).cast("bigint"))


def little_endian(value: Column, size: int) -> Column:
    """Hex text of an integer in little-endian byte order; a value too large for the field is written as the field's greatest."""
    h = F.lpad(F.hex(F.least(value.cast("bigint"), F.lit((1 << 8 * size) - 1))), 2 * size, "0")
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])


def header_fields(df: DataFrame, content: str) -> DataFrame:
    """Header integers as ``h_*`` columns, extracted once; later checks only compare them."""
    c = F.col(content)
    df = df.withColumn("h_size", F.octet_length(c).cast("bigint")).withColumn("h_magic", F.hex(F.substring(c, F.lit(1), F.lit(2)))) \
        .withColumn("h_off", read_uint(c, 60, 4))
    off = F.when(F.col("h_off") <= F.least(F.col("h_size"), F.lit(MAX_HEADER_OFFSET)), F.col("h_off")).cast("int")
    at = lambda n: off + n
    df = df.withColumns({
        "h_sig": F.hex(F.substring(c, at(1), F.lit(4))), "h_machine": read_uint(c, at(4), 2), "h_sections": read_uint(c, at(6), 2),
        "h_stamp": read_uint(c, at(8), 4), "h_optional": read_uint(c, at(20), 2)})
    return df.withColumn("h_table", F.col("h_off") + 24 + F.col("h_optional"))


def validate_header(df: DataFrame, content: str) -> DataFrame:
    """Add ``ok`` and the first failing ``reason`` in check order."""
    f = header_fields(df, content)
    size, off, n = F.col("h_size"), F.col("h_off"), F.col("h_sections")
    # the checked part of the section table is read once, and only for files that passed the bounds before;
    # fixed-width hex in big-endian order compares like the numbers it spells
    in_table = (F.col("h_table") + n * 40 <= size) & (n <= MAX_SECTIONS)
    start = F.when(in_table, F.col("h_table")).cast("int")
    f = f.withColumn("h_rows", F.hex(F.substring(F.col(content), start + 1, (n * 40).cast("int")))).withColumn("h_limit", F.lpad(F.hex(size), 8, "0"))
    raw = lambda i, at: F.concat(*[F.substr(F.col("h_rows"), i * 80 + 2 * (at + b) + 1, F.lit(2)) for b in (3, 2, 1, 0)])
    places = F.when(in_table & (n > 0), F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    outside = F.get(F.filter(places, lambda i: (raw(i, 20) > F.col("h_limit")) & (raw(i, 16) != "00000000")), F.lit(0))
    reason = (F.when(size < 64, "file too small").when(size > MAX_SIZE, "file too large").when(F.col("h_magic") != "4D5A", "bad magic")
              .when((off < 4) | (off > F.least(size - 4, F.lit(MAX_HEADER_OFFSET))), "header offset out of range")
              .when(F.col("h_sig") != "50450000", "bad signature").when(F.col("h_machine").isNull() | ~F.col("h_machine").isin(MACHINES), "unknown machine")
              .when(n.isNull() | (n > MAX_SECTIONS), "too many sections").when(F.col("h_optional").isNull() | (F.col("h_optional") > MAX_OPTIONAL), "optional header too large")
              .when(~in_table, "section table outside file").otherwise(F.when(outside.isNotNull(), F.concat(F.lit("section "), outside.cast("string"), F.lit(" outside file")))))
    out = f.withColumn("reason", F.coalesce(reason, F.lit("ok")))
    return out.select(*df.columns, (F.col("reason") == "ok").alias("ok"), "reason")


def header_period(df: DataFrame, content: str) -> DataFrame:
    """Year and month of the header timestamp, NULL outside 2015-01-01 .. 2026-01-01 or without a valid header."""
    f = header_fields(df, content)
    good = (F.col("h_magic") == "4D5A") & (F.col("h_off") <= MAX_HEADER_OFFSET) & (F.col("h_sig") == "50450000") & F.col("h_stamp").between(FIRST_STAMP, LAST_STAMP)
    # days since the epoch do not depend on the session time zone
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.when(good, F.col("h_stamp")) / 86400).cast("int"))
    return f.select(*df.columns, F.year(day).alias("year"), F.month(day).alias("month"))
