"""Nested feature records to one dense vector of 2,381 entries, as column expressions.

Blocks: byte histogram 256, byte entropy 256, strings 8 + 96, general 10, header 62, sections 5 + 10 x 25, imports
256 + 1,024, exports 128, data directories 30.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 2381
# Field order inside the blocks.
STRING_FIELDS = ["numstrings", "avlength", "printables", "entropy", "paths", "urls", "registry", "MZ"]
GENERAL_FIELDS = ["size", "vsize", "has_debug", "exports", "imports", "has_relocations", "has_resources", "has_signature", "has_tls", "symbols"]
COFF_FIELDS = ["timestamp", "machine", "characteristics"]
OPTIONAL_FIELDS = ["subsystem", "dll_characteristics", "magic", "major_image_version", "minor_image_version", "major_linker_version", "minor_linker_version",
                   "major_operating_system_version", "minor_operating_system_version", "major_subsystem_version", "minor_subsystem_version", "sizeof_code",
                   "sizeof_headers", "sizeof_heap_commit"]


# Places of the fixed vector layout.
SECTIONS, DIRECTORIES = 10, 15


def _md5_head(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _number_or_hash(text: Column) -> Column:
    """Numbers as they are, true/false as 1/0, lists by their comma-joined items and other text by hash modulo 65,536."""
    flat = F.when(text.startswith("["), F.array_join(F.from_json(text, "array<string>"), ",")).otherwise(text)
    hashed = (_md5_head(flat) % 65536).cast("double")
    return F.when(text.isNull(), 0.0).when(text == "true", 1.0).when(text == "false", 0.0).otherwise(F.coalesce(text.try_cast("double"), hashed))


def _fit(vec: Column, n: int) -> Column:
    return F.slice(F.concat(F.coalesce(vec, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), n)), 1, n)


def _whole(vec: Column, n: int) -> Column:
    """Taken only when long enough, zeros otherwise."""
    return F.when(F.size(vec) >= n, F.slice(vec, 1, n)).otherwise(F.array_repeat(F.lit(0.0), n))


def _zero(col: Column) -> Column:
    return F.coalesce(col.cast("double"), F.lit(0.0))


# cells of a batch that are counted at a time
CELLS = 1 << 20


def _heads(names: pa.Array) -> np.ndarray:
    """The first 32 bits of the md5 of every name."""
    return np.array([int.from_bytes(hashlib.md5(x.lower().encode()).digest()[:4], "big") for x in names.to_pylist()], dtype=np.int64)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _hashed_bag(names: pa.Array, width: pa.Array) -> pa.Array:
    """Cells of lists of names; adding into an array in place has no form as a column expression that stays linear in the names.

    A batch hashes each of its different names once and counts all rows' cells together; empty and missing names count nowhere.
    """
    n = width[0].as_py() if len(width) else 1
    flat = names.flatten()
    rows = np.repeat(np.arange(len(names)), pc.fill_null(pc.list_value_length(names), 0).to_numpy(zero_copy_only=False))
    known = pc.fill_null(pc.greater(pc.binary_length(flat), 0), False)
    coded = flat.filter(known).dictionary_encode()
    heads, codes = _heads(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
    cell, sign = (heads % n)[codes], np.where(heads >> 31 & 1, 1.0, -1.0)[codes]
    rows = rows[known.to_numpy(zero_copy_only=False)]
    step, parts = max(1, CELLS // n), []
    for lo in range(0, len(names), step):
        hi = min(lo + step, len(names))
        i, j = np.searchsorted(rows, [lo, hi])
        parts.append(np.bincount((rows[i:j] - lo) * n + cell[i:j], weights=sign[i:j], minlength=(hi - lo) * n))
    cells = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * n), pa.array(cells))


def _bag(names: Column, n: int) -> Column:
    """Signed hashing of a name array into ``n`` cells; every name is hashed once and added to its cell."""
    return _hashed_bag(F.coalesce(names, F.array().cast("array<string>")), F.lit(n))


def vectorise(df: DataFrame) -> DataFrame:
    """Add ``vec`` to parsed feature records (see ``sources.corpus.parse_features``).

    The vector has one layout of fixed width with places for ``SECTIONS`` sections and ``DIRECTORIES`` directories; how many more a
    record has is told in ``sections_left_out`` and ``directories_left_out``.
    """
    strings = F.concat(F.array(*[_zero(F.col(f"strings.{f}")) for f in STRING_FIELDS]), _fit(F.col("strings.printabledist"), 96))
    general = F.array(*[_zero(F.col(f"general.{f}")) for f in GENERAL_FIELDS])
    header = _fit(F.array(*[_number_or_hash(F.try_element_at("header.coff", F.lit(f))) for f in COFF_FIELDS],
                          *[_number_or_hash(F.try_element_at("header.optional", F.lit(f))) for f in OPTIONAL_FIELDS]), 62)
    secs = F.coalesce(F.col("section.sections"), F.array().cast("array<struct<name:string,size:double,entropy:double,vsize:double,props:array<string>>>"))
    per = F.flatten(F.transform(F.slice(secs, 1, SECTIONS), lambda s: F.concat(
        F.array(_zero(s["size"]), _zero(s["entropy"]), _zero(s["vsize"]), _number_or_hash(F.coalesce(s["name"], F.lit("")))),
        _fit(F.transform(s["props"], _number_or_hash), 21))))
    entry = F.when(F.length("section.entry") > 0, _number_or_hash(F.col("section.entry"))).otherwise(0.0)
    sections = _fit(F.concat(F.array(F.size(secs).cast("double"), entry, F.lit(0.0), F.lit(0.0), F.lit(0.0)), per), 255)
    libs = F.map_keys("imports")
    funcs = F.flatten(F.filter(F.map_values("imports"), lambda x: x.isNotNull()))
    dirs = _fit(F.flatten(F.transform(F.slice("datadirectories", 1, DIRECTORIES), lambda x: F.array(_zero(x["size"]), _zero(x["virtual_address"])))), 30)
    vec = F.concat(_whole(F.col("histogram"), 256), _whole(F.col("byteentropy"), 256), strings, general, header, sections, _bag(libs, 256), _bag(funcs, 1024),
                   _bag(F.col("exports"), 128), dirs)
    return df.withColumn("vec", vec).withColumn("sections_left_out", F.greatest(F.size(secs) - SECTIONS, F.lit(0))) \
        .withColumn("directories_left_out", F.greatest(F.coalesce(F.size("datadirectories"), F.lit(0)) - DIRECTORIES, F.lit(0)))


def records(docs: DataFrame) -> DataFrame:
    """Feature records derived from documents: words stand in for names, lengths for sizes."""
    words = F.split(F.lower("text"), " ")
    num = lambda k: (F.col("n_chars") % k).cast("double")
    sec = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(F.concat(F.lit(".s"), i.cast("string")).alias("name"), num(1000).alias("size"), (num(8)).alias("entropy"),
                                                                         num(500).alias("vsize"), F.array(F.lit("MEM_READ"), F.lit("CNT_CODE")).alias("props")))
    return docs.select(
        F.col("doc_id").alias("sample_id"), F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: ((F.col("n_chars") + i) % 97).cast("double")).alias("histogram"),
        F.array_repeat(num(7), 256).alias("byteentropy"),
        F.struct(*[num(i + 3).alias(f) for i, f in enumerate(STRING_FIELDS)], F.array_repeat(num(5), 96).alias("printabledist")).alias("strings"),
        F.struct(*[num(i + 11).alias(f) for i, f in enumerate(GENERAL_FIELDS)]).alias("general"),
        F.struct(F.create_map(F.lit("machine"), F.col("lang"), F.lit("timestamp"), F.col("n_chars").cast("string")).alias("coff"),
                 F.create_map(F.lit("magic"), F.lit("PE32"), F.lit("sizeof_code"), F.col("n_chars").cast("string")).alias("optional")).alias("header"),
        F.struct(F.col("source").alias("entry"), sec.alias("sections")).alias("section"),
        F.map_from_arrays(F.array(F.col("source"), F.col("lang")), F.array(words, F.array_distinct(words))).alias("imports"),
        F.sort_array(F.array_distinct(words)).alias("exports"), F.array(F.struct(num(13).alias("size"), num(17).alias("virtual_address"))).alias("datadirectories"))


def checksums(df: DataFrame) -> DataFrame:
    """Width, sum and position-weighted sum of every vector."""
    weighted = F.aggregate(F.transform("vec", lambda x, i: x * (i % 31 + 1)), F.lit(0.0), lambda a, x: a + x)
    return df.select("sample_id", F.size("vec").alias("width"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(weighted, 6).alias("weighted"))
