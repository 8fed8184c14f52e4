"""Extension points: scorers, detectors, rules, table functions, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.operators.detectors import register_detector
from quorate.operators.models import register_scorer

__all__ = ["register_scorer", "register_detector", "register_rules", "match_registered", "register_functions"]

_rules: list[tuple[str, str, bool]] = []


def register_rules(rules: list[tuple[str, str, bool]]) -> None:
    """Replace the shared rule list (name, pattern, is_regex)."""
    _rules[:] = rules


def match_registered(df: DataFrame, key: str, text: str) -> DataFrame:
    from quorate.operators.content import match_rules
    return match_rules(df, key, text, list(_rules))


def register_functions(spark: SparkSession) -> None:
    """SQL-callable table functions over header section tables and over the words of texts.

    ``sections_of`` and ``tokens_of`` take a table of (key, content) and are Arrow functions, which get and give whole record
    batches: ``SELECT * FROM tokens_of(TABLE(SELECT id, text FROM docs))``; the key comes back as text.  ``explode_sections(content)`` and
    ``explode_tokens(text)`` give the same rows for one value, for use in lateral joins, where Spark takes no Arrow functions.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.functions import arrow_udtf, udtf

    @arrow_udtf(returnType="key string, ord int, name string, vsize bigint, va bigint, raw_size bigint, raw_offset bigint, flags bigint")
    class SectionsOf:
        def eval(self, table: pa.RecordBatch):
            found = [_sections(body) for body in table.column(1).to_pylist()]
            rows = [r for own in found for r in own]
            keys = pc.cast(table.column(0), pa.string()).take(pa.array(np.repeat(np.arange(len(found)), [len(own) for own in found])))
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
            yield pa.table([keys, *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], names=["key", "ord", "name", "vsize", "va", "raw_size", "raw_offset", "flags"])

    @arrow_udtf(returnType="key string, pos int, token string")
    class TokensOf:
        def eval(self, table: pa.RecordBatch):
            words = pc.split_pattern(pc.utf8_lower(pc.fill_null(pc.cast(table.column(1), pa.string()), "")), " ")
            flat, sizes = words.flatten(), words.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            places = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            some = pc.not_equal(flat, "")
            keys = pc.cast(table.column(0), pa.string()).take(pa.array(row))
            yield pa.table([keys.filter(some), pa.array(places.astype(np.int32)).filter(some), flat.filter(some)], names=["key", "pos", "token"])

    @udtf(returnType="ord int, name string, vsize bigint, va bigint, raw_size bigint, raw_offset bigint, flags bigint")
    class ExplodeSections:
        def eval(self, content: bytes):
            yield from _sections(content)

    @udtf(returnType="pos int, token string")
    class ExplodeTokens:
        def eval(self, text: str):
            for i, word in enumerate((text or "").lower().split(" ")):
                if word:
                    yield i, word

    for name, function in (("sections_of", SectionsOf), ("tokens_of", TokensOf), ("explode_sections", ExplodeSections), ("explode_tokens", ExplodeTokens)):
        spark.udtf.register(name, function)


def _sections(content: bytes | None) -> list[tuple]:
    """Rows of the section table that the header at the offset in bytes 60 to 63 announces; none where it does not fit."""
    import struct
    if content is None or len(content) < 64:
        return []
    off = struct.unpack_from("<I", content, 60)[0]
    if off + 24 > len(content):
        return []
    n, opt = struct.unpack_from("<H", content, off + 6)[0], struct.unpack_from("<H", content, off + 20)[0]
    out = []
    for i in range(n):
        at = off + 24 + opt + 40 * i
        if at + 40 > len(content):
            break
        name, *numbers = struct.unpack_from("<8sIIII", content, at)
        out.append((i, name.rstrip(b"\0").decode("latin-1"), *numbers, struct.unpack_from("<I", content, at + 36)[0]))
    return out
