"""Byte, string and token statistics of raw content.

Content is cut into fixed chunks first, so one huge file spreads over many rows; a chunk is reduced to its distinct
bytes or byte pairs with a vectorised count.  The counts of a key meet as sorted rows of arrays; see ``_from_counts``.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.functions.columns import positive

CHUNK = 1 << 16
BLOCK = 1024
CODE_COUNTS = T.StructType([T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.LongType()))])


def chunks(df: DataFrame, key: str, content: str, size: int = CHUNK, overlap: int = 0) -> DataFrame:
    """Rows (key, chunk, part); each part carries ``overlap`` extra bytes of the next one."""
    count = F.greatest(F.ceil(F.octet_length(content) / size), F.lit(1)).cast("int")
    # parts are cut before the explode, so a row never carries more than its own part
    body = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(body, i * size + 1, F.lit(size + overlap)))
    return df.select(key, F.posexplode(parts).alias("chunk", "part"))


def _counted(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """One row of parallel (code, n) arrays per part."""
    ends = np.cumsum([0, *(len(c) for c, _ in found)]).astype(np.int32)
    flat = lambda k, t: np.concatenate([f[k] for f in found]).astype(t) if found else np.empty(0, t)
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat(0, np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat(1, np.int64)))], names=["code", "n"])


def _bytes_of(parts: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of every part, without copies."""
    for b in parts:
        yield np.frombuffer(b.as_buffer() or b"", dtype=np.uint8)


@F.arrow_udf(CODE_COUNTS)
def _byte_counts(parts: pa.Array) -> pa.Array:
    def count(a):
        c = np.bincount(a, minlength=256)
        at = np.flatnonzero(c)
        return at, c[at]
    return _counted([count(a) for a in _bytes_of(parts)])


def _pairs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = a[:-1].astype(np.uint16) << 8 | a[1:]
    if len(codes) > 4096:
        c = np.bincount(codes, minlength=1 << 16)
        at = np.flatnonzero(c)
        return at.astype(np.int32), c[at]
    return np.unique(codes, return_counts=True)


@F.arrow_udf(CODE_COUNTS)
def _pair_counts(parts: pa.Array) -> pa.Array:
    return _counted([_pairs(a) for a in _bytes_of(parts)])


def _pairs_of(parts: pa.Array, places: pa.Array) -> pa.Array:
    return _pair_counts.func(parts)


def _head_counts(head: int):
    """Counts of bytes, those of the first ``head`` bytes of the content apart from the others (256 added to their code)."""
    @F.arrow_udf(CODE_COUNTS)
    def run(parts: pa.Array, places: pa.Array) -> pa.Array:
        found = []
        for a, place in zip(_bytes_of(parts), places.to_pylist()):
            cut = min(max(head - place * CHUNK, 0), len(a))
            c = np.concatenate([np.bincount(a[:cut], minlength=256), np.bincount(a[cut:], minlength=256)])
            at = np.flatnonzero(c)
            found.append((at, c[at]))
        return _counted(found)
    return run


# counts handed on together
ENTRIES = 1 << 18


def _summed(batches, counted) -> Iterator[tuple[pa.Array, list[np.ndarray], list[np.ndarray]]]:
    """(keys, codes, counts), codes ascending, from ``counted(batch)`` (keys, code lists, count lists); neighbours of one key are summed."""
    keys, codes, counts, held, size = [], [], [], False, 0

    def close():
        if isinstance(codes[-1], int):  # more than one row: the counts are one cell per code
            codes[-1] = np.flatnonzero(counts[-1])
            counts[-1] = counts[-1][codes[-1]]

    for b in batches:
        own, code, n = counted(b)
        ends, code, n = code.offsets.to_numpy(), code.values.to_numpy(), n.values.to_numpy()
        for i, key in enumerate(own.to_pylist()):
            c, k = code[ends[i]:ends[i + 1]], n[ends[i]:ends[i + 1]]
            if held and key == keys[-1]:
                if not isinstance(codes[-1], int):
                    cells = np.zeros(1 << 16, np.int64)
                    cells[codes[-1]] = counts[-1]
                    codes[-1], counts[-1] = 0, cells
                counts[-1][c] += k
                continue
            if held:
                close()
            if size >= ENTRIES:
                yield pa.array(keys, own.type), codes, counts
                keys, codes, counts, size = [], [], [], 0
            keys.append(key)
            codes.append(c)
            counts.append(k)
            held, size = True, size + len(c) + 1
    if held:
        close()
        yield pa.array(keys, own.type), codes, counts


def _from_counts(df: DataFrame, key: str, content: str, count, finish, fields: str, overlap: int = 0) -> DataFrame:
    """Rows (key, ``fields``) that ``finish`` makes of the code counts of whole keys: arrays (place of the key, code, n), codes ascending, and the number of keys.

    ``count`` counts the codes of parts, given them and their places.

    Content is counted to one row of parallel arrays before the only shuffle, which deals and sorts these rows by key.  No
    task holds a table of counts: an array entry is far smaller than a row of such a table, and sorted rows can be spilled.
    """
    kind = df.schema[key]

    def by_content(batches):
        def counted(b):
            c = count(b.column(1), b.column(2))
            return b.column(0), c.field(0), c.field(1)
        # few parts at a time: their counts can be much larger than they are
        few = (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512))
        for keys, codes, counts in _summed(few, counted):
            ends = pa.array(np.cumsum([0, *map(len, codes)]).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(t))) for x, t in ((codes, np.int32), (counts, np.int64))]
            yield pa.RecordBatch.from_arrays([keys, *arrays], names=[key, "code", "n"])

    def by_key(batches):
        for keys, codes, counts in _summed(batches, lambda b: b.columns):
            place, *rest = finish(np.repeat(np.arange(len(keys)), [len(c) for c in codes]), np.concatenate(codes).astype(np.int64), np.concatenate(counts).astype(np.int64), len(keys))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(place)), *[pa.array(x) for x in rest]], names=names)

    out = T.StructType([kind, *T.StructType.fromDDL(fields).fields])
    names = out.names
    lists = T.StructType([kind, T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.LongType()))])
    each = chunks(df, key, content, overlap=overlap).select(key, "part", "chunk").mapInArrow(by_content, lists)
    return each.repartition(key).sortWithinPartitions(key).mapInArrow(by_key, out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _block_entropies(parts: pd.Series, places: pd.Series) -> pd.Series:
    """Entropies of the full blocks of a part; content shorter than a block is one block of its own length."""
    def one(b, place):
        a = np.frombuffer(b, dtype=np.uint8)
        if place == 0 and len(a) < BLOCK:
            p = np.bincount(a, minlength=256)
            p = p[p > 0] / max(len(a), 1)
            return [float(-(p * np.log2(p)).sum()) + 0.0]
        full = len(a) // BLOCK
        if not full:
            return []
        a = a[:full * BLOCK].reshape(full, BLOCK)
        # one count of (block, byte) codes for all blocks of the part
        codes = (np.arange(full)[:, None] * 256 + a).ravel()
        p = np.bincount(codes, minlength=full * 256).reshape(full, 256) / BLOCK
        return (-np.sum(p * np.log2(np.where(p > 0, p, 1.0)), axis=1)).tolist()
    return pd.Series([one(b, place) for b, place in zip(parts, places)])


def byte_counts(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, byte, n)"""
    return _from_counts(df, key, content, lambda part, _: _byte_counts.func(part), lambda at, code, n, keys: (at, code.astype(np.int32), n), "byte int, n bigint")


def byte_histogram(df: DataFrame, key: str, content: str) -> DataFrame:
    """Share of each byte value present in the content.  A key's total comes from its at most 256 counts."""
    def finish(at, code, n, keys):
        return at, code.astype(np.int32), n, n / np.bincount(at, n, keys)[at]
    return _from_counts(df, key, content, lambda part, _: _byte_counts.func(part), finish, "byte int, n bigint, share double")


def entropy(df: DataFrame, key: str, content: str, head: int = BLOCK) -> DataFrame:
    """Shannon entropy of the whole content, its first ``head`` bytes and the rest (0 when there is no rest).

    Every byte is looked at once: head and rest are counted apart, and their sums are the counts of the whole.
    """
    def finish(at, code, n, keys):
        def h(at, n):
            total = np.maximum(np.bincount(at, n, keys), 1.0)
            return np.log2(total) - np.bincount(at, n * np.log2(n), keys) / total
        cell, where = np.unique(at << 8 | code & 255, return_inverse=True)
        first = code < 256
        return np.arange(keys), h(cell >> 8, np.bincount(where, n, len(cell))), h(at[first], n[first]), h(at[~first], n[~first])
    return _from_counts(df, key, content, _head_counts(head).func, finish, "whole double, head double, tail double")


def block_entropies(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, block, h) over full blocks of 1,024 bytes; shorter content is one block of its own length."""
    return chunks(df, key, content).select(key, "chunk", F.posexplode(_block_entropies("part", "chunk")).alias("__i", "h")) \
        .select(key, (F.col("chunk") * (CHUNK // BLOCK) + F.col("__i")).alias("block"), "h")


def block_entropy(df: DataFrame, key: str, content: str) -> DataFrame:
    """Maximum, minimum, mean and population deviation of the block entropies."""
    return block_entropies(df, key, content).groupBy(key).agg(
        F.count(F.lit(1)).alias("blocks"), F.max("h").alias("max_h"), F.min("h").alias("min_h"), F.avg("h").alias("mean_h"), F.stddev_pop("h").alias("std_h"))


def entropy_histogram(df: DataFrame, key: str, content: str, bins: int = 256) -> DataFrame:
    """Share of blocks per entropy bin over [0, 8]."""
    b = block_entropies(df, key, content)
    bin_ = F.least(F.floor(F.col("h") / 8.0 * bins), F.lit(bins - 1)).cast("int")
    counts = b.groupBy(key, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(key).agg(F.sum("n").alias("__t"))
    return counts.join(total, key).select(key, "bin", "n", (F.col("n") / F.col("__t")).alias("share"))


def transitions(df: DataFrame, key: str, content: str) -> DataFrame:
    """Counts of adjacent byte pairs (key, a, b, n)."""
    return _from_counts(df, key, content, _pairs_of, lambda at, code, n, keys: (at, (code >> 8).astype(np.int32), (code & 255).astype(np.int32), n), "a int, b int, n bigint", 1)


def folded_bigrams(df: DataFrame, key: str, content: str) -> DataFrame:
    """Pair counts folded to 256 cells by ``a xor b``, normalised."""
    def finish(at, code, n, keys):
        cell, where = np.unique(at << 8 | (code >> 8) ^ (code & 255), return_inverse=True)
        sums = np.bincount(where, n, len(cell))
        return cell >> 8, (cell & 255).astype(np.int32), sums / np.bincount(at, n, keys)[cell >> 8]
    return _from_counts(df, key, content, _pairs_of, finish, "cell int, share double", 1)


def row_entropy(df: DataFrame, key: str, content: str) -> DataFrame:
    """Entropy of each row of the row-normalised transition matrix."""
    def finish(at, code, n, keys):
        row = at << 8 | code >> 8
        first = np.flatnonzero(np.diff(row, prepend=-1))
        if not len(first):
            return at, code.astype(np.int32), n.astype(float)
        total = np.add.reduceat(n, first)
        return at[first], (row[first] & 255).astype(np.int32), np.log2(total) - np.add.reduceat(n * np.log2(n), first) / total
    return _from_counts(df, key, content, _pairs_of, finish, "a int, h double", 1)


def strings(df: DataFrame, key: str, content: str) -> DataFrame:
    """Runs of at least four printable bytes."""
    text = F.decode(content, "ISO-8859-1")
    return df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"([\x20-\x7e]{4,})"), 1)).alias("pos", "s"))


def string_stats(df: DataFrame, key: str, content: str) -> DataFrame:
    """Count, lengths and shares of address, path, library, program and digit strings; zeros without strings."""
    low, s = F.lower("s"), F.col("s")
    share = lambda cond, name: F.avg(cond.cast("double")).alias(name)
    g = strings(df, key, content).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_strings"), F.avg(F.length("s").cast("double")).alias("mean_len"), F.max(F.length("s")).alias("max_len"),
        F.stddev_pop(F.length("s")).alias("std_len"), positive(low.contains("http") | low.contains("www")).alias("n_web"), share(s.startswith("http"), "url_share"),
        share(s.contains("\\") | s.contains("/"), "path_share"), share(low.contains(".dll"), "dll_share"), share(low.contains(".exe"), "exe_share"),
        share(s.rlike("[0-9]"), "digit_share"))
    joined = df.select(key).join(g, key, "left")
    return joined.select(key, *[F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c) for c, t in g.dtypes if c != key])


# The sensitive terms, in output order.
SENSITIVE_TERMS = ["cmd", "powershell", "reg", "net ", "http", "ftp", "encrypt", "decrypt", "password", "admin", "root", "kernel32", "ntdll", "ws2_32",
                   "advapi32", "shell32", "create", "write", "delete", "execute", "inject", "mutex", "pipe", "socket", "connect", "download", "registry",
                   "service", "process", "thread", "hook"]


def term_flags(text: Column, terms: list[str] = SENSITIVE_TERMS) -> list[Column]:
    """One 0/1 flag per term, case-insensitive."""
    low = F.lower(text)
    return [low.contains(t).cast("int").alias(f"t{i}") for i, t in enumerate(terms)]


def match_rules(df: DataFrame, key: str, text: str, rules: list[tuple[str, str, bool]], hits: int = 5) -> DataFrame:
    """Names of matching rules (name, pattern, is_regex) and the first ``hits`` of them.

    Rules are a small reviewed list; they become expressions of one projection, so texts are neither multiplied nor joined.
    """
    low = F.lower(F.col(text))
    found = F.array_compact(F.array(*[F.when(F.col(text).rlike("(?i)" + p) if rx else low.contains(p.lower()), F.lit(n)) for n, p, rx in rules]))
    return df.select(key, found.alias("rules")).where(F.size("rules") > 0).select(key, "rules", F.slice("rules", 1, hits).alias("first_hits"))


def hashed_features(tokens: DataFrame, key: str, token: str, n: int, signed: bool = True) -> DataFrame:
    """Hashing trick (key, bucket, value): md5 head modulo ``n``, sign from its top bit.

    Unsigned features are counts as ``log1p`` scaled to unit length.
    """
    head = F.conv(F.substring(F.md5(F.col(token).cast("binary")), 1, 8), 16, 10).cast("bigint")
    sign = F.when(F.shiftright(head, 31).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1) if signed else F.lit(1)
    rows = tokens.where(F.length(token) > 0).select(key, (head % n).cast("int").alias("bucket"), sign.alias("__s"))
    sums = rows.groupBy(key, "bucket").agg(F.sum("__s").cast("double").alias("value"))
    if signed:
        return sums
    scaled = sums.withColumn("value", F.log1p("value"))
    norm = scaled.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("__n"))
    return scaled.join(norm, key).select(key, "bucket", (F.col("value") / (F.col("__n") + 1e-8)).alias("value"))


def ngrams(words: Column, n: int, sep: str = "_") -> Column:
    """Array of joined n-grams of a token array."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), sep))) \
        .otherwise(F.array().cast("array<string>"))


def text_ngrams(text: Column, n: int) -> Column:
    """Array of character n-grams."""
    last = F.length(text) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i + 1, F.lit(n)))) \
        .otherwise(F.array().cast("array<string>"))


# Instruction classes; a mnemonic listed twice belongs to the later class.
INSTRUCTION_CLASSES: dict[str, list[str]] = {
    "arithmetic": ["add", "sub", "mul", "imul", "div", "idiv", "inc", "dec", "neg", "adc", "sbb"],
    "logic": ["and", "or", "xor", "not", "shl", "shr", "sar", "sal", "rol", "ror", "rcl", "rcr"],
    "transfer": ["mov", "movzx", "movsx", "lea", "xchg", "cmov", "movaps", "movdqa"],
    "branch": ["jmp", "je", "jne", "jz", "jnz", "jg", "jl", "jge", "jle", "ja", "jb", "jae", "jbe", "call", "ret", "loop", "int"],
    "stack": ["push", "pop", "pusha", "popa", "pushf", "popf", "enter", "leave"],
    "string": ["movs", "cmps", "scas", "lods", "stos", "rep", "repe", "repne"],
    "flag": ["stc", "clc", "cmc", "std", "cld", "sti", "cli", "lahf", "sahf"],
    "float": ["fld", "fst", "fstp", "fadd", "fsub", "fmul", "fdiv", "fcom", "fxch"],
    "simd": ["addps", "mulps", "subps", "divps", "paddb", "paddw", "paddd", "pxor", "xmm", "ymm", "zmm"],
    "system": ["syscall", "sysenter", "rdtsc", "cpuid", "rdmsr", "wrmsr", "hlt", "in", "out"],
    "nop": ["nop"],
    "interrupt": ["int", "int3", "iret"],
    "io": ["in", "out", "ins", "outs"],
    "prefix": ["lock", "rep", "repz", "repnz", "cs", "ds", "es", "fs", "gs", "ss"],
}


def category_share(tokens: DataFrame, key: str, token: str, classes: dict[str, list[str]] = INSTRUCTION_CLASSES) -> DataFrame:
    """Share of each token class per key; unknown tokens are "other"."""
    lookup = {w: c for c, words in classes.items() for w in words}
    members: dict[str, list[str]] = {}
    for word, cls in lookup.items():
        members.setdefault(cls, []).append(word)
    # one hash-set test per class
    named = F.coalesce(*[F.when(F.col(token).isin(words), c) for c, words in members.items()], F.lit("other"))
    counts = tokens.groupBy(key, named.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(key).agg(F.sum("n").alias("__t"))
    return counts.join(total, key).select(key, "category", "n", (F.col("n") / F.col("__t")).alias("share"))


def build_vocab(tokens: DataFrame, token: str, k: int = 10000, min_freq: int = 1, specials: list[str] = ["<unk>", "<pad>"]) -> DataFrame:
    """Vocabulary (token, idx, count): specials first, then the ``k`` most frequent tokens, ties by text."""
    from pyspark.sql import Window
    from quorate.functions.rows import literal_rows
    top = tokens.groupBy(F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_freq) \
        .orderBy(F.desc("count"), "token").limit(k)
    ranked = top.select("token", (F.row_number().over(Window.orderBy(F.desc("count"), "token")) + len(specials) - 1).alias("idx"), "count")
    head = literal_rows(tokens.sparkSession, [(s, i, 0) for i, s in enumerate(specials)], "token string, idx int, count bigint")
    return head.unionByName(ranked)


def encode(tokens: DataFrame, token: str, vocab: DataFrame, unk: int = 0) -> DataFrame:
    """Add ``idx``; tokens outside the vocabulary get the unknown index.

    A vocabulary is cut to its ``k`` most frequent tokens when built, so it is bounded and broadcast; hot tokens never meet in one task.
    """
    v = vocab.select(F.col("token").alias(token), "idx")
    return tokens.join(F.broadcast(v), token, "left").withColumn("idx", F.coalesce("idx", F.lit(unk)))


def set_fingerprint(tokens: DataFrame, key: str, token: str, name: str = "fingerprint") -> DataFrame:
    """md5 of the sorted, lower-cased, comma-joined distinct names per key.

    Names are gathered as sets before they are sent, so a key whose tokens come from one task moves once, as one row.
    """
    names = F.collect_set(F.when(F.lower(token) != "", F.lower(token)))
    return tokens.groupBy(key).agg(names.alias("__t")).where(F.size("__t") > 0).select(key, F.md5(F.array_join(F.sort_array("__t"), ",").cast("binary")).alias(name))
