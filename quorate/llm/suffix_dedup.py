"""Repeated passages: every byte of a 100-byte string that also starts earlier is removed.

1. Anchors.  Each 100-byte window of a document selects the 32-byte gram with the least hash (the last of equal ones); windows
   next to each other with one anchor form a run.  Equal windows select the same anchor at the same place, so only runs with
   equal anchors can share a window.  Gram hashes come from prefix polynomial hashes of the bytes.
2. Equal runs.  A run's bytes are hashed as well.  Inside a task, and then per anchor hash over all documents, every run but the
   first of equal ones (smallest doc_id, then earliest start) is removed as a whole.
3. Suffix sort.  Different runs with one anchor are sorted by what follows the anchor and by what precedes it (backwards).
   The mergesort compares two suffixes by binary search for their common extension on prefix hashes, which takes seven
   looks at 100 bytes; neighbours' extensions are then checked byte for byte, and a collision sorts that part plainly.
   Suffixes whose common extensions reach a depth form classes; a window with o bytes before its anchor is repeated if an
   earlier run is in its class at depth o on the left and at depth 100 - o on the right.
4. Removed ranges are merged by document and cut out.

Anchors common to very many different runs (a line that stands everywhere) are found on a sample and go by their window hashes
instead, 128 bits each, which spread over all tasks.  The sample decides only the way, never the result.

Defined cases: NULL and empty texts have no bytes; texts under 100 bytes lose nothing; every row is a document of its own: rows that
share an id stand in the order of a hash of their texts, rows without id come last, in that order too; an empty table gives
an empty result; extra columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import BROADCAST_ROWS, stored
from quorate.operators.ordering import hash_digits, id_digits, rank0

SPAN = 100
GRAM = 32
REACH = SPAN - GRAM  # bytes before an anchor that a window can have
CHUNK = 1 << 19
PART_BYTES = 32_000_000
PAYLOAD_BYTES = 48_000_000  # per-document lists are broadcast up to this size, else joined by shuffle
HOT_RUNS = 200_000
SAMPLE = 64
LAST = 2**63 - 1

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
KEEP = np.uint64((2**64 - 1) ^ (2**20 - 1))
LOW = np.uint64(2**20 - 1)
RUN = np.dtype([("g", "<i8"), ("c", "<i8"), ("doc", "<i8"), ("start", "<i8"), ("before", "u1"), ("size", "u1")])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse for i < n, modulo 2^64."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, CHUNK + 2 * SPAN)
        _powers[0] = tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)))) for b in (BASE, INVERSE))
    return _powers[0][0][:n], _powers[0][1][:n]


def runs_of(data: np.ndarray, bounds: np.ndarray, docs: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The runs of concatenated documents (``bounds``: where each begins, and the end).  Runs of ``hot`` anchors come window by window."""
    out = []
    valid = np.ones(len(data), dtype=bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        valid[max(a, b - SPAN + 1):b] = False
    for lo in range(0, len(data) - SPAN + 1, CHUNK):
        part = data[lo:lo + CHUNK + SPAN - 1]
        ok = valid[lo:lo + len(part) - SPAN + 1]
        if not ok.any():
            continue
        up, down = powers(len(part) + 1)
        prefix = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[:-1], out=prefix[1:])
        grams = _mix((prefix[GRAM:] - prefix[:-GRAM]) * down[:len(part) + 1 - GRAM])
        key = (grams & KEEP) | (LOW - np.arange(len(grams), dtype=np.uint64))
        width = 1
        least = key
        while 2 * width <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = REACH + 1 - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        anchor = (LOW - (least & LOW)).astype(np.int64)
        begin = ok.copy()
        begin[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
        first = np.flatnonzero(begin)
        if not len(first):
            continue
        stop = ~ok
        stop[1:] |= anchor[1:] != anchor[:-1]
        edges = np.append(np.flatnonzero(stop), len(ok))
        last = edges[np.searchsorted(edges, first, side="right")] - 1
        at = anchor[first]
        g = grams[at].astype(np.int64)
        end = last + SPAN
        c = _mix((prefix[end] - prefix[first]) * down[first] + (at - first).astype(np.uint64) * M1 + (end - first).astype(np.uint64)).astype(np.int64)
        if len(hot):
            is_hot = np.isin(g, hot)
            if is_hot.any():
                many = (last - first + 1)[is_hot]
                s = np.repeat(first[is_hot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                h1 = _mix((prefix[s + SPAN] - prefix[s]) * down[s] + M2).astype(np.int64)
                second = np.random.default_rng(5).integers(0, 2**63, SPAN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                h2 = np.zeros(len(s), dtype=np.uint64)
                for k in range(SPAN):
                    h2 = _mix(h2 + part[s + k] * second[k])
                first, end, at, g, c = (np.concatenate([x[~is_hot], y]) for x, y in ((first, s), (end, s + SPAN), (at, s), (g, h1), (c, h2.astype(np.int64))))
        rows = np.empty(len(first), dtype=RUN)
        own = np.searchsorted(bounds, first + lo, side="right") - 1
        rows["g"], rows["c"], rows["doc"], rows["start"], rows["before"], rows["size"] = g, c, docs[own], first + lo - bounds[own], at - first, end - first
        out.append(rows)
    return np.concatenate(out) if out else np.zeros(0, dtype=RUN)


def split_equal(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of equal runs, the others), by g and c; the first has the least (doc, start)."""
    order = np.lexsort((rows["start"], rows["doc"], rows["c"], rows["g"]))
    rows = rows[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows["g"][1:] != rows["g"][:-1]) | (rows["c"][1:] != rows["c"][:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(rows) else np.zeros(0, dtype=np.int64)
    later = ~new & ((rows["doc"] != rows["doc"][lead]) | (rows["start"] != rows["start"][lead]))
    return rows[new], rows[later]


def merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges by document, joined where they overlap or touch."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    where = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    big = int(b.max()) + 1
    if where[-1] and big > (2**62) // int(where[-1] + 1):
        raise OverflowError("more text than one task can hold")
    reach = np.maximum.accumulate(where * big + b)
    new = np.append(True, (where[1:] * big + a[1:]) > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], a[first], np.append(reach[first[1:] - 1], reach[-1]) - where[first] * big


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else v for v in columns.values()], names=list(columns))


def _ranges(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return merged(rows["doc"], rows["start"], rows["start"] + rows["size"])


def _buffers(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts in order of their ids, bounds, and ids."""
    ids = ids.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    texts = texts.fill_null("").cast(pa.large_binary()).take(pa.array(order))
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[bounds[0]:bounds[-1]] if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data, bounds - bounds[0], ids[order]


def pieces(batch: pa.RecordBatch, most: int = 16_000_000) -> list[pa.RecordBatch]:
    """A batch in pieces of about ``most`` bytes of text, documents whole."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique(np.append(np.searchsorted(sizes, np.arange(most, sizes[-1] if len(sizes) else 0, most), side="right"), len(sizes)))
    return [batch.slice(a, z - a) for a, z in zip([0, *cuts[:-1].tolist()], cuts.tolist()) if z > a]


def _find(parts: int, hot: np.ndarray):
    """(part, data): runs dealt by anchor hash, and under negative parts the ranges that one task can decide alone."""
    def run(batches):
        for b in (p for whole in batches for p in pieces(whole)):
            data, bounds, ids = _buffers(b.column(0), b.column(1))
            first, later = split_equal(runs_of(data, bounds, ids, hot))
            part = ((first["g"].view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            names, values = [], []
            for p in range(parts):
                if cuts[p] < cuts[p + 1]:
                    names.append(p)
                    values.append(pack_runs(first[order[cuts[p]:cuts[p + 1]]]))
            if len(later):
                names.append(-1 - int(ids[0]) % parts)
                values.append(np.stack(_ranges(later)).tobytes())
            yield _table(part=pa.array(names, pa.int32()), data=pa.array(values, pa.binary()))
    return run


def pack_runs(rows: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(rows[n]).tobytes() for n in RUN.names)


def unpack_runs(raw: bytes) -> np.ndarray:
    n = len(raw) // RUN.itemsize
    out, at = np.empty(n, dtype=RUN), 0
    for name in RUN.names:
        kind = RUN[name]
        out[name] = np.frombuffer(raw, dtype=kind, count=n, offset=at)
        at += n * kind.itemsize
    return out


def _decide(batches):
    """Per part: ranges of runs that are not the first of equal ones, and (kind 1) different runs that share an anchor."""
    def judge(held):
        first, later = split_equal(np.concatenate(held))
        if len(later):
            d, a, z = _ranges(later)
            yield _table(kind=pa.array(np.zeros(len(d), dtype=np.int8)), doc=d, a=a, b=z, g=np.zeros(len(d), dtype=np.int64))
        g = first["g"]  # ordered by g
        same = np.zeros(len(g), dtype=bool)
        same[1:] = g[1:] == g[:-1]
        open_ = same.copy()
        open_[:-1] |= same[1:]
        open_ &= first["size"] >= SPAN
        if open_.any():
            x = first[open_]
            yield _table(kind=pa.array(np.ones(len(x), dtype=np.int8)), doc=x["doc"].copy(), a=x["start"].copy(), b=x["before"].astype(np.int64) * 256 + x["size"], g=x["g"].copy())

    held, now = [], None
    for b in batches:
        for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if p < 0:
                d, a, z = np.frombuffer(raw, dtype=np.int64).reshape(3, -1)
                yield _table(kind=pa.array(np.zeros(len(d), dtype=np.int8)), doc=d, a=a, b=z, g=np.zeros(len(d), dtype=np.int64))
                continue
            if p != now and held:
                yield from judge(held)
                held = []
            now = p
            held.append(unpack_runs(raw))
    if held:
        yield from judge(held)


def common(prefix: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common extension of suffixes x and y by binary search on their prefix hashes."""
    lo, hi = np.zeros(len(x), dtype=np.int64), np.minimum(size[x], size[y])
    while True:
        live = lo < hi
        if not live.any():
            return lo
        mid = (lo + hi + 1) >> 1
        equal = prefix[x, mid] == prefix[y, mid]
        lo = np.where(live & equal, mid, lo)
        hi = np.where(live & ~equal, mid - 1, hi)


def suffix_order(text: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``text`` (first ``size`` bytes each) in order inside each group (groups stand together): order, and the common
    extension with the row before (-1 where a group begins).  Mergesort: all pairs of runs of one width are merged at once, each
    row finding its place in the other run by binary search."""
    n = len(text)
    up = powers(text.shape[1])[0]
    prefix = np.zeros((n, text.shape[1] + 1), dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[None], axis=1, out=prefix[:, 1:])
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    length = np.diff(np.append(begin, n))
    start, total = np.repeat(begin, length), np.repeat(length, length)
    order = np.arange(n)

    def less(x, y, or_equal):
        l = common(prefix, size, x, y)
        ends = (l == size[x]) | (l == size[y])
        at = np.minimum(l, text.shape[1] - 1)
        return np.where(ends, np.where(or_equal, size[x] <= size[y], size[x] < size[y]), text[x, at] < text[y, at])

    width = 1
    while width < length.max(initial=0):
        at = np.flatnonzero(total > width)
        base, inside = start[at], at - start[at]
        run = inside // width
        left = base + (run ^ 1) * width
        right = np.minimum(left + width, base + total[at])
        left = np.minimum(left, right)
        lo, hi, x, second = left.copy(), right.copy(), order[at], run % 2 == 1
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) >> 1
            # rows of the second run go behind equal rows of the first
            below = less(order[mid], x[live], second[live])
            lo[live] = np.where(below, mid + 1, lo[live])
            hi[live] = np.where(below, hi[live], mid)
        new = order.copy()
        new[base + (run // 2) * 2 * width + inside % width + (lo - left)] = x
        order = new
        width *= 2
    lcp = np.full(n, -1, dtype=np.int64)
    at = np.setdiff1d(np.arange(n), begin)
    x, y = order[at - 1], order[at]
    lcp[at] = common(prefix, size, x, y)
    # verification: the bytes agree as far as the hashes say and not further, and stand in order
    cols = np.arange(text.shape[1])
    for k in range(0, len(at), 50_000):
        p, q, l = x[k:k + 50_000], y[k:k + 50_000], lcp[at[k:k + 50_000]]
        differ = (text[p] != text[q]) & (cols[None] < np.minimum(size[p], size[q])[:, None])
        true = np.where(differ.any(axis=1), differ.argmax(axis=1), np.minimum(size[p], size[q]))
        wrong = true != l
        if wrong.any():
            return plain_order(text, size, group)
    return order, lcp


def plain_order(text: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by comparing bytes."""
    raw = [text[i, :size[i]].tobytes() for i in range(len(text))]
    order = np.array(sorted(range(len(text)), key=lambda i: (group[i], raw[i])), dtype=np.int64)
    order = order[np.argsort(np.searchsorted(np.flatnonzero(np.append(True, group[1:] != group[:-1])), order, side="right"), kind="stable")]
    lcp = np.full(len(text), -1, dtype=np.int64)
    for k in range(1, len(order)):
        if group[order[k]] == group[order[k - 1]]:
            x, y = raw[order[k - 1]], raw[order[k]]
            m = min(len(x), len(y))
            lcp[k] = next((i for i in range(m) if x[i] != y[i]), m)
    return order, lcp


def repeated_windows(text: np.ndarray, before: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs in order of (group, doc, start), with the anchor at column REACH: the most and the least bytes before the anchor
    among repeated windows (-1: none).  A run's windows have from ``before`` down to ``SPAN - after`` bytes before the anchor."""
    n = len(text)
    after = size - before
    ways = []
    for side, length in ((np.ascontiguousarray(text[:, :REACH][:, ::-1]), before), (np.ascontiguousarray(text[:, REACH:]), after)):
        order, lcp = suffix_order(side, length, group)
        ways.append((order, lcp))
    most, least = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)

    def classes(way, depth):
        order, lcp = way
        out = np.empty(n, dtype=np.int64)
        out[order] = np.cumsum(lcp < depth)
        return out

    for o in range(REACH + 1):
        at = np.flatnonzero((before >= o) & (SPAN - after <= o))
        if len(at) < 2:
            continue
        key = classes(ways[0], o)[at] * (n + 1) + classes(ways[1], SPAN - o)[at]
        first = np.unique(key, return_index=True)[1]
        later = np.ones(len(at), dtype=bool)
        later[first] = False
        hit = at[later]
        most[hit] = o
        least[hit] = np.where(least[hit] < 0, o, least[hit])
    return most, least


CONTEXT = np.dtype([("g", "<i8"), ("doc", "<i8"), ("at", "<i8"), ("before", "u1"), ("size", "u1"), ("text", "u1", (REACH + SPAN,))])


def _contexts(parts: int):
    """Bytes around the anchors that share their hash, dealt by it."""
    def run(batches):
        for b in batches:
            found = []
            for doc, text, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                g, start, pack = np.frombuffer(raw, dtype=np.int64).reshape(3, -1)
                data = np.frombuffer((text or "").encode(), dtype=np.uint8)
                x = np.zeros(len(g), dtype=CONTEXT)
                x["g"], x["doc"], x["before"], x["size"] = g, doc, pack // 256, pack % 256
                x["at"] = start + pack // 256
                where = x["at"][:, None] + np.arange(-REACH, SPAN)[None]
                inside = (where >= start[:, None]) & (where < (start + pack % 256)[:, None])
                x["text"] = np.where(inside, data[np.clip(where, 0, max(len(data) - 1, 0))], 0)
                found.append(x)
            if not found:
                continue
            x = np.concatenate(found)
            part = ((x["g"].view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
            names = np.unique(part)
            yield _table(part=names, data=pa.array([x[part == p].tobytes() for p in names], pa.binary()))
    return run


def _suffixes(batches):
    def judge(held):
        x = np.concatenate(held)
        x = x[np.lexsort((x["at"], x["doc"], x["g"]))]
        most, least = repeated_windows(x["text"], x["before"].astype(np.int64), x["size"].astype(np.int64), x["g"])
        hit = most >= 0
        d, a, z = merged(x["doc"][hit], x["at"][hit] - most[hit], x["at"][hit] - least[hit] + SPAN)
        return _table(doc=d, a=a, b=z)

    held, now = [], None
    for b in batches:
        for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if p != now and held:
                yield judge(held)
                held = []
            now = p
            held.append(np.frombuffer(raw, dtype=CONTEXT))
    if held:
        yield judge(held)


def pack_ranges(a: np.ndarray, b: np.ndarray) -> bytes:
    """Ranges in order, joined where they overlap or touch, as gap and length of four bytes each."""
    _, a, b = merged(np.zeros(len(a), dtype=np.int64), a, b)
    return np.stack([a - np.append(0, b[:-1]), b - a], axis=1).astype(np.uint32).tobytes()


def unpack_ranges(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.cumsum(np.frombuffer(raw, dtype=np.uint32).astype(np.int64)).reshape(-1, 2)
    return steps[:, 0], steps[:, 1]


def _range_lists(rows: DataFrame) -> DataFrame:
    """(doc, list): the ranges (a, b) of each document, merged and packed."""
    def run(batches):
        for b in batches:
            lists = b.column(1)
            packed = [pack_ranges(*(lists[k].values.field(c).to_numpy() for c in range(2))) for k in range(len(lists))]
            yield _table(doc=b.column(0), list=pa.array(packed, pa.binary()))

    return stored(rows.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("x")).mapInArrow(run, "doc long, list binary"))


def _lists(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(doc, list): per document the given long columns, packed one after the other."""
    def run(batches):
        for b in batches:
            lists = b.column(1)
            packed = []
            for k in range(len(lists)):
                x = lists[k].values
                packed.append(np.stack([x.field(c).to_numpy() for c in range(len(columns))]).astype(np.int64).tobytes())
            yield _table(doc=b.column(0), list=pa.array(packed, pa.binary()))

    return stored(rows.groupBy("doc").agg(F.collect_list(F.struct(*columns)).alias("x")).mapInArrow(run, "doc long, list binary"))


def _with_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Documents with their lists; small lists are broadcast and the texts stay where they are."""
    size = lists.agg(F.sum(F.length("list") + 32)).first()[0] or 0
    return docs.join(F.broadcast(lists) if size <= PAYLOAD_BYTES else lists, "doc", how).select("doc", "text", "list", *[c for c in docs.columns if c not in ("doc", "text")])


def hot_anchors(docs: DataFrame, hot_runs: int, sample: int) -> np.ndarray:
    """Anchors with so many different runs that one task should not hold them, estimated on one of ``sample`` documents."""
    def run(batches):
        for b in batches:
            data, bounds, ids = _buffers(b.column(0), b.column(1))
            g, n = np.unique(split_equal(runs_of(data, bounds, ids, np.zeros(0, dtype=np.int64)))[0]["g"], return_counts=True) if len(ids) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
            yield _table(g=g[n > 1], n=n[n > 1])

    some = docs.filter(F.pmod(F.xxhash64("doc", F.lit(3)), F.lit(sample)) == 0).select("doc", "text")
    rows = some.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2, hot_runs // sample))
    return np.sort(np.array([r[0] for r in rows.collect()], dtype=np.int64))  # at most (runs of the sample) / (hot_runs / sample)


def removed_ranges(docs: DataFrame, hot_runs: int = HOT_RUNS, sample: int = SAMPLE) -> DataFrame:
    """(doc, list): removed ranges of each document that has any; docs (doc, text), doc not NULL."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES + 1)
    hot = hot_anchors(docs, hot_runs, sample)
    found = docs.select("doc", "text").mapInArrow(_find(parts, hot), "part int, data binary")
    judged = stored(found.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_decide, "kind byte, doc long, a long, b long, g long"))
    ranges = judged.filter("kind = 0").select("doc", "a", "b")
    open_ = _lists(judged.filter("kind = 1"), ["g", "a", "b"])
    contexts = _with_lists(docs.select("doc", "text"), open_, "inner").mapInArrow(_contexts(parts), "part int, data binary")
    more = contexts.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_suffixes, "doc long, a long, b long")
    return _range_lists(ranges.union(more))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with a number of their own in ``doc``, in the order of their ids.

    While all ids differ, they are the numbers.  Otherwise ids are spread so far that the rows of the commonest one find room
    behind it; only the rows of shared ids are written anew, ranked by a hash of their texts.
    """
    shared = stored(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    size = shared.agg(F.max("n"), F.count(F.lit(1))).first()
    if size[0] is None:
        return rows
    room = 1 << (size[0] - 1).bit_length()
    span = rows.filter(F.col("doc") != LAST).agg(F.min("doc"), F.max("doc")).first()
    low, high = (span[0], span[1]) if span[0] is not None else (0, 0)
    columns = rows.columns
    if (high + 2) * room < 2**63 and low * room > -2**63:
        rows = rows.withColumn("__place", F.when(F.col("doc") == LAST, F.lit(high + 1)).otherwise(F.col("doc")))
    else:  # ids too far apart: their ranks take their place
        ranks = stored(rank0(rows.select("doc").distinct(), [], id_digits(F.col("doc")), [F.col("doc")], "__place"))
        rows = rows.join(ranks, "doc")
    ids = shared.select("doc")
    ids = F.broadcast(ids) if size[1] <= BROADCAST_ROWS else ids
    several = rows.join(ids, "doc", "left_semi").withColumn("__h", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    several = stored(rank0(several, ["doc"], hash_digits(F.col("__h")), [F.col("__h"), F.col("text")], "__row"))
    alone = rows.join(ids, "doc", "left_anti").withColumn("__row", F.lit(0).cast("long"))
    both = alone.select(*columns, "__place", "__row").unionByName(several.select(*columns, "__place", "__row"))
    return both.withColumn("doc", F.col("__place") * room + F.col("__row")).select(*columns)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False, **bounds) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept_bytes]) of every row."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.col(text).alias("text"), F.col(key).alias("__s_key"))
    rows = numbered(rows)
    lists = removed_ranges(rows.select("doc", "text"), **bounds)

    def run(batches):
        for b in batches:
            n, removed, spans, marks, rest = [], [], [], [], []
            for t, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = (t or "").encode()
                cut = 0
                if raw:
                    a, z = unpack_ranges(raw)
                    kept, at = [], 0
                    for x, y in zip(a.tolist(), z.tolist()):
                        kept.append(t[at:x])
                        at = y
                    kept.append(t[at:])
                    left, cut = b"".join(kept), len(a)
                else:
                    left = t
                n.append(len(t))
                removed.append(len(t) - len(left))
                spans.append(cut)
                marks.append(hashlib.sha256(left).hexdigest())
                rest.append(left if with_text else b"")
            cols = [b.column(3), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(marks, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(rest, pa.binary())] if with_text else []), names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_bytes"] * with_text)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    return _with_lists(rows, lists, "left").mapInArrow(run, schema).withColumnRenamed("key", key)
