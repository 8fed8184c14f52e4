"""Vector links, hard negatives and collocations against plain versions, and on odd input."""

import math
import random
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.llm import collocations, hard_negatives, near_dup, suffix_dedup, vector_links, vectors

VECTORS = "vec_id long, embedding array<float>, label int, n_links string, kept string, key string, id string, vec string, size int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "a", "b", "c", "d", "e", 1) for i, v, y in rows], VECTORS)


def clustered(n, width, seed, groups):
    """Random unit vectors; ``groups`` of (members, noise) lie around a centre of their own."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    at = 0
    for members, noise in groups:
        x[at:at + members] = rng.normal(size=width) / math.sqrt(width) + noise * rng.normal(size=(members, width)) / math.sqrt(width)
        at += members
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x[rng.permutation(n)].astype(np.float32)


def plain_links(ids, x, threshold=0.9):
    x = np.asarray(x, dtype=float)
    norm = np.linalg.norm(x, axis=1)
    near = (x / norm[:, None]) @ (x / norm[:, None]).T >= threshold
    np.fill_diagonal(near, False)
    comp = list(ids)
    changed = True
    while changed:
        new = [min([comp[k]] + [comp[j] for j in np.flatnonzero(near[k])]) for k in range(len(ids))]
        changed, comp = new != comp, new
    return {i: (int(near[k].sum()), comp[k], comp[k] == i) for k, i in enumerate(ids)}


# vector links -----------------------------------------------------------------------------------------------------------

def test_vectors_reads_any_list():
    import pyarrow as pa
    usable, x = vectors.dense(pa.array([[1.0, 2.0], None, [3.0], [1.0, None], [float("nan"), 1.0], []], pa.list_(pa.float32())))
    assert usable.tolist() == [True, False, True, False, False, True] and x.tolist() == [[1, 2], [0, 0], [3, 0], [0, 0], [0, 0], [0, 0]]


def test_layout_reaches_its_recall():
    for rows in (1, 50, 3_000, 10**6, 10**9):
        bits, tables = vector_links.layout(rows, 0.9)
        p = vector_links.collision(0.9, bits, 0.9)
        assert vector_links._reaches(tables, p, vector_links.COUNT) >= vector_links.RECALL
        assert vector_links._reaches(tables, vector_links.collision(0.95, bits, 0.9), vector_links.COUNT) > vector_links.RECALL
    assert vector_links.layout(10**9, 0.9)[0] > vector_links.layout(10**4, 0.9)[0]


def test_collision_probability_holds_for_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    bits, tables, pairs = 4, 40, 400
    a = rng.normal(size=(pairs, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(pairs, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * pairs)), pa.array(range(2 * pairs)), pa.array([1] * (2 * pairs)), pa.array(list(map(list, np.concatenate([a, b]))), pa.list_(pa.float64()))], names=["cls", "rep", "size", "vec"])
    out = next(vector_links._signed(bits, tables, 64, 0.9)([batch]))
    raw = [np.frombuffer(s, dtype=np.uint8) for s in out.column("signature").to_pylist()]
    cells = np.array([r[:4 * tables].view(np.int32) for r in raw])
    places = np.array([r[4 * tables:].view(np.int16) for r in raw]).astype(int)
    hit = (cells[:pairs] == cells[pairs:]) & (np.abs(places[:pairs] - places[pairs:]) <= vector_links.STEPS)
    assert abs(hit.mean() - vector_links.collision(0.9, bits, 0.9)) < 0.02


@pytest.mark.parametrize("seed", [1, 2])
def test_links_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(vector_links, "BLOCK", 40)  # hot cells are dealt into several blocks
    x = clustered(600, 32, seed, [(150, 0.05), (60, 0.25), (40, 0.33), (2, 0.1), (2, 0.3)])
    x[10] = x[20] = x[30]
    x[40] = 2.5 * x[41]
    ids = [int(k) * 3 + 1 for k in np.random.default_rng(seed).permutation(600)]
    got = {r[0]: tuple(r)[1:] for r in vector_links.links(frame(spark, [(i, v, 0) for i, v in zip(ids, x)]).repartition(5)).collect()}
    assert got == plain_links(ids, x)


def test_links_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(300, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(300, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9002 * a + math.sqrt(1 - 0.9002**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    got = vector_links.links(frame(spark, [(k, v, 0) for k, v in enumerate(np.concatenate([a, b]))])).filter("n_links > 0").count()
    assert got >= 0.98 * 600


def test_links_of_odd_rows(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, one, 0), (2, None, 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 0.0], 0), (5, [float("nan"), 1.0, 0.0], 0), (6, [float("inf"), 1.0, 0.0], 0), (7, [], 0), (None, one, 0),
            (8, one, 0), (8, one, 0), (9, two, 0), (8, two, 0), (10, [1.0], 0), (11, [1e-30, 0.0, 0.0], 0), (12, [-0.0, -1.0, 0.0], 0)]
    got = sorted((tuple(r) for r in vector_links.links(frame(spark, rows)).collect()), key=repr)
    want = [(1, 5 - 1, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (None, 0, None, True),
            (8, 4, 1, False), (8, 4, 1, False), (8, 1, 1, False), (9, 1, 1, False), (10, 4, 1, False), (11, 4, 1, False), (12, 0, 12, True)]
    assert got == sorted(want, key=repr)
    assert vector_links.links(frame(spark, [])).collect() == []


# hard negatives ---------------------------------------------------------------------------------------------------------

def plain_negatives(rows, anchor):
    q = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in q:
        if not anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in q if j != i))
        for s, j, z in [r for r in scored if r[2] == y][:5]:
            near = [r for r in scored if r[2] != y and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(i, j, rank + 1, k, -s, -t) for rank, (t, k, _) in enumerate(near)]
    return out


def test_residue_scores_are_exact_at_any_size():
    rng = np.random.default_rng(2)
    for most, width in ((256, 64), (10, 3), (2**20, 200), (2**30, 4), (int(math.isqrt((2**63 - 1) // 7)), 7)):
        a, b = (rng.integers(-most, most + 1, size=(9, width)) for _ in range(2))
        a[0], b[0], b[1] = most, most, -most
        moduli = hard_negatives.primes(width * most * most)
        got = hard_negatives.exact_scores([hard_negatives.residues(a.astype(float), p) for p in moduli], [hard_negatives.residues(b.astype(float), p) for p in moduli], moduli)
        assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert all(64 * (p // 2) ** 2 < 2**24 for p in hard_negatives.primes(2**62))


@pytest.mark.parametrize("ties", [False, True])
def test_negatives_match_brute_force(spark, ties, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROUND", 7)
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 32)
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", 3)
    rng = np.random.default_rng(5)
    x = rng.integers(-1, 2, size=(240, 6)) / 4 if ties else clustered(240, 16, 3, [(80, 0.4), (30, 0.1)])
    rows = [(int(i) - 20, v.tolist(), int(y)) for i, v, y in zip(rng.permutation(240), x, rng.integers(0, 3, 240))]
    df = frame(spark, rows).repartition(4)
    got = [tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(got) == sorted(plain_negatives(rows, lambda i: i % 10 == 0)) and got


def test_negatives_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (10, [1.0], 1), (1, [0.9, 0.0], 1), (2, [0.9, 0.1, 0.3], 0), (3, [0.85, 0.0], 2), (4, None, 0), (5, [1.0, None], 0), (6, [float("inf"), 0.0], 0), (7, [1.0, 0.0], None),
            (None, [0.9, 0.0], 0), (8, [], 1), (20, [], 1), (30, [5e5, 0.0], 4), (40, [6e5, 1.0], 4), (50, [5.5e5, 1.0], 5)]
    got = sorted(tuple(r) for r in hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0).collect())
    assert got == sorted(plain_negatives(rows, lambda i: i % 10 == 0)) and any(r[0] == 30 for r in got)
    assert hard_negatives.mine(frame(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine(frame(spark, rows), F.lit(None).cast("boolean")).collect() == []
    # components beyond what 64 bits can hold put their row out
    huge = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 0), (3, [1e30, 0.0], 0)]
    assert [tuple(r) for r in hard_negatives.mine(frame(spark, huge), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 65536, 65536)]


# collocations -----------------------------------------------------------------------------------------------------------

def plain_collocations(rows, top):
    """All counts of all phrases, straight from the definition."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                for k in range(len(words) - n + 1):
                    counts[lang, tuple(words[k:k + n])] += 1
    out = []
    frequent = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= 30}
    for (lang, p), a in frequent.items():
        inside = lambda q: any(q[k:k + len(p)] == p for k in range(len(q) - len(p) + 1))
        if any(lang == other and len(q) > len(p) and 100 * b >= 80 * a and inside(q) for (other, q), b in frequent.items()):
            continue
        score, k = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    rows = []
    for lang, own in groupby(sorted(out), key=lambda r: r[0]):
        rows += [(lang, rank + 1, p.decode(), -a, left, right, total[lang], -score) for rank, (_, score, a, p, left, right) in enumerate(own) if rank < top]
    return rows


def some_texts(seed, docs=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "é", "Ab", "aB", "x y", "$", "日本"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    fixed = [["new", "york", "city"], ["all", "rights", "reserved", "now"], ["a", "a", "a", "a", "a"], ["to", "be"], ["only", "here"]]
    out = []
    for k in range(docs):
        parts = []
        for _ in range(80):
            parts += rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choices(vocabulary, weights)
            parts.append(rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? "]))
        out.append((rnd.choice(["en", "de", None, "und"]), "".join(w if w in ",.\n!? \t  " else w + " " for w in parts)))
    return out + [("en", None), ("fr", ""), ("en", " , . "), ("it", "one two " * 40), ("en", "Long " * 30_000 + "end")]


@pytest.mark.parametrize("top", [5, 2000])
def test_collocations_match_their_definition(spark, top, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 5_000)
    monkeypatch.setattr(collocations, "FLUSH", 2_000)
    rows = some_texts(top)
    df = spark.createDataFrame([(lang, text, 1, "x", "y") for lang, text in rows], "lang string, text string, n int, phrase string, score string").repartition(3)
    got = sorted(tuple(r) for r in collocations.mine(df, top).collect())
    assert got == sorted(plain_collocations(rows, top))


def test_collocations_settle_early_and_keep_ties(spark, monkeypatch):
    """With few wanted the first rounds settle all languages, crowded cells or not; ties stand by count and phrase."""
    monkeypatch.setattr(collocations, "MOST_LEVELS", 8 * collocations.BUCKETS)
    monkeypatch.setattr(collocations, "MOST_CELLS", 64)
    rows = [("en", "p q. r s. t u. v w x y." * 30), ("en", "v z. " * 50), ("de", "p q. " * 31 + "p. " * 100)]
    got = sorted(tuple(r) for r in collocations.mine(spark.createDataFrame(rows, "lang string, text string"), 3).collect())
    assert got == sorted(plain_collocations(rows, 3)) and [r[2] for r in got if r[0] == "en"] == ["p q", "r s", "t u"]


def test_collocations_of_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None), ("en", ""), ("en", "a b")], "lang string, text string")).collect() == []


def test_bounds_are_never_below_scores():
    tokens = ("a b c , a b d , a c , " * 40).encode().split()
    cells = np.full(64, 10**6)
    part = collocations.Slice("en", tokens, collocations.Sent(np.full(64, 30), cells, np.full(4096, 3, dtype=np.uint8)))
    at = part.starts(2, 2)
    assert len(at) == 200 and (part.bound(at, 2) >= 2_000_000 * 30 // 60).all()
    assert (collocations.LEVELS[:-1][1:] >= collocations.LEVELS[:-1][:-1]).all() and collocations.LEVELS[0] == collocations.LEAST - 1


# repeated passages of rows that share an id ----------------------------------------------------------------------------------

def removed_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup(docs).collect()), key=repr)


def passage(seed, n=316):
    return "".join(random.Random(seed).choices("abcdefgh ", k=n))


@pytest.mark.parametrize("ident", [None, 7, 2**62])
def test_rows_that_share_an_id_keep_their_own_bytes(spark, ident):
    r, y = passage(1), passage(2, 400)
    assert removed_of(spark, [(1, r), (ident, r + "xxxxx"), (ident, y)]) == sorted([(1, 316, 0, 0), (ident, 321, 316, 1), (ident, 400, 0, 0)], key=repr)


def test_rows_of_one_id_are_judged_one_after_the_other(spark):
    r = passage(3)
    got = removed_of(spark, [(5, r), (5, r), (5, r + "tail"), (None, r), (None, r), (-2**62, "short"), (9, None), (9, None)])
    assert sum(n == 0 and size >= 316 for _, size, n, _ in got) == 1  # the first row of id 5, whichever text comes first by hash
    assert sum(n >= 316 for _, size, n, _ in got) == 4 and all(i is None or i == 5 for i, size, n, _ in got if n)
    assert [g for g in got if g[1] < 100] == [(-2**62, 5, 0, 0), (9, 0, 0, 0), (9, 0, 0, 0)]


def test_packed_ranges_round_trip():
    a, b = suffix_dedup.unpack_ranges(suffix_dedup.pack_ranges(np.array([500, 0, 90, 700, 2**31]), np.array([600, 100, 200, 800, 2**31 + 5])))
    assert a.tolist() == [0, 500, 700, 2**31] and b.tolist() == [200, 600, 800, 2**31 + 5]


def test_texts_under_one_id_stand_in_one_component(spark):
    words = lambda seed: " ".join(random.Random(seed).choices([f"w{k}" for k in range(500)], k=120))
    a, b, c = words(1), words(2), words(3)
    rows = [(3, a), (5, a), (5, b), (6, c), (8, b + " more"), (9, c + " end"), (10, words(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, width=3, percent=85).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (6, 6, True), (8, 3, False), (9, 6, False), (10, 10, True)]
    assert sorted(r.doc_id for r in near_dup.keep(docs, width=3).collect()) == [3, 6, 10]
