"""Toxic passages by maximum-scoring segment search.

Training: document counts of every word by class give log-odds with an informative Dirichlet prior (the prior follows the
words' overall frequency).  A word scores the lower confidence bound of its log-odds, less a cost that makes neutral text
negative; its beginnings of three to six letters are counted as well and the best of these scores holds, so unseen
forms of known words are found.  All are counted in two hash rows of fixed width and score the smaller of their two cells,
so the model has one size whatever the corpus.

Search: a linear scan finds all maximal scoring segments of a document (disjoint passages none of which gains by growing or
shrinking).  With lambda solving sum p(w) exp(lambda s(w)) = 1 over clean text and K fitted on clean documents, a passage
of score S in a text of N words has the E-value K N exp(-lambda S).

Score: the best passage's evidence, -ln E, and that of the r best passages together (the Poisson tail of the r-th highest
score, at its best r) enter a logistic calibration on labelled documents kept out of the word counts.

Defined cases: NULL and empty texts have no passage and get the score of no evidence; words are runs of letters and digits in
lower case; documents with NULL id are scored as any other and count as not held out; repeated labels of one document count
once (1 wins); without usable labels every score is the base rate (0.5 where there is none).  Extra columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm.common import bounded_labels, stored, with_arrays

WIDTH = 1 << 16
PRIOR = 2000.0
CONFIDENCE = 2.0
COST = 0.25
CALIBRATION = 800  # slots below this of 1,000 train word counts, the others the calibration
MAX_TRAIN_ROWS = 50_000
BEGINNINGS = (6, 5, 4, 3)
WORD = re.compile(r"[^\W_]+")


def cells(word: str) -> list[tuple[int, int]]:
    """The cells, in both hash rows, of a word and of its beginnings of three to six letters (for inflected and joined forms)."""
    word = word.lower()
    keys = [word] + [f"{k}:{word[:k]}" for k in BEGINNINGS if len(word) >= k]
    hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
    return [(h & (WIDTH - 1), WIDTH + ((h >> 32) & (WIDTH - 1))) for h in hashes]


@dataclass
class Model:
    scores: np.ndarray  # 2 x WIDTH float32, flat
    rate: float  # lambda
    size: float = 1.0  # K
    logistic: tuple[float, float, float] = (0.0, 0.0, 0.0)  # bias, best passage, r best passages


def word_scores(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Per cell: lower bound of the Dirichlet-smoothed log-odds, less the cost."""
    both = toxic + clean
    alpha = PRIOR * (both + 0.1) / (both.sum() + 0.1 * len(both))
    total = alpha.sum()
    odds = np.log((toxic + alpha) / np.maximum(n_toxic + total - toxic - alpha, 1e-9)) - np.log((clean + alpha) / np.maximum(n_clean + total - clean - alpha, 1e-9))
    sd = np.sqrt(1 / (toxic + alpha) + 1 / (clean + alpha))
    shrunk = np.sign(odds) * np.maximum(0, np.abs(odds) - CONFIDENCE * sd)
    return np.where(both > 0, shrunk, 0.0) - COST


def solve_rate(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(x s) = 1; 1 where there is none."""
    if p.sum() <= 0 or (p * s).sum() >= 0 or s[p > 0].max() <= 0:
        return 1.0
    p = p / p.sum()
    lo, hi = 0.0, 1.0
    while (p * np.exp(np.minimum(hi * s, 500))).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 500))).sum() < 1 else (lo, mid)
    return max(hi, 1e-3)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, end, score), in linear time over the positive runs."""
    hot = np.flatnonzero(scores > 0)
    if not len(hot):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    # first, end, sum before, sum through, and the place of the last earlier segment with a smaller sum before
    found: list[tuple[int, int, float, float, int]] = []
    for i in hot.tolist():
        first, left, right = i, total[i], total[i + 1]
        j = len(found) - 1
        while j >= 0 and found[j][2] >= left:
            j = found[j][4]
        while j >= 0 and found[j][3] < right:
            first, _, left, _, up = found[j]
            del found[j:]
            j = up
        found.append((first, i + 1, left, right, j))
    return [(a, b, right - left) for a, b, left, right, _ in found]


def _lookup(model: Model, cache: dict[str, float], words: list[str]) -> np.ndarray:
    missing = set(words).difference(cache)
    if missing:
        missing = list(missing)
        at = [cells(w) for w in missing]
        flat = np.array([c for cs in at for c in cs])
        first = np.cumsum([0] + [len(cs) for cs in at[:-1]])
        best = np.maximum.reduceat(np.minimum(model.scores[flat[:, 0]], model.scores[flat[:, 1]]), first)
        cache.update(zip(missing, best.tolist()))
    return np.fromiter(map(cache.__getitem__, words), dtype=np.float32, count=len(words))


def _evidence(model: Model, words: list[str], cache: dict[str, float]) -> tuple[int, float, float, int, tuple[int, int]]:
    """Words, best score, evidence of the r highest segments, that r, and the best segment.

    E(r) = K N exp(-lambda S(r)) segments as good as the r-th are expected by chance; the evidence is the largest
    r ln(r / E(r)) - r + E(r), the exponent of the Poisson tail.
    """
    if not words:
        return 0, 0.0, 0.0, 0, (-1, -1)
    segs = maximal_segments(_lookup(model, cache, words))
    if not segs:
        return len(words), 0.0, 0.0, 0, (-1, -1)
    s = np.sort([x for _, _, x in segs])[::-1]
    r = np.arange(1, len(s) + 1)
    expected = model.size * len(words) * np.exp(-np.minimum(model.rate * s, 600))
    tail = np.where(expected < r, r * np.log(r / np.maximum(expected, 1e-300)) - r + expected, 0.0)
    a, b, top = max(segs, key=lambda x: x[2])
    return len(words), top, float(tail.max()), int(tail.argmax()) + 1 if tail.max() > 0 else 0, (a, b)


def _features(model: Model, n: np.ndarray, top: np.ndarray, tail: np.ndarray) -> np.ndarray:
    best = np.where(top > 0, np.clip(model.rate * top - np.log(model.size * np.maximum(n, 1)), -20, 60), -20)
    return np.stack([np.ones(len(n)), best, np.clip(tail, 0, 120)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a ridge logistic regression with few columns; the first column is the bias."""
    w = np.zeros(x.shape[1])
    pen = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pen @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pen + 1e-9 * np.eye(x.shape[1]), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _measured(rows: DataFrame, model: Model) -> np.ndarray:
    """Words, best score, tail evidence and label of labelled texts (t, y), in a fixed order: a few numbers for each of a bounded number of rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for b in batches:
            cache: dict[str, float] = {}
            got = [_evidence(shared.value, WORD.findall(t or ""), cache)[:3] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([float(g[k]) for g in got], pa.float64()) for k in range(3)] + [b.column(1).cast(pa.float64())], names=["n", "top", "tail", "y"])

    out = rows.mapInArrow(measure, "n double, top double, tail double, y double").toArrow()
    return np.array(sorted(zip(*[c.to_pylist() for c in out.columns])), dtype=np.float64).reshape(-1, 4).T


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, max_rows: int = MAX_TRAIN_ROWS, text: str = "text") -> Model:
    """Learn a model from at most ``max_rows`` labelled documents (labels: doc_id, toxic); ``keep`` selects label rows.

    The labels, not the texts, are moved: the bounded (doc_id, y, slot) rows are broadcast and texts stay where they are read.
    """
    train = stored(bounded_labels(labels, "toxic", F.lit(True) if keep is None else keep, max_rows))
    rows = docs.select("doc_id", F.col(text).alias("t")).join(F.broadcast(train), "doc_id")

    def count(batches):
        toxic, clean, used = (np.zeros(2 * WIDTH, dtype=np.int64) for _ in range(3))
        n = [0, 0, 0, 0]
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = WORD.findall(t or "")
                at = np.array(list({c for w in {w.lower() for w in words} for c in cells(w)}), dtype=np.int64).reshape(-1)
                np.add.at(toxic if y else clean, at, 1)
                n[0 if y else 1] += len(at) // 2
                n[2 if y else 3] += 1
                if not y:
                    np.add.at(used, np.array([cells(w)[0][0] for w in words], dtype=np.int64), 1)
        at = np.flatnonzero(toxic + clean)
        arrays = [np.append(at, [-1, -2]), np.append(toxic[at], [n[0], n[2]]), np.append(clean[at], [n[1], n[3]]), np.append(used[at], [0, 0])]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in arrays], names=["cell", "toxic", "clean", "used"])

    counts = (rows.filter(F.col("slot") < CALIBRATION).select("t", "y").mapInArrow(count, "cell long, toxic long, clean long, used long")
              .groupBy("cell").agg(F.sum("toxic"), F.sum("clean"), F.sum("used")).toArrow())  # at most 2 x WIDTH + 2 rows
    at = counts.column(0).to_numpy().astype(np.int64)
    dense = np.zeros((3, 2 * WIDTH + 2))
    for k in range(3):
        dense[k][np.where(at < 0, 2 * WIDTH - 1 - at, at)] = counts.column(k + 1).to_numpy()
    n_t, n_c, docs_t, docs_c = dense[0][2 * WIDTH], dense[1][2 * WIDTH], dense[0][2 * WIDTH + 1], dense[1][2 * WIDTH + 1]
    scores = np.concatenate([word_scores(dense[0][k:k + WIDTH], dense[1][k:k + WIDTH], n_t, n_c) for k in (0, WIDTH)])
    model = Model(scores.astype(np.float32), solve_rate(dense[2][:WIDTH], scores[:WIDTH]))
    base = (docs_t + 0.5) / (docs_t + docs_c + 1) if docs_t + docs_c else 0.5
    model.logistic = (float(np.log(base / (1 - base))), 0.0, 0.0)

    calibration = rows.filter(F.col("slot") >= CALIBRATION).select("t", "y")
    n, top, _, y = _measured(calibration, model)
    clean = y == 0
    if clean.any():
        model.size = float(clean.sum() / max(1e-12, (np.maximum(n[clean], 1) * np.exp(-model.rate * top[clean])).sum()))
    if 0 < y.sum() < len(y):
        n, top, tail, y = _measured(calibration, model)
        model.logistic = tuple(float(v) for v in fit_logistic(_features(model, n, top, tail), y))
    return model


def score_documents(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Append score, predicted, n_passages, passage_start and passage_end (code points of the best passage, -1 if none)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list[pa.Array]:
        model, cache = shared.value, {}
        got, spans = [], []
        for t in texts.to_pylist():
            t = t or ""
            n, top, tail, count, (a, b) = _evidence(model, WORD.findall(t), cache)
            got.append((n, top, tail, count))
            at = [m.span() for m in WORD.finditer(t)] if a >= 0 else []
            spans.append((at[a][0], at[b - 1][1]) if a >= 0 else (-1, -1))
        g = np.array(got, dtype=np.float64).reshape(-1, 4)
        score = 1 / (1 + np.exp(-np.clip(_features(model, *g.T[:3]) @ np.array(model.logistic), -30, 30)))
        return [pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(g[:, 3].astype(np.int64)),
                pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64())]

    kinds = [("score", T.DoubleType()), ("predicted", T.IntegerType()), ("n_passages", T.LongType()), ("passage_start", T.LongType()), ("passage_end", T.LongType())]
    return with_arrays(docs, [text], [T.StructField(n, k) for n, k in kinds], run)


def passages(docs: DataFrame, model: Model, max_e: float = 0.01, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every passage with an E-value of at most ``max_e``: key, start, end (code points), score, e_value."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            cache: dict[str, float] = {}
            keys, starts, ends, scores, values = [], [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = list(WORD.finditer(t or ""))
                if not at:
                    continue
                for a, z, s in maximal_segments(_lookup(shared.value, cache, [m.group() for m in at])):
                    e = shared.value.size * len(at) * float(np.exp(-shared.value.rate * s))
                    if e <= max_e:
                        for column, value in zip((keys, starts, ends, scores, values), (k, at[a].start(), at[z - 1].end(), float(s), e)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(scores, pa.float64()), pa.array(values, pa.float64())],
                                             names=[key, "start", "end", "score", "e_value"])

    schema = T.StructType([docs.schema[key], *[T.StructField(n, k) for n, k in (("start", T.LongType()), ("end", T.LongType()), ("score", T.DoubleType()), ("e_value", T.DoubleType()))]])
    return docs.select(key, text).mapInArrow(run, schema)
