"""Document quality by a factorisation machine.

Features of a document, all hashed into one fixed width: its distinct words, the shapes of its words with their share,
structure statistics cut into steps (length, word length, symbols, capitals, digits, blanks, repeated lines and words,
separators, line length), and its size in bytes as metadata.  A factorisation machine gives every feature a weight and a
short vector; all pairwise interactions are scored in linear time as half of (square of the sum - sum of the squares).

Training reads at most ``max_rows`` labelled documents (bounded parameter, the same documents on every run) and runs
mini-batch AdaGrad over them in a fixed order.  Scoring is one pass over all documents.

Defined cases: NULL and empty texts have only the structure features of an empty text; NULL ids are scored as any other and
count as not held out; repeated labels count once (1 wins); without labels of both classes every score is the base rate
(0.5 where there is none).  Extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm.common import bounded_labels, stored, with_arrays

WIDTH = 1 << 14
WORDS = WIDTH - 1024  # word cells come first, structure cells last
FACTORS = 8
EPOCHS = 12  # passes over the sample, more where it is small: at least MIN_STEPS batches
MIN_STEPS = 1000
BATCH = 64
RATE = 0.05
DECAY = 1e-4
MAX_TRAIN_ROWS = 12_000

# byte classes: blank, lower case, upper case, digit, symbol, bar, other ASCII, beyond ASCII
_CLASS = np.full(256, 7, dtype=np.int64)
_CLASS[:128] = 6
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in "#*$%&<>!@^~=+_\\"]] = 4
_CLASS[ord("|")] = 5


def _step(x: float, per: float, top: int) -> int:
    return min(top, int(x * per))


def structure(raw: bytes, words: list[bytes]) -> list[int]:
    """Structure cells: one per statistic, by its step."""
    n, size = len(words), len(raw)
    shares = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=8) / max(size, 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(set(words)) / max(n, 1)
    steps = [_step(np.log2(n + 1), 2, 40), _step(np.log2(size + 1), 2, 60), _step((size - shares[0] * size) / max(n, 1), 2, 40), *[_step(s, 40, 40) for s in shares],
             _step(distinct, 20, 20), _step(len(set(lines)) / max(len(lines), 1), 20, 20), _step(np.log2(n / max(len(lines), 1) + 1), 2, 30)]
    ends = sum(1 for x in lines if x.rstrip()[-1:] in b".!?\"") / max(len(lines), 1)
    steps.append(_step(ends, 10, 10))
    return [WORDS + 61 * k % 1024 + s for k, s in enumerate(steps)]


def features(text: str | None, cache: dict[bytes, int]) -> np.ndarray:
    """The distinct cells of a document."""
    raw = (text or "").encode()
    words = raw.lower().split()
    kinds = set(words)
    for w in kinds.difference(cache):
        cache[w] = xxhash.xxh3_64_intdigest(w.strip(b".,;:!?\"'()")) % WORDS
    return np.unique(np.array([cache[w] for w in kinds] + structure(raw, words), dtype=np.int64))


def _packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, their values, and where each row begins.  Words of one document share one unit of weight."""
    at = np.concatenate(rows)
    starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
    word = at < WORDS
    number = np.add.reduceat(word.astype(np.float64), starts)
    values = np.where(word, 1 / np.sqrt(np.maximum(np.repeat(number, np.diff(np.append(starts, len(at)))), 1)), 1 / 4)
    return at, values, starts


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        at, x, starts = _packed(rows)
        vx = self.factors[at] * x[:, None]
        return self.bias + np.add.reduceat(self.weights[at] * x, starts) + 0.5 * (np.add.reduceat(vx, starts) ** 2 - np.add.reduceat(vx * vx, starts)).sum(axis=1)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def train(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """AdaGrad on the logistic loss; the gradient of a factor is x (sum - own part)."""
    base = (y.sum() + 0.5) / (len(y) + 1)
    rng = np.random.default_rng(20)
    model = Model(float(np.log(base / (1 - base))), np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, FACTORS)))
    if not 0 < y.sum() < len(y):
        model.factors[:] = 0
        return model
    past_w, past_v, past_b = np.full(WIDTH, 1e-4), np.full((WIDTH, FACTORS), 1e-4), 1e-4
    for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            own = order[k:k + BATCH]
            at, x, starts = _packed([rows[i] for i in own])
            of = np.repeat(np.arange(len(own)), np.diff(np.append(starts, len(at))))
            vx = model.factors[at] * x[:, None]
            total = np.add.reduceat(vx, starts)
            margin = model.bias + np.add.reduceat(model.weights[at] * x, starts) + 0.5 * (total ** 2 - np.add.reduceat(vx * vx, starts)).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[own]) / len(own)
            cells, slot = np.unique(at, return_inverse=True)
            step_w = np.bincount(slot, err[of] * x, len(cells)) + DECAY * model.weights[cells]
            pull = (err[of] * x)[:, None] * (total[of] - vx)
            step_v = np.stack([np.bincount(slot, pull[:, f], len(cells)) for f in range(FACTORS)], axis=1) + DECAY * model.factors[cells]
            past_w[cells] += step_w ** 2
            past_v[cells] += step_v ** 2
            past_b += err.sum() ** 2
            model.weights[cells] -= RATE * step_w / np.sqrt(past_w[cells])
            model.factors[cells] -= RATE * step_v / np.sqrt(past_v[cells])
            model.bias -= RATE * err.sum() / np.sqrt(past_b)
    return model


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, max_rows: int = MAX_TRAIN_ROWS, text: str = "text") -> Model:
    """Learn from at most ``max_rows`` labelled documents (labels: doc_id, quality); their features, not texts, are read."""
    chosen = stored(bounded_labels(labels, "quality", F.lit(True) if keep is None else keep, max_rows))
    rows = docs.select("doc_id", F.col(text).alias("t")).join(F.broadcast(chosen), "doc_id").select("doc_id", "t", "y")

    def cells(batches):
        for b in batches:
            cache: dict[bytes, int] = {}
            found = [features(t, cache).astype(np.int16) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.int16()))], names=["doc_id", "y", "cells"])

    got = rows.mapInArrow(cells, T.StructType([docs.schema["doc_id"], T.StructField("y", T.IntegerType()), T.StructField("cells", T.ArrayType(T.ShortType()))])).toArrow()
    lists = got.column(2).combine_chunks()
    flat, bounds = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy()
    ids = np.array(got.column(0).to_pylist())
    order = np.lexsort((bounds[1:] - bounds[:-1], ids)) if len(ids) else []
    y = got.column(1).to_numpy().astype(np.float64)
    return train([flat[bounds[i] - bounds[0]:bounds[i + 1] - bounds[0]] for i in order], y[order] if len(ids) else y)


def score_documents(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Append score (0 to 1, higher: better) and predicted (1 from ``threshold`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list[pa.Array]:
        cache: dict[bytes, int] = {}
        rows = [features(t, cache) for t in texts.to_pylist()]
        score = np.concatenate([shared.value.scores(rows[k:k + 500]) for k in range(0, len(rows), 500)]) if rows else np.zeros(0)
        return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]

    return with_arrays(docs, [text], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], run)
