"""Personal data by rules, spread by a skip-chain conditional random field.

Rules find e-mail addresses, IP addresses, payment cards and phone numbers.  They decide the base spans, which always stay.
The field then labels what the rules left open: number groups of seven digits or more and words with an @ sign.  A document's
candidates form a chain in text order; skip edges join candidates that repeat or resemble each other (equal or equally
ending digits, equal address without case), each to the one before it with the same key.  Base spans are observed; loopy
belief propagation passes their labels along, so one document labels an entity in one way.  Candidates whose label wins
against "none" are added.

Potentials are estimated from all documents: counts of shape, digit count and neighbouring words by label (hashed into a
fixed number of cells), counts of label pairs along the chain, and agreement of observed labels across skip edges.

Defined cases: NULL is an empty text; offsets are code points, ends exclusive; texts of any length are read whole in linear
time; repeated rows are judged alike; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm.common import with_arrays

KINDS = ["email", "ip", "card", "phone"]
NONE = 4
CELLS = 4096
ROUNDS = 12
DAMPING = 0.3
FEATURE_WEIGHT = 0.5
MAX_SKIP = 8.0
RULE_FAILED = 4.0  # log-odds for "none" that an open candidate carries: the rules have looked at it and said no

NOT_LEFT = re.compile(r"[^A-Za-z0-9._%+-]")
RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
OPEN = re.compile(r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+|[^\s@<>\"'(),;]++@[^\s@<>\"'(),;]++")
DIGITS = re.compile(r"[0-9]")
GAP = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from the @ signs: what stands before one is scanned back to the last sign or match only."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and not NOT_LEFT.match(text, start - 1, start):
            start -= 1
        m = RIGHT.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules, in order."""
    found = [(a, 0, b) for a, b in emails(text)]
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            d = GAP.sub("", m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= len(GAP.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Spans and labels (-1: open) in text order; open candidates touch no base span.  Of base spans that overlap, the first is observed."""
    seen, end = [], 0
    for a, k, b in base:
        if a >= end:
            seen.append((a, b, k))
            end = b
    taken, j = sorted((a, b) for a, _, b in base), 0
    reach = 0
    for m in OPEN.finditer(text):
        while j < len(taken) and taken[j][0] < m.end():
            reach = max(reach, taken[j][1])
            j += 1
        if reach <= m.start():
            seen.append((m.start(), m.end(), -1))
    seen.sort()
    return [(a, b) for a, b, _ in seen], [k for _, _, k in seen]


def _cell(kind: int, value: str) -> int:
    return kind * CELLS + xxhash.xxh3_64_intdigest(value) % CELLS


def node_cells(text: str, a: int, b: int) -> tuple[int, int, int, int]:
    """Feature cells of a candidate: shape, digit count, word before, word after."""
    s = text[a:min(b, a + 64)]
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"[0-9]", "9", re.sub(r"[A-Za-z]", "a", s)))
    before = text[max(0, a - 40):a].rstrip(" \"'=:([").rsplit(None, 1)[-1:]
    after = text[b:b + 40].split(None, 1)[:1]
    return (_cell(0, shape), _cell(1, str(min(b - a - len(DIGITS.sub("", text[a:b])), 30))), _cell(2, before[0].lower() if before else ""), _cell(3, after[0].lower() if after else ""))


def skip_edges(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each candidate with the last one before it under the same key: all digits, the last nine digits, or the address."""
    last: dict[tuple, int] = {}
    edges = set()
    for i, (a, b) in enumerate(spans):
        s = text[a:b]
        d = GAP.sub("", s)
        keys = [("a", s.lower())] if "@" in s else [("d", d)] + ([("e", d[-9:])] if len(d) >= 9 else [])
        for k in keys:
            if k in last:
                edges.add((last[k], i))
            last[k] = i
    return sorted(edges)


@dataclass
class Field:
    nodes: np.ndarray  # (4 x CELLS, 5) log-odds against "none"
    prior: np.ndarray  # (5,)
    chain: np.ndarray  # (5, 5) log potentials
    skip: float  # log potential of equal labels across a skip edge


def fit(docs: DataFrame, text: str = "text") -> Field:
    """Potentials from the whole table: partial sums in the tasks, at most 5 x (4 x CELLS + 8) rows reach the driver."""

    def count(batches):
        nodes, chain, prior = np.zeros((4 * CELLS, 5), dtype=np.int64), np.zeros((5, 5), dtype=np.int64), np.zeros(5, dtype=np.int64)
        agree = np.zeros(5, dtype=np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if not t:
                    continue
                spans, labels = candidates(t, base_spans(t))
                full = [k if k >= 0 else NONE for k in labels]
                for (a, z), k in zip(spans, full):
                    prior[k] += 1
                    for c in node_cells(t, a, z):
                        nodes[c, k] += 1
                for x, y in zip(full, full[1:]):
                    chain[x, y] += 1
                for i, j in skip_edges(t, spans):
                    if labels[i] >= 0 and labels[j] >= 0:
                        agree[0 if labels[i] == labels[j] else 1] += 1
        whole = np.concatenate([nodes.reshape(-1), chain.reshape(-1), prior, agree])
        at = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(whole[at])], names=["i", "n"])

    got = docs.select(text).mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    whole = np.zeros(4 * CELLS * 5 + 35)
    whole[got.column(0).to_numpy()] = got.column(1).to_numpy()
    nodes, chain, prior, agree = np.split(whole, [4 * CELLS * 5, 4 * CELLS * 5 + 25, 4 * CELLS * 5 + 30])
    nodes, chain, prior = nodes.reshape(-1, 5) + 0.1, chain.reshape(5, 5) + 1.0, prior + 1.0
    share = nodes / (prior * 1.0 + 0.1 * CELLS)
    odds = np.log(share) - np.log(share[:, NONE:])
    p = chain / chain.sum(axis=1, keepdims=True)
    link = np.log(p / (prior / prior.sum()))
    return Field(FEATURE_WEIGHT * odds, np.log(prior) - np.log(prior[NONE]), FEATURE_WEIGHT * link, float(min(MAX_SKIP, np.log((agree[0] + 20.0) / (agree[1] + 0.02)))))


def infer(field: Field, cells: np.ndarray, labels: list[int], skips: list[tuple[int, int]]) -> np.ndarray:
    """Marginals by damped sum-product over chain and skip edges; observed nodes are clamped."""
    n = len(labels)
    node = field.nodes[cells].sum(axis=1) + field.prior
    node[:, NONE] += RULE_FAILED
    for i, k in enumerate(labels):
        if k >= 0:
            node[i] = -30.0
            node[i, k] = 0.0
    edges = [(i, i + 1, True) for i in range(n - 1)] + [(i, j, False) for i, j in skips]
    if not edges:
        return np.exp(node - node.max(axis=1, keepdims=True)) / np.exp(node - node.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)
    src = np.array([e[0] for e in edges] + [e[1] for e in edges])
    dst = np.array([e[1] for e in edges] + [e[0] for e in edges])
    same = field.skip * np.eye(5)
    pot = np.stack([field.chain if c else same for _, _, c in edges] + [field.chain.T if c else same for _, _, c in edges])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    msg = np.zeros((len(src), 5))
    for _ in range(ROUNDS):
        total = node.copy()
        np.add.at(total, dst, msg)
        out = (total[src] - msg[back])[:, :, None] + pot
        top = out.max(axis=1, keepdims=True)
        new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        msg = DAMPING * msg + (1 - DAMPING) * new
    total = node.copy()
    np.add.at(total, dst, msg)
    e = np.exp(total - total.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def find(text: str | None, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with those of the field, as (start, kind, end) in order."""
    if not text:
        return [], []
    base = base_spans(text)
    spans, labels = candidates(text, base)
    if all(k >= 0 for k in labels):
        return base, base
    cells = np.array([node_cells(text, a, b) for a, b in spans])
    best = infer(field, cells, labels, skip_edges(text, spans)).argmax(axis=1)
    more = [(a, int(k), b) for (a, b), old, k in zip(spans, labels, best) if old < 0 and k != NONE]
    return base, sorted(base + more)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def report(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of base spans by kind, their digest, all spans, and how many the field added."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(texts: pa.Array) -> list[pa.Array]:
        got = [find(t, shared.value) for t in texts.to_pylist()]
        counts = [pa.array([sum(1 for s in base if s[1] == k) for base, _ in got], pa.int64()) for k in range(4)]
        return counts + [pa.array([hashlib.sha256(spell(base).encode()).hexdigest() for base, _ in got], pa.string()),
                         pa.array([spell(every) for _, every in got], pa.string()), pa.array([len(every) - len(base) for base, every in got], pa.int64())]

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]
    return with_arrays(docs.select(F.col(key), F.col(text).alias("__p_text")), ["__p_text"], fields, run).drop("__p_text")


def mask(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(texts: pa.Array) -> list[pa.Array]:
        out = []
        for t in texts.to_pylist():
            spans = find(t, shared.value)[1]
            if spans:
                parts, at = [], 0
                for a, k, b in spans:
                    if a >= at:
                        parts += [t[at:a], f"[{KINDS[k]}]"]
                    at = max(at, b)
                t = "".join(parts) + t[at:]
            out.append(t)
        return [pa.array(out, pa.string())]

    masked = with_arrays(docs, [text], [T.StructField("__p_masked", T.StringType())], run)
    return masked.select(*[F.col("__p_masked").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
