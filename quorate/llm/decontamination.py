"""Benchmark items inside documents, found by walk embeddings and verified by edit distance.

A document contains an item if some stretch of its words turns into the item's words with at most ``MAX_EDITS`` (a fifth) of the
item's length in word insertions, deletions and replacements.

1. Agreement of walks falls as texts grow, so items of more than PIECE words are cut into equal pieces of at most so many.  An
   item within a fifth of edits has a piece within a fifth (all pieces beyond it would have more edits than the item may).
   Pieces are put into classes of similar length; every class looks at windows of its own size, at every word of every document.
2. q-gram lemma: a stretch within k edits of m words shares at least m - q + 1 - kq of the piece's q-grams.  Windows with
   fewer benchmark q-grams cannot match and are skipped; nothing within the bound is lost by this.
3. The other windows are embedded by CGK walks: at each step the current word is written, and a random bit that depends on step
   and word decides whether the walk moves on.  Texts a few edits apart meet again on the walk, so edit distance becomes
   Hamming distance.
4. Bit sampling: each table keys a window by DEPTH sampled places of a walk, ``samples`` tables for each of WALKS walks.  Windows
   that share a key with a piece of their class are candidates.  Measured recall at the bound, on 80 to 400 trials for each of
   replacements, insertions and deletions, at random and at even distances: 0.995 or more for 15 and 19 words, 0.99 or more from
   20 words on (1.0 for 60 and 120).  ``tables_for`` gives the number of tables for a known agreement.
5. Candidates are verified by the exact edit distance of the whole item to the best stretch.

The items are a stated query set: they are read in blocks of at most ``BLOCK_WORDS`` words, each broadcast to one pass over all
documents.  Documents never move.

Defined cases: words are runs of letters and digits in lower case, in scripts without blanks between words (``UNSPACED``) single
letters; NULL or empty texts contain nothing; items of two to four words are found by exact match of their words (a fifth of
them is no edit); items of one word (empty and NULL ones too) are not searched, as they are ordinary words; of equal items each is reported;
repeated documents repeat their rows; empty tables give no rows; extra columns do not matter.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm.common import with_arrays

# scripts that set no blanks between words: every letter is a word (kana and Chinese, Bopomofo, Yi, Thai, Lao, Tibetan, Burmese, Khmer, Tai)
UNSPACED = ("\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u3005-\u3007\u3031-\u3035\u3040-\u3130\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua48f"
            "\ua9e0-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U00016fe0-\U00018dff\U0001aff0-\U0001b16f\U00020000-\U0003ffff")
WORD = re.compile(rf"[^\W_{UNSPACED}]+|(?!_)[{UNSPACED}](?<=\w)")
# ASCII texts need no search: letters in lower case and digits stay, all else becomes a blank
PLAIN = str.maketrans({chr(c): chr(c).lower() if chr(c).isalnum() else " " for c in range(128)})
MAX_EDITS = 0.2
MIN_WORDS = 5
SHORT = (2, 3, 4)  # words of the items that are found by exact match
CLASS_RATIO = 1.2
PIECE = 19  # words of a piece at most
WALKS, SAMPLES, DEPTH = 4, 12, 3
LONG = 14  # classes from this size on take twice the samples
BLOCK_WORDS = 500_000
CHUNK = 4_000_000  # cells of a walk matrix
ODD = np.uint64(0x9E3779B97F4A7C15)
BLANK = np.uint64(0x5851F42D4C957F2D)


def tables_for(recall: float, agreement: float, depth: int = DEPTH) -> int:
    """Tables needed to find, with the given probability, a window whose sampled places agree with probability ``agreement``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement ** depth))


def samples(size: int) -> int:
    """Samples of each walk for one class: 12 find 0.975 of the worst case of 15 words (three deletions at even distances), 24 find 0.995."""
    return SAMPLES * (2 if size >= LONG else 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD
    return x ^ (x >> np.uint64(29))


def _grams(words: np.ndarray, q: int) -> np.ndarray:
    if len(words) < q:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(words) - q + 1, dtype=np.uint64)
    for k in range(q):
        h = _mix(h + words[k:len(words) - q + 1 + k])
    return h


def _gram_size(m: int, k: int) -> tuple[int, int]:
    """(q, least number of shared q-grams) for an item of m words and k edits: the longest of 3, 2, 1 that still says something."""
    return next((q, m - q + 1 - k * q) for q in (3, 2, 1) if m - q + 1 - k * q >= 1)


@dataclass
class Item:
    ident: object
    words: np.ndarray
    edits: int
    q: int
    shared: int
    grams: np.ndarray

    @classmethod
    def of(cls, ident: object, words: np.ndarray) -> Item:
        k = int(MAX_EDITS * len(words))
        q, shared = _gram_size(len(words), k)
        return cls(ident, words, k, q, shared, np.unique(_grams(words, q)))


@dataclass
class Piece:
    """A stretch of an item that the walks look for."""

    owner: int  # place of its item
    offset: int
    body: Item
    size: int


def _pieces(n: int, item: Item) -> list[Piece]:
    m = len(item.words)
    cuts = np.linspace(0, m, -(-m // PIECE) + 1).astype(int).tolist()
    return [Piece(n, a, Item.of(item.ident, item.words[a:b]), int(MIN_WORDS * CLASS_RATIO ** int(math.log((b - a) / MIN_WORDS, CLASS_RATIO) + 1e-9))) for a, b in zip(cuts, cuts[1:])]


class Index:
    """Everything that one pass needs about a block of items."""

    def __init__(self, items: list[tuple[object, str]]):
        self.items: list[Item] = []
        self.pieces: list[Piece] = []
        self.short: dict[int, dict[int, list[tuple[object, np.ndarray]]]] = {}  # by number of words and hash
        cache: dict[str, int] = {}
        for ident, text in items:
            words = hashed(text, cache)
            if len(words) >= MIN_WORDS:
                self.items.append(Item.of(ident, words))
                self.pieces += _pieces(len(self.items) - 1, self.items[-1])
            elif len(words) in SHORT:
                self.short.setdefault(len(words), {}).setdefault(int(_grams(words, len(words))[0]), []).append((ident, words))
        self.short_keys = {m: np.sort(np.fromiter(own, dtype=np.uint64, count=len(own))) for m, own in self.short.items()}
        bodies = [x.body for x in self.pieces]
        self.sizes = sorted({x.size for x in self.pieces})
        self.grams = {q: np.unique(np.concatenate([x.grams for x in bodies if x.q == q])) for q in {x.q for x in bodies}}
        self.bits = {q: _bitmap(g) for q, g in self.grams.items()}
        # per class and q: windows as long as its longest piece with all insertions, and the least number of shared q-grams
        self.rules: dict[int, list[tuple[int, int, int]]] = {}
        for s in self.sizes:
            own = [x.body for x in self.pieces if x.size == s]
            self.rules[s] = [(q, max(len(x.words) + x.edits for x in own if x.q == q), min(x.shared for x in own if x.q == q)) for q in {x.q for x in own}]
        rng = np.random.default_rng(99)
        self.steps = 2 * max(self.sizes, default=0)
        self.moves = rng.integers(0, 2**63, (WALKS, max(self.steps, 1)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.places = {s: np.random.default_rng(s).integers(0, 2 * s, (WALKS, samples(s), DEPTH)) for s in self.sizes}
        keys, owners = [], []
        for n, x in enumerate(self.pieces):
            for w in range(WALKS):
                marks = walk(x.body.words, np.array([0]), np.array([len(x.body.words)]), self.moves[w], 2 * x.size)
                keys.append(self.keys(marks, x.size, w)[0])
                owners += [n] * samples(x.size)
        keys, owners = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64), np.array(owners, dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.table, self.owners = keys[order], owners[order]

    def keys(self, marks: np.ndarray, size: int, w: int) -> np.ndarray:
        """(windows, samples) keys of one walk for one class."""
        h = np.arange(samples(size), dtype=np.uint64)[None] + np.uint64((size * WALKS + w) * 2 * SAMPLES)
        for d in range(DEPTH):
            h = _mix(h + marks[:, self.places[size][w, :, d]])
        return h

    def hits(self, words: np.ndarray, q: int) -> np.ndarray:
        """Running count of benchmark q-grams that begin before each place."""
        g = _grams(words, q)
        near = np.flatnonzero(self.bits[q][(g & np.uint64(_BITS - 1)).astype(np.int64)])
        found = np.zeros(len(words) + 1, dtype=np.int32)
        if len(near):
            at = np.searchsorted(self.grams[q], g[near])
            near = near[self.grams[q][np.minimum(at, len(self.grams[q]) - 1)] == g[near]]
            found[near + 1] = 1
        return np.cumsum(found, dtype=np.int32)

    def match(self, words: np.ndarray) -> list[tuple[object, int, int, int, int]]:
        """(item, edits, item words, first word, end word) of every item in one document."""
        return self._exact(words) + self._near(words)

    def _exact(self, words: np.ndarray) -> list[tuple[object, int, int, int, int]]:
        """Short items whose words stand in the document as they are, each at its first place."""
        out = []
        for m, keys in self.short_keys.items():
            grams = _grams(words, m)
            near = np.searchsorted(keys, grams)
            at = np.flatnonzero(keys[np.minimum(near, len(keys) - 1)] == grams)
            values, first = np.unique(grams[at], return_index=True)
            for g, i in zip(values.tolist(), at[first].tolist()):
                out += [(ident, 0, m, i, i + m) for ident, own in self.short[m][g] if (own == words[i:i + m]).all()]
        return out

    def _near(self, words: np.ndarray) -> list[tuple[object, int, int, int, int]]:
        if not self.items or len(words) == 0:
            return []
        runs = {q: self.hits(words, q) for q in self.grams}
        if all(r[-1] == 0 for r in runs.values()):
            return []
        n = len(words)
        # the count at the end goes on beyond it, for windows that reach there
        most = max(longest for rules in self.rules.values() for _, longest, _ in rules)
        ahead = {q: np.concatenate((r, np.full(most, r[-1], dtype=r.dtype))) for q, r in runs.items()}
        starts: dict[int, np.ndarray] = {}
        some = np.zeros(n, dtype=bool)
        for s in self.sizes:
            good = np.zeros(n, dtype=bool)
            for q, longest, shared in self.rules[s]:
                if runs[q][-1] >= shared:
                    good |= ahead[q][longest:longest + n] - runs[q][:-1] >= shared
            if good.any():
                starts[s] = np.flatnonzero(good)
                some |= good
        if not starts:
            return []
        found: dict[int, set[int]] = {}
        every = np.flatnonzero(some)
        steps = 2 * max(starts)
        for lo in range(0, len(every), max(1, CHUNK // steps)):
            part = every[lo:lo + max(1, CHUNK // steps)]
            # all places are in order: those of a class are found by search, once for all walks
            rows_of = {s: np.searchsorted(part, own[np.searchsorted(own, part[0]):np.searchsorted(own, part[-1], side="right")]) for s, own in starts.items()}
            for w in range(WALKS):
                marks = walk(words, part, np.full(len(part), n), self.moves[w], steps)
                for s, rows in rows_of.items():
                    if not len(rows):
                        continue
                    keys = self.keys(marks[rows], s, w).reshape(-1)
                    left = np.searchsorted(self.table, keys)
                    hit = np.flatnonzero(self.table[np.minimum(left, len(self.table) - 1)] == keys)
                    right = np.searchsorted(self.table, keys[hit], side="right")
                    for i, end in zip(hit.tolist(), right.tolist()):
                        for o in self.owners[left[i]:end].tolist():
                            found.setdefault(o, set()).add(int(part[rows[i // samples(s)]]))
        spans: dict[int, list[tuple[int, int]]] = {}
        for o, at in found.items():
            piece = self.pieces[o]
            item, k = self.items[piece.owner], piece.body.edits
            # the piece begins within k of the window; what stands before and after it may have all the item's edits
            before = piece.offset + (item.edits if piece.offset else 0) + k
            spans.setdefault(piece.owner, []).extend((max(0, s - before), min(n, s + k + len(item.words) - piece.offset + item.edits)) for s in at)
        out = []
        for o, own in sorted(spans.items()):
            best = self._verify(self.items[o], words, sorted(own))
            if best:
                out.append((self.items[o].ident, best[0], len(self.items[o].words), best[1], best[2]))
        return out

    def _verify(self, item: Item, words: np.ndarray, spans: list[tuple[int, int]]) -> tuple[int, int, int] | None:
        stretches: list[list[int]] = []
        for a, b in spans:
            if stretches and a <= stretches[-1][1]:
                stretches[-1][1] = max(b, stretches[-1][1])
            else:
                stretches.append([a, b])
        best = None
        for a, b in stretches:
            grams = _grams(words[a:b], item.q)
            at = np.minimum(np.searchsorted(item.grams, grams), len(item.grams) - 1)
            if (item.grams[at] == grams).sum() < item.shared:
                continue
            d, x, y = nearest_stretch(item.words, words[a:b])
            if d <= item.edits and (best is None or d < best[0]):
                best = (d, a + x, a + y)
        return best


_BITS = 1 << 20


def _bitmap(grams: np.ndarray) -> np.ndarray:
    bits = np.zeros(_BITS, dtype=bool)
    bits[(grams & np.uint64(_BITS - 1)).astype(np.int64)] = True
    return bits


def hashed(text: str | None, cache: dict[str, int]) -> np.ndarray:
    text = text or ""
    words = text.translate(PLAIN).split() if text.isascii() else WORD.findall(text.lower())
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def walk(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, moves: np.ndarray, steps: int) -> np.ndarray:
    """CGK embedding of the words from each start on: (starts, steps) words as written; a blank beyond the end."""
    at = starts.astype(np.int64)
    out = np.empty((len(starts), steps), dtype=np.int64)
    padded = np.append(words, BLANK)
    mixed = _mix(padded)
    for j in range(steps):
        out[:, j] = at
        at = np.minimum(at + ((mixed[at] * moves[j]) >> np.uint64(63)).astype(np.int64), ends)
    return padded[out]


def nearest_stretch(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to any stretch of the words, and that stretch (first, end)."""
    n = len(words)
    place = np.arange(n + 1)
    cost, origin = np.zeros(n + 1, dtype=np.int64), place.copy()
    for w in item:
        drop = cost + 1
        swap = np.concatenate(([n + len(item)], cost[:-1] + (words != w)))
        new, src = np.where(swap <= drop, swap, drop), np.where(swap <= drop, np.concatenate(([0], origin[:-1])), origin)
        low = np.minimum.accumulate(new - place)
        first = np.maximum.accumulate(np.where(new - place == low, place, 0))
        cost, origin = low + place, src[first]
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


def _blocks(items: DataFrame, key: str, text: str):
    """The items in blocks of about BLOCK_WORDS words (a single larger item makes a block of its own)."""
    rows = items.select(F.col(key).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, math.ceil(size / (5 * BLOCK_WORDS)))
    for k in range(parts):
        block = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        yield Index(sorted(((r.i, r.t) for r in block.collect()), key=lambda x: (str(x[0]), x[1])))


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """One row per document and item in it: key, item_key, edits, item_words, first_word, end_word (best stretch)."""
    schema = T.StructType([docs.schema[key], items.schema[item_key], *[T.StructField(n, T.IntegerType()) for n in ("edits", "item_words", "first_word", "end_word")]])
    out = None
    for index in _blocks(items, item_key, "text"):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                cache: dict[str, int] = {}
                rows = [(k, *m) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in shared.value.match(hashed(t, cache))]
                kinds = [b.column(0).type, None, *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind if kind is not None else item_type) for n, kind in enumerate(kinds)], names=schema.names)

        item_type = pa.int64() if isinstance(items.schema[item_key].dataType, T.LongType) else pa.int32() if isinstance(items.schema[item_key].dataType, T.IntegerType) else pa.string()
        part = docs.select(key, "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def keep(docs: DataFrame, items: DataFrame, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """The documents that contain no item; the columns of ``docs``."""
    columns = docs.columns
    for index in _blocks(items, item_key, "text"):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(texts: pa.Array, shared=shared) -> list[pa.Array]:
            cache: dict[str, int] = {}
            return [pa.array([len(shared.value.match(hashed(t, cache))) for t in texts.to_pylist()], pa.int32())]

        docs = with_arrays(docs, [text], [T.StructField("__d_items", T.IntegerType())], run).filter("__d_items = 0").drop("__d_items")
    return docs.select(*[F.col(f"`{c}`") for c in columns])
