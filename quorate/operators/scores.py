"""Score matrices: one row per sample with an array of model scores, NULL for an absent model.

The array layout keeps every per-sample operator shuffle-free; period and model reports aggregate with partial sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions.columns import (add, count_present, elements, exceeds, greatest_present, least_present,
                                       mean_present, positive, ratio, sum_present)
from quorate.functions.rows import literal_rows
from quorate.operators import ordering


class ModelDims:
    """The model dimension: position in the score array -> view -> level."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.views_of = [v for v, _ in rows]
        self.levels_of = [lv for _, lv in rows]
        self.size = len(rows)

    def rows(self) -> list[tuple[int, str, str]]:
        return [(i, v, lv) for i, (v, lv) in enumerate(zip(self.views_of, self.levels_of))]

    @property
    def views(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for i, v in enumerate(self.views_of):
            out.setdefault(v, []).append(i)
        return out

    @property
    def levels(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for v, lv in zip(self.views_of, self.levels_of):
            out.setdefault(lv, [])
            if v not in out[lv]:
                out[lv].append(v)
        return out

    def frame(self, spark) -> DataFrame:
        return literal_rows(spark, self.rows(), "model_id int, view string, level string")


def to_long(scores: DataFrame, keep: list[str]) -> DataFrame:
    """One row per (sample, model)."""
    return scores.select(*keep, F.posexplode("scores").alias("model_id", "score"))


def to_wide(long: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Inverse of ``to_long``; ``keys`` identify a sample."""
    return long.groupBy(*keys).agg(F.array(*[F.max(F.when(F.col("model_id") == i, F.col("score"))) for i in range(size)])
                                   .alias("scores"))


def with_dims(long: DataFrame, dims: ModelDims) -> DataFrame:
    """Attach view and level; the dimension has one row per model, so it is always broadcast."""
    return long.join(F.broadcast(dims.frame(long.sparkSession)), "model_id")


def ensemble(scores: DataFrame, size: int, weights: list[float] | None = None, name: str = "ensemble") -> DataFrame:
    """Weighted mean over present models; weights are renormalised, non-positive totals fall back to equal weights."""
    s = elements("scores", size)
    if weights is None:
        return scores.withColumn(name, mean_present(s))
    num = add([F.coalesce(c, F.lit(0.0)) * w for c, w in zip(s, weights)])
    den = add([F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in zip(s, weights)])
    return scores.withColumn(name, F.when(den > 0, num / den).otherwise(mean_present(s)))


def vote_stats(scores: DataFrame, size: int, thr: float = 0.5) -> DataFrame:
    s = elements("scores", size)
    ok = count_present(s)
    votes = sum_present([exceeds(c, thr) for c in s]).cast("int")
    base = scores.select("*", ok.alias("ok_models"), (F.lit(size) - ok).alias("skipped_models"), votes.alias("malicious_votes"),
                         least_present(s).alias("min_score"), greatest_present(s).alias("max_score"))
    return base.withColumn("benign_votes", F.col("ok_models") - F.col("malicious_votes")).withColumn(
        "agreement_rate", ratio(F.col("malicious_votes"), F.col("ok_models")))


def confusion(df: DataFrame, keys: list[str], score: str, label: str, thr: float | Column = 0.5, inclusive: bool = False) -> DataFrame:
    """Confusion counts and rates per group; a rate is 0 where its denominator is 0."""
    p = exceeds(F.col(score), thr, inclusive)
    y = F.col(label)
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), positive((p == 1) & (y == 1)).alias("tp"), positive((p == 1) & (y == 0)).alias("fp"),
        positive((p == 0) & (y == 0)).alias("tn"), positive((p == 0) & (y == 1)).alias("fn"))
    return rates(counts)


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                         ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"),
                         ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def sweep(df: DataFrame, score: str, label: str, grid: list[float], inclusive: bool = True) -> DataFrame:
    """Confusion rates at every grid threshold from one pass.

    Each row lands in the cell of the highest grid value it reaches; counts above a threshold are running sums over
    the (few) cells, so rows are never multiplied by the grid.
    """
    grid = sorted(grid)
    hit = (lambda t: F.col(score) >= t) if inclusive else (lambda t: F.col(score) > t)
    cell = add([F.when(hit(t), 1).otherwise(0) for t in grid])
    cells = df.where(F.col(score).isNotNull()).groupBy(cell.alias("cell")).agg(
        positive(F.col(label) == 1).alias("pos"), positive(F.col(label) == 0).alias("neg"))
    grid_rows = literal_rows(df.sparkSession, [(i + 1, float(t)) for i, t in enumerate(grid)], "idx int, thr double")
    # cells and grid both have at most len(grid) + 1 rows
    joined = F.broadcast(grid_rows).join(cells, F.lit(True), "cross")
    above = F.col("cell") >= F.col("idx")
    counts = joined.groupBy("idx", "thr").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, F.col("neg")).otherwise(0)).alias("tn"), F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"))
    return rates(counts.drop("idx"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """Row with the highest F1, the smallest threshold on ties."""
    best = swept.agg(F.max_by(F.struct("thr", "f1", "precision", "recall"), F.struct(F.col("f1"), -F.col("thr"))).alias("b"))
    return best.select("b.*")


def model_eval(scores: DataFrame, size: int, keys: list[str] = [], star: float = 0.9) -> DataFrame:
    """Accuracy, AUC, mean score and star flag per model (and optional groups)."""
    long = to_long(scores, [*keys, "y"]).where(F.col("score").isNotNull())
    group = [*keys, "model_id"]
    acc = long.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg((exceeds(F.col("score"), 0.5) == F.col("y")).cast("double")).alias("accuracy"),
                                   F.avg("score").alias("mean_score"))
    return acc.join(ordering.auc(long, group, "score", "y"), group).withColumn("star", F.col("accuracy") >= star)


def auc_weights(evaluated: DataFrame) -> DataFrame:
    """Weights ``max(0, auc - 0.5)^2`` normalised over models; equal when all are zero.

    Give it models evaluated on a validation split, not on the periods later reported.
    """
    raw = F.coalesce(F.pow(F.greatest(F.col("auc") - 0.5, F.lit(0.0)), 2), F.lit(0.0))
    w = Window.partitionBy()
    return evaluated.withColumn("raw", raw).withColumn("total", F.sum("raw").over(w)).withColumn("models", F.count("raw").over(w)) \
        .withColumn("weight", F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(F.lit(1.0) / F.col("models"))) \
        .drop("raw", "total", "models")


def pair_terms(size: int, thr: float = 0.5) -> Column:
    """Array of (mi, mj, gap, differ) for i < j, built inside one projection."""
    s = elements("scores", size)
    p = [exceeds(c, thr) for c in s]
    return F.array(*[F.struct(F.lit(i).alias("mi"), F.lit(j).alias("mj"), F.abs(s[i] - s[j]).alias("gap"),
                              (p[i] != p[j]).cast("double").alias("differ")) for i in range(size) for j in range(i + 1, size)])


def model_pairs(scores: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """Score pairs of one sample, i < j; the fan-out is fixed by the number of models."""
    return scores.select(*keep, F.inline(pair_terms(size)))


def pair_sums(scores: DataFrame, size: int, keys: list[str], thr: float = 0.5) -> DataFrame:
    """Partial sums (keys, mi, mj, n, gap, differ) over Arrow batches of the score array.

    One batch of rows becomes at most K(K-1)/2 sums per group.  Enumerating the pairs row by row inside the JVM gives the
    same sums but measured more than ten times slower for 33 models.
    """
    types = dict(scores.dtypes)

    def partial(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
            frame = batch.select(keys).to_pandas() if keys else None
            groups = [((), slice(None))] if frame is None else [(k, i) for k, i in frame.groupby(keys, dropna=False).indices.items()]
            for key, rows in groups:
                part = m[rows]
                hit = part > thr
                out: dict[str, list] = {"mi": [], "mj": [], "n": [], "gap": [], "differ": []}
                for i in range(size - 1):
                    diff = np.abs(part[:, i:i + 1] - part[:, i + 1:])
                    ok = ~np.isnan(diff)
                    out["mi"].append(np.full(size - 1 - i, i))
                    out["mj"].append(np.arange(i + 1, size))
                    out["n"].append(ok.sum(0))
                    out["gap"].append(np.where(ok, diff, 0.0).sum(0))
                    out["differ"].append(((hit[:, i:i + 1] != hit[:, i + 1:]) & ok).sum(0))
                sums = {c: np.concatenate(v) for c, v in out.items()}
                key = key if isinstance(key, tuple) else (key,)
                cols = [pa.array([v] * len(sums["mi"]), type=batch.schema.field(k).type) for k, v in zip(keys, key)]
                cols += [pa.array(sums["mi"], pa.int32()), pa.array(sums["mj"], pa.int32()), pa.array(sums["n"], pa.int64()), pa.array(sums["gap"], pa.float64()),
                         pa.array(sums["differ"], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "mi", "mj", "n", "gap", "differ"])

    schema = "".join(f"{k} {types[k]}, " for k in keys) + "mi int, mj int, n bigint, gap double, differ bigint"
    return scores.select(*keys, "scores").mapInArrow(partial, schema)


def disagreement(scores: DataFrame, size: int, keys: list[str], ws: float = 0.6, wr: float = 0.4) -> DataFrame:
    """Upper triangle of the disagreement matrix per group: ``ws * mean|si - sj| + wr * mean(pi <> pj)``.

    Samples where one of the two models is absent do not count for that pair.
    """
    total = pair_sums(scores, size, keys).groupBy(*keys, "mi", "mj").agg(F.sum("n").alias("n"), F.sum("gap").alias("gap"), F.sum("differ").alias("differ"))
    return total.where("n > 0").select(*keys, "mi", "mj", (F.col("gap") / F.col("n")).alias("score_gap"), (F.col("differ") / F.col("n")).alias("pred_gap")) \
        .withColumn("d", F.col("score_gap") * ws + F.col("pred_gap") * wr)


def disagreement_rate(scores: DataFrame, size: int, keys: list[str], thr: float = 0.5) -> DataFrame:
    """Mean of ``pi <> pj`` over all K*K ordered cells: per row ``2 c (K - c) / K^2`` with c positive votes."""
    s = elements("scores", size)
    c = sum_present([exceeds(x, thr) for x in s])
    k = count_present(s)
    return scores.select(*keys, ratio(c * (k - c) * 2, k * k).alias("__r")).groupBy(*keys).agg(F.avg("__r").alias("rate"))


def top_view(scores: DataFrame, dims: ModelDims, name: str = "view") -> DataFrame:
    """View of the highest-scoring model, the first model on ties."""
    s = elements("scores", dims.size)
    best = greatest_present(s)
    pick = F.coalesce(*[F.when(c == best, F.lit(v)) for c, v in zip(s, dims.views_of)], F.lit("V_all"))
    return scores.withColumn(name, pick)


# Short name and class per view, prefix per drift type.
VIEW_TAG = {"V_byte": "ByS", "V_string": "Str", "V_struct": "PEs", "V_import": "Imp", "V_all": "Ens"}
VIEW_CLASS = {"V_byte": "Virus", "V_string": "Worm", "V_struct": "Trojan", "V_import": "Trojan", "V_all": "Virus"}
DRIFT_PREFIX = {"perturbation": "Gen", "structural": "GenKD", "paradigm_shift": "GenKD.2"}


def lookup(values: dict[str, str], key: Column, default: str | None) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def label_name(drift_type: Column, view: Column, digest: Column) -> Column:
    """Generated detection name: prefix by drift type or view class, view tag, first eight digest characters."""
    tag = lookup(VIEW_TAG, view, "Unk")
    suffix = F.when(F.length(digest) > 0, F.substring(digest, 1, 8)).otherwise("00000000")
    head = F.coalesce(lookup(DRIFT_PREFIX, drift_type, None), lookup(VIEW_CLASS, view, "Trojan"))
    return F.concat_ws(".", head, tag, suffix)
