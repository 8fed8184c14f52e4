import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorate.operators import ordering as od


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 4000
    # one group holds most rows, values have many ties and a narrow cluster
    g = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n))
    v = np.where(rng.random(n) < 0.5, rng.integers(0, 20, n) / 20, 0.5 + rng.random(n) * 1e-7)
    pdf = pd.DataFrame({"id": np.arange(n) * 40_000, "g": g, "v": v, "y": rng.integers(0, 2, n)})
    return pdf, spark.createDataFrame(pdf)


def test_rank_matches_plain_window(frame):
    pdf, df = frame
    got = od.rank0(df, ["g"], od.real_digits(F.col("v")), [F.col("v"), F.col("id")]).toPandas().set_index("id")["rank0"]
    want = pdf.sort_values(["v", "id"]).groupby("g").cumcount()
    assert (got.sort_index().to_numpy() == want.reindex(pdf.index).to_numpy()).all()


def test_rank_by_id_and_text(frame, spark):
    pdf, df = frame
    got = od.rank0(df, [], od.id_digits(F.col("id")), [F.col("id")]).toPandas().set_index("id")["rank0"].sort_index()
    assert (got.to_numpy() == np.arange(len(pdf))).all()
    words = sorted({"", "a", "ab", "abc", "abcd", "é", "éa", "z", "zz", "Z"}, key=lambda w: w.encode())
    w = spark.createDataFrame([(x,) for x in words], "w string")
    rank = {r["w"]: r["rank0"] for r in od.rank_text(w, "w").collect()}
    assert [rank[x] for x in words] == list(range(len(words)))


def test_running_max_and_sum(frame):
    pdf, df = frame
    m = [od.Measure("s", F.col("y")), od.Measure("hi", F.col("v"), "max")]
    got = od.running(df, ["g"], od.id_digits(F.col("id")), [F.col("id")], m).toPandas().sort_values("id")
    assert (got["s"].to_numpy() == pdf.groupby("g")["y"].cumsum().to_numpy()).all()
    assert np.allclose(got["hi"].to_numpy(), pdf.groupby("g")["v"].cummax().to_numpy())


def test_percentiles(frame):
    pdf, df = frame
    got = od.percentiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p975": 0.975}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g, ["p10", "p50", "p975"]].to_numpy(float), np.percentile(part["v"], [10, 50, 97.5]))


def test_percentiles_of_negative_values(spark):
    x = [-1e9, -3.5, -0.1, 0.0, 2.0, 1e12]
    got = od.percentiles(spark.createDataFrame([(v,) for v in x], "v double"), [], "v", {"p": 0.3}).first()["p"]
    assert got == pytest.approx(np.percentile(x, 30))


def test_auc_with_ties_and_single_class(frame, spark):
    pdf, df = frame
    got = od.auc(df, ["g"], "v", "y").toPandas().set_index("g")["auc"]
    for g, part in pdf.groupby("g"):
        r = part["v"].rank()
        p = part["y"].sum()
        want = (r[part["y"] == 1].sum() - p * (p + 1) / 2) / (p * (len(part) - p))
        assert got[g] == pytest.approx(want)
    one = spark.createDataFrame([("x", 0.2, 1), ("x", 0.9, 1)], "g string, v double, y int")
    assert od.auc(one, ["g"], "v", "y").first()["auc"] is None


def test_ks(frame):
    pdf, df = frame
    got = od.ks_statistic(df, ["g"], "v", "y").toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        a, b = np.sort(part.loc[part.y == 0, "v"]), np.sort(part.loc[part.y == 1, "v"])
        at = np.concatenate([a, b])
        want = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()
        assert got.loc[g, "ks"] == pytest.approx(want)
        assert (got.loc[g, "n_a"], got.loc[g, "n_b"]) == (len(a), len(b))


def test_value_at(frame):
    pdf, df = frame
    got = od.value_at(df, [], "v", F.floor(F.col("n") / 2), "m").first()["m"]
    assert got == sorted(pdf["v"])[len(pdf) // 2]


@pytest.mark.parametrize("low,high", [(1e6, 1e12), (1 - 1e-9, 1.0), (-1e-9, 1e-9)])
def test_digits_spread_any_scale(spark, low, high):
    v = np.unique(np.random.default_rng(1).uniform(low, high, 5000))
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    full = df.select(*[d.alias(f"d{i}") for i, d in enumerate(od.real_digits(F.col("v")))])
    assert full.distinct().count() > 100
    got = od.rank0(df, [], od.real_digits(F.col("v")), [F.col("v")]).orderBy("v").toPandas()["rank0"]
    assert (got.to_numpy() == np.arange(len(v))).all()


def test_texts_with_a_common_beginning_are_ranked_over_partitions(spark):
    urls = [f"https://host.example/{i:06d}" for i in range(3000)]
    df = spark.createDataFrame([(u,) for u in urls], "u string").repartition(5, "u")
    got = {r["u"]: r["rank0"] for r in od.rank_text(df, "u").collect()}
    assert [got[u] for u in urls] == list(range(3000))


def test_real_digits_keep_the_order_of_any_double(spark):
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2**63 - 1, 4000, dtype=np.int64)
    x = np.concatenate([bits.view(np.float64), -bits.view(np.float64), 2.0 ** np.arange(-1074.0, 1024), np.nextafter(2.0 ** np.arange(-1000.0, 1024), 0), [0.0, -0.0, np.inf, -np.inf, 5e-324, 1.7976931348623157e308]])
    x = np.unique(x[~np.isnan(x)])
    df = spark.createDataFrame([(float(v),) for v in [*x, float("nan")]], "v double").coalesce(1)
    got = [tuple(r) for r in df.select(*od.real_digits(F.col("v"))).collect()]
    assert got == sorted(got) and all(0 <= d < 65536 for r in got for d in r[1:])


def test_ks_against_one_reference(frame):
    pdf, df = frame
    ref = df.where("y = 0")
    got = {r["g"]: r for r in od.ks_against(ref, df, ["g"], "v").collect()}
    base = np.sort(pdf.loc[pdf.y == 0, "v"].to_numpy())
    for g, part in pdf.groupby("g"):
        own = np.sort(part["v"].to_numpy())
        at = np.union1d(base, own)
        want = np.abs(np.searchsorted(base, at, "right") / len(base) - np.searchsorted(own, at, "right") / len(own)).max()
        assert got[g]["ks"] == pytest.approx(want) and got[g]["n_a"] == len(base) and got[g]["n_b"] == len(own)


def test_balanced_groups_of_one_size_spread(spark, monkeypatch):
    from quorate.operators import corpus as co
    seen = []
    plain = co.rank0

    def watched(df, keys, digits, order, name):
        seen.append(df.groupBy(*keys, *digits).count().agg(F.max("count")).first()[0])
        return plain(df, keys, digits, order, name)

    monkeypatch.setattr(co, "rank0", watched)
    df = spark.range(20_000).select(F.col("id").cast("string").alias("g"), F.lit(1).alias("label"), F.col("id"))
    got = co.assign_balanced(df, "label", "g")
    assert tuple(got.groupBy("period").count().agg(F.min("count"), F.max("count")).first()) == (1666, 1667)
    assert seen == [seen[0]] and seen[0] < 10
