import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.operators import content as ct
from quorate.operators import corpus as co
from quorate.operators import extensions as ex
from quorate.operators import graph as gr
from quorate.operators import matching as mt
from quorate.operators import models as mo
from quorate.operators import projections as pj
from quorate.operators import statistics as st
from quorate.streaming import streams as sr


def test_groups_stay_whole_and_balanced(spark):
    rows = [(g * 100 + i, lab, f"g{g}") for lab in (0, 1) for g, size in enumerate([700, 50, 30, 30, 10] + [3] * 40) for i in range(min(size, 99))]
    df = spark.createDataFrame(rows, "id bigint, label int, grp string")
    for fn in (co.assign_grouped, co.assign_balanced):
        out = fn(df, "label", "grp", 6)
        assert out.count() == df.count()
        assert out.groupBy("label", "grp").agg(F.countDistinct("period").alias("n")).where("n > 1").count() == 0


def test_balanced_order_with_large_groups(spark):
    sizes = {"a": 5000, "b": 2000, "c": 1500, "d": 1025, "e": 1024, "f": 3, "g": 3, "h": 1}
    df = spark.createDataFrame([(0, g) for g, n in sizes.items() for _ in range(n)], "label int, grp string")
    got = {r["grp"]: r["period"] for r in co.assign_balanced(df, "label", "grp", 3).distinct().collect()}
    assert [got[g] for g in "abcde"] == [1, 2, 3, 3, 2] and got["h"] == 2


def test_ramp_quota_keeps_every_row():
    q = co.ramp_quota(1000, 500)
    assert sum(m + b for _, m, b in q) == 1000 and q[0][1] < q[-1][1]
    assert sum(m for _, m, _ in co.ramp_quota(100, 3)) == 3


def test_sample_beyond_the_window_limit(spark):
    df = spark.range(5000).select(F.col("id"), F.lit(1).alias("period"), F.lit(0).alias("label"))
    assert co.sample_by_period(df, 1500, "id").count() == 1500 and co.sample_by_period(df, 10, "id").count() == 10


def test_sample_plan_limits_before_the_shuffle(spark):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("period"), (F.col("id") % 3).alias("label"))
    plan = co.sample_by_period(df, 5, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_tier_order_and_sizes(spark):
    s = spark.createDataFrame([(1, "a", "m1", 5, "x"), (2, "b", "m2", 5, "x"), (3, "c", "m3", 5, "x"), (4, "d", "m4", 6, "y")], "sample_id int, sha256 string, md5 string, size bigint, f1 string")
    sha = spark.createDataFrame([("a", 5), ("b", 9)], "digest string, size bigint")
    md5 = spark.createDataFrame([("m1", None), ("m2", None)], "digest string, size bigint")
    fz = spark.createDataFrame([("f1", "x", None, "fam")], "hash_type string, value string, size bigint, name string")
    got = {r["sample_id"]: (r["source"], r["name"]) for r in mt.match_tiered(s, sha, md5, fz, ["f1"]).collect()}
    assert got == {1: ("sha256_db", "KnownMalware"), 2: ("md5_db", "KnownMalware"), 3: ("fuzzy_db", "fam")}


def test_bloom_on_and_off_agree(spark):
    s = spark.range(2000).select(F.col("id").alias("sample_id"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.lit(1).cast("bigint").alias("size"))
    sig = spark.range(0, 2000, 7).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit(None).cast("bigint").alias("size"))
    key, counts = "spark.sql.optimizer.runtime.bloomFilter.enabled", []
    before = spark.conf.get(key)
    try:
        for value in ("true", "false"):
            spark.conf.set(key, value)
            counts.append(mt.match_exact(s, sig, "sha256").count())
    finally:
        spark.conf.set(key, before)
    on, off = counts
    assert on == off == 286


def test_chunked_bytes_equal_whole(spark, monkeypatch):
    rng = np.random.default_rng(1)
    blob = bytes(rng.integers(0, 40, 300_000, dtype=np.uint8))
    df = spark.createDataFrame([(1, bytearray(blob)), (2, bytearray(b"")), (3, bytearray(b"abc"))], "sample_id int, content binary")
    a = np.frombuffer(blob, dtype=np.uint8)
    got = {r["byte"]: r["n"] for r in ct.byte_counts(df.where("sample_id = 1"), "sample_id", "content").collect()}
    assert got == {int(b): int(n) for b, n in zip(*np.unique(a, return_counts=True))}
    pairs = {(r["a"], r["b"]): r["n"] for r in ct.transitions(df.where("sample_id = 1"), "sample_id", "content").collect()}
    codes, n = np.unique(a[:-1].astype(int) * 256 + a[1:], return_counts=True)
    assert pairs == {(int(c) >> 8, int(c) & 255): int(k) for c, k in zip(codes, n)}
    e = {r["sample_id"]: r for r in ct.entropy(df, "sample_id", "content").collect()}
    p = np.bincount(a) / len(a)
    assert e[1]["whole"] == pytest.approx(-(p[p > 0] * np.log2(p[p > 0])).sum()) and e[2]["whole"] == 0 and e[3]["tail"] == 0
    blocks = ct.block_entropies(df, "sample_id", "content").groupBy("sample_id").count().collect()
    assert {r["sample_id"]: r["count"] for r in blocks} == {1: 300_000 // 1024, 2: 1, 3: 1}


def test_graph_with_cycle_loop_and_leaf(spark):
    e = spark.createDataFrame([("g", a, b) for a, b in [(1, 2), (2, 3), (3, 1), (3, 3), (3, 4), (4, 5)]], "graph string, src int, dst int")
    r = gr.graph_stats(e).first()
    assert (r["nodes"], r["edges"], r["self_loops"], r["back_edges"], r["max_out"], r["callees"]) == (5, 6, 1, 2, 3, 5)
    d = gr.graph_depth(e).first()
    assert d["max_depth"] == 4 and d["mean_depth"] == pytest.approx((4 + 3 + 2 + 1) / 4)
    assert gr.graph_depth(e, max_depth=2).first()["max_depth"] == 2


def test_overlap_with_equal_starts_and_containment(spark):
    rows = [("k", "a", 0, 10), ("k", "b", 10, 20), ("k", "c", 0, 5), ("q", "a", 0, 100), ("q", "b", 5, 6), ("q", "b", 50, 60), ("q", "c", 200, 300)]
    df = spark.createDataFrame(rows, "key string, view string, lo bigint, hi bigint")
    got = {(r["va"], r["vb"]): (r["keys"], r["isolated"]) for r in gr.overlaps(df, "key", ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): (1, False), ("a", "c"): (1, False), ("b", "c"): (0, True)}


def test_adaptive_views(spark):
    df = spark.createDataFrame([(1, {"a": [1.0], "b": [1.0]}), (2, {"a": [1.0]})], "id int, views map<string, array<double>>")
    views, rows = pj.adaptive_views(df, ["a", "b", "never"])
    assert views == ["a", "b"] and [r["id"] for r in rows.collect()] == [1]


def test_holm_stops_at_first_failure(spark):
    df = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.03), ("d", 0.5)], "name string, p_value double")
    got = {r["name"]: r["significant"] for r in st.holm(df).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}


@pytest.mark.parametrize("a,b,p", [(0, 0, 1.0), (1, 9, 0.021484375), (5, 5, 1.0)])
def test_mcnemar(spark, a, b, p):
    rows = [(True, False)] * a + [(False, True)] * b + [(True, True)]
    r = st.mcnemar(spark.createDataFrame(rows, "x boolean, y boolean"), "x", "y").first()
    assert r["p_value"] == pytest.approx(p) and (r["a_only"], r["b_only"]) == (a, b)


def test_bootstrap_is_repeatable_and_covers(spark):
    df = spark.range(40).select("id", (F.col("id") % 4 == 0).cast("double").alias("x"))
    one, two = (st.bootstrap_ci(df.repartition(n), "id", st.weighted_mean("x"), 300).first() for n in (1, 5))
    assert one["lo"] == pytest.approx(two["lo"]) and one["lo"] < 0.25 < one["hi"]


def test_wilcoxon_small(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "x double, y double")
    assert st.wilcoxon(df, "x", "y").first()["p_value"] == 1.0


def test_ensemble_training_resumes(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 2), [float(v) for v in rng.normal(i % 2, 0.6, 4)] if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "sample_id int, y int, V1 array<double>").withColumn("V2", F.lit(None).cast("array<double>"))
    members = {"svm": ("linear", "V1"), "gone": ("forest", "V2")}
    path = str(tmp_path / "models")
    first = mo.train_ensemble(df, members, path)
    again = mo.train_ensemble(df, members, path)
    assert set(first) == set(again) == {"svm"} and again["svm"].stages[0].uid == first["svm"].stages[0].uid
    ex.register_scorer("const", lambda m: np.full(len(m), 0.25), "V1")
    got = mo.score_all(df, again, members, ["sample_id", "y"]).collect()
    mo._scorers.clear()
    assert {tuple(r["statuses"]) for r in got} == {("ok", "unavailable", "ok"), ("skipped", "unavailable", "skipped")}
    assert all(r["scores"][0] is None and r["scores"][2] is None for r in got if r["sample_id"] % 5 == 0)
    hit = [(r["scores"][0] > 0.5) == (r["y"] == 1) for r in got if r["sample_id"] % 5]
    assert np.mean(hit) > 0.8


def test_section_table_function(spark):
    from tests.test_sources import header
    ex.register_functions(spark)
    spark.createDataFrame([(1, bytearray(header(n=2)))], "id int, content binary").createOrReplaceTempView("bins")
    got = spark.sql("SELECT id, s.ord, s.name, s.raw_size FROM bins, LATERAL explode_sections(content) s").collect()
    assert [(r["ord"], r["name"], r["raw_size"]) for r in got] == [(0, ".text", 16), (1, ".text", 16)]


def _feed(path, frames):
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(path)


def test_stream_drops_and_counts_late_rows(spark, tmp_path):
    path = str(tmp_path / "ev")
    mk = lambda rows: spark.createDataFrame(rows, "id int, t string").select("id", F.to_timestamp("t").alias("ts"))
    _feed(path, [mk([(1, "2024-01-01 01:00:00"), (2, "2024-01-05 01:00:00")]), mk([(4, "2024-01-05 03:00:00")]), mk([(3, "2024-01-01 02:00:00"), (5, "2024-01-09 00:00:00")])])
    s = sr.stream_samples(spark, path, "id int, ts timestamp", files_per_batch=1)
    s = sr.with_event_time(s, "ts", "1 day").withColumn("v", F.col("id").cast("double"))
    rows, progress = sr.run_available(sr.stream_stats(s, "ts", "v", "1 day"))
    got = {str(r["start"])[:10]: r["n"] for r in rows.collect()}
    assert got == {"2024-01-01": 1, "2024-01-05": 2} and sum(p["dropped"] for p in progress) == 1


def test_stream_dedup_across_batches(spark, tmp_path):
    path = str(tmp_path / "dd")
    mk = lambda rows: spark.createDataFrame(rows, "digest string, t string").select("digest", F.to_timestamp("t").alias("ts"))
    _feed(path, [mk([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:01:00")]), mk([("a", "2024-01-01 00:02:00"), ("c", "2024-01-01 00:03:00")])])
    s = sr.with_event_time(sr.stream_samples(spark, path, "digest string, ts timestamp", files_per_batch=1), "ts", "1 hour")
    rows, _ = sr.run_available(sr.stream_dedup(s, "digest"))
    assert sorted(r["digest"] for r in rows.collect()) == ["a", "b", "c"]


def test_stream_detect_keeps_state_and_freezes_in_drift(spark, tmp_path):
    path = str(tmp_path / "z")
    rows = [("x", f"{i:03d}", z) for i, z in enumerate([0.1, 0.2, 5.0, 5.0, 0.0, 0.0, 0.0])]
    mk = lambda r: spark.createDataFrame(r, "level string, period string, z double")
    _feed(path, [mk(rows[:3]), mk(rows[3:5]), mk(rows[5:])])
    s = sr.stream_samples(spark, path, "level string, period string, z double", files_per_batch=1)
    got = sr.run_available(sr.stream_detect(s, "level", "period", "z", 1.0, limit=3.0))[0].orderBy("period").collect()
    c, want, mu, n = 0.0, [], 0.0, 0
    for _, _, z in rows:
        c = max(0.0, c + max(z, 0) - 1.0)
        if c <= 3.0:
            mu = z if n == 0 else 0.9 * mu + 0.1 * z
            n += 1
        want.append((c, mu, c > 3.0))
    assert [(pytest.approx(r["cusum"]), pytest.approx(r["ema"]), r["in_drift"]) for r in got] == want


def test_append_windows_close_and_leave_the_state(spark, tmp_path):
    path = str(tmp_path / "days")
    for lo in (1, 11, 21):
        rows = spark.range(lo * 10, (lo + 10) * 10).select((F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval(F.floor(F.col("id") / 10).cast("int") - 1)).alias("ts"), F.col("id").cast("double").alias("v"))
        _feed(path, [rows])
    s, close = sr.with_close(sr.stream_samples(spark, path, "ts timestamp, v double", files_per_batch=1), "ts", "1 day")
    rows, progress = sr.run_closed(sr.stream_stats(s, "ts", "v", "1 day"), close)
    got = {str(r["start"])[:10]: (r["n"], r["mean"]) for r in rows.collect()}
    assert got == {f"2024-01-{k:02d}": (10, k * 10 + 4.5) for k in range(1, 31)}
    assert max(p["state_rows"] for p in progress) > 0 and progress[-1]["state_rows"] == 0


MONITOR = "level string, at timestamp, z double, gain double, d double"


def _monitor_rows(spark):
    import datetime
    import random
    rnd = random.Random(5)
    day = datetime.datetime(2024, 1, 1)
    return [(level, day + datetime.timedelta(days=k), rnd.choice([-1.0, 0.2, 0.4, 3.0]), rnd.random(), rnd.random()) for level in "abc" for k in range(25)]


def test_stream_monitor_equals_batch_on_shuffled_files(spark, tmp_path):
    import random
    rows = _monitor_rows(spark)
    path = str(tmp_path / "mon")
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    _feed(path, [spark.createDataFrame(mixed[k::5], MONITOR) for k in range(5)])
    s, close = sr.with_close(sr.stream_samples(spark, path, MONITOR, files_per_batch=1), "at", "30 days")
    args = ("level", "at", "z", "gain", "d", 0.5, 1.0, 4)
    got, progress = sr.with_state_store(spark, sr.run_closed, sr.stream_monitor(s, *args), close)
    want = sr.monitor(spark.createDataFrame(rows, MONITOR), *args)
    order = lambda df: [tuple(r) for r in df.orderBy("level", "at").collect()]
    assert order(got) == order(want) and len(rows) == got.count()
    assert progress[-1]["state_rows"] == 0


def test_monitor_freezes_its_baseline_in_drift():
    m = sr.Monitor(k=0.0, limit=1.0, window=2)
    got = [m.add(*r) for r in [(0.5, 1.0, 10.0), (0.9, 1.0, 20.0), (1.0, 0.5, 30.0), (2.0, 0.0, 99.0), (0.5, 0.0, 98.0), (-5.0, 0.0, 97.0)]]
    assert [g[4] for g in got] == [False, False, False, True, True, True]
    assert got[2][2] == 25.0 and got[3][2] == got[5][2] == 25.0  # the last two clean rows; none of the drift
    assert [g[0] for g in got] == [0.5, 0.9, 1.0, 2.0, 2.5, 2.5] and got[-1][1] == 2.5
    assert len(m.ring) == 2


def test_route_late_keeps_every_row(spark, tmp_path):
    path = str(tmp_path / "late")
    mk = lambda rows: spark.createDataFrame(rows, "id int, t string").select("id", F.to_timestamp("t").alias("ts"))
    _feed(path, [mk([(1, "2024-01-05 00:00:00")]), mk([(2, "2024-01-01 00:00:00"), (3, "2024-01-09 00:00:00"), (6, None)]), mk([(4, "2024-01-06 00:00:00"), (5, "2024-01-08 00:00:00")])])
    s = sr.stream_samples(spark, path, "id int, ts timestamp", files_per_batch=1)
    on_time, late = sr.route_late(s, "ts", "2 days")
    assert sorted(r["id"] for r in on_time.collect()) == [1, 3, 5]
    assert sorted((r["id"], r["batch"], str(r["watermark"])[:10]) for r in late.collect()) == [(2, 1, "2024-01-03"), (4, 2, "2024-01-07"), (6, 1, "2024-01-03")]


def test_bootstrap_draws_poisson_weights_by_counter():
    rng = np.random.default_rng(1)
    high, low = (rng.integers(0, 2**32, 3000, dtype=np.uint64).astype(np.uint32) for _ in range(2))
    w = st.draws(high, low, 200)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert (st.draws(high[5:9], low[5:9], 50) == w[5:9, :50]).all()
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.25


def test_bootstrap_sends_replicates_not_rows(spark):
    df = spark.range(50_000).select("id", (F.col("id") % 10).cast("double").alias("x")).repartition(4)
    sums = st.replicate_sums(df, "id", st.weighted_mean("x"), 100, 42)
    assert sums.count() == 100 and "Generate" not in sums._jdf.queryExecution().toString()
    got = st.bootstrap_ci(df, "id", st.weighted_mean("x"), 100).first()
    assert got["lo"] < 4.5 < got["hi"] and got["hi"] - got["lo"] < 0.08 and got["replicates"] == 100


def _plain_cycles(n, src, dst):
    reach = [[False] * n for _ in range(n)]
    for a, b in zip(src, dst):
        reach[a][b] = True
    for k in range(n):
        for i in range(n):
            for j in range(n):
                reach[i][j] |= reach[i][k] and reach[k][j]
    parts = {frozenset(w for w in range(n) if reach[v][w] and reach[w][v]) for v in range(n) if reach[v][v]}
    return sorted(map(len, parts))


def test_cycles_match_reachability():
    import random

    from quorate.operators import graph as gr
    rnd = random.Random(2)
    for _ in range(300):
        n = rnd.randrange(1, 9)
        ends = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(0, 2 * n))]
        s, d = [e[0] for e in ends], [e[1] for e in ends]
        assert sorted(gr.cycles(n, s, d)) == _plain_cycles(n, s, d)
    assert gr.cycles(50_000, list(range(50_000)), [*range(1, 50_000), 0]) == [50_000]
    assert gr.cycles(2, [0, 5, None or 1], [9, 0, 1]) == [1]


def test_flow_stats_of_odd_functions(spark):
    from quorate.operators import graph as gr
    rows = [("a", [(3, [[0, 1, 2, 1], [1, 2, 0, 1]]), (2, None), (None, [[], []])]), ("b", []), ("c", None), ("d", [(1, [[0]])])]
    df = spark.createDataFrame(rows, "hash string, acfg_list array<struct<block_number:int,block_edges:array<array<bigint>>>>")
    got = {r["hash"]: r.asDict() for r in gr.flow_stats(df).collect()}
    assert (got["a"]["blocks"], got["a"]["block_edges"], got["a"]["back_edges"], got["a"]["functions"], got["a"]["loops"], got["a"]["largest_loop"], got["a"]["looping"]) == (5, 4, 2, 3, 1, 3, 1)
    assert all(got[k]["functions"] == 0 and got[k]["edges_per_block"] == 0.0 and got[k]["loops"] == 0 for k in "bc") and got["d"]["blocks"] == 1


def test_graph_depth_of_more_roots_than_a_word(spark):
    from quorate.operators import graph as gr
    chain = [("g", i, i + 1) for i in range(150)] + [("g", 150, 0), ("h", 1, 2), ("h", 1, 3), ("h", 3, 4), ("k", 7, 7)]
    got = {r["graph"]: (r["max_depth"], r["mean_depth"]) for r in gr.graph_depth(spark.createDataFrame([(g, a, b) for g, a, b in chain[:70] + chain[151:]], "graph string, src bigint, dst bigint")).collect()}
    assert got["g"] == (70, sum(range(1, 71)) / 70) and got["h"] == (2, 1.5) and got["k"] == (0, 0.0)
    limited = gr.graph_depth(spark.createDataFrame(chain, "graph string, src bigint, dst bigint"), max_depth=4)
    assert {r["graph"]: r["max_depth"] for r in limited.collect()} == {"g": 4, "h": 2, "k": 0}


def test_graph_depth_of_many_callers_that_nobody_calls(spark, monkeypatch):
    from quorate import session
    from quorate.operators import graph as gr
    written, plain = [], session.reliable_table
    monkeypatch.setattr(session, "reliable_table", lambda df: written.append(plain(df)) or written[-1])
    edges = [("g", i, (i + 1) % 10) for i in range(10)] + [("g", 10 + r, (r + k) % 10) for r in range(600) for k in range(5)]
    edges += [("c", 1, 2), ("c", 2, None), ("c", 1, None), ("n", None, 1), ("n", 1, None), (None, 1, 2)]
    got = {r["graph"]: (r["max_depth"], round(r["mean_depth"], 6)) for r in gr.graph_depth(spark.createDataFrame(edges, "graph string, src bigint, dst bigint")).collect()}
    # a null callee is one node, a null caller or graph leads nowhere
    assert got == {"g": (9, round((600 * 6 + 10 * 9) / 610, 6)), "c": (1, 1.0), "n": (1, 0.5), None: (0, 0.0)}
    # rounds hold the ten callees of "g" once per block of callers, not every caller
    assert sum(df.count() for df in written) < 3 * len(edges)


def test_graph_depth_of_many_small_graphs(spark):
    from quorate.operators import graph as gr
    edges = [(g, i, i + 1) for g in range(60) for i in range(g % 3 + 11)]
    got = {r["graph"]: (r["max_depth"], r["mean_depth"]) for r in gr.graph_depth(spark.createDataFrame(edges, "graph int, src bigint, dst bigint"), max_depth=3).collect()}
    assert got == {g: (3, (1 + 2 + 3 * (n - 2)) / n) for g in range(60) for n in [g % 3 + 11]}


def test_arrow_table_functions_give_the_rows_of_the_lateral_ones(spark):
    from quorate.operators import extensions as ex
    ex.register_functions(spark)
    df = spark.createDataFrame([(1, "One two  three"), (2, None), (3, ""), (4, " x ")], "id int, t string")
    df.createOrReplaceTempView("words")
    lateral = spark.sql("SELECT cast(id AS string) AS key, t.pos, t.token FROM words, LATERAL explode_tokens(t) t").collect()
    whole = spark.sql("SELECT * FROM tokens_of(TABLE(SELECT id, t FROM words))").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, lateral)) and len(whole) == 4
    assert spark.sql("SELECT * FROM sections_of(TABLE(SELECT id, cast(t AS binary) FROM words))").collect() == []


def _plan_nodes(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _plan_nodes(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return [plan, *_plan_nodes(plan.plan())]
    return [plan] + [n for i in range(plan.children().size()) for n in _plan_nodes(plan.children().apply(i))]


def test_bloom_filter_prunes_the_signature_scan(spark, tmp_path):
    from quorate.operators import matching as mt
    digest = F.sha2(F.col("id").cast("string"), 256)
    spark.range(100_000).select(digest.alias("digest"), F.lit(None).cast("bigint").alias("size")).write.parquet(str(tmp_path / "sigs"))
    spark.range(5_000).select(F.col("id").alias("sample_id"), digest.alias("sha256"), F.lit(9).cast("bigint").alias("size"), (F.col("id") % 100).alias("part")).write.parquet(str(tmp_path / "new"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = mt.match_exact(spark.read.parquet(str(tmp_path / "new")).where("part = 7"), spark.read.parquet(str(tmp_path / "sigs")), "sha256")
        assert len(got.collect()) == 50
        filters = [n for n in _plan_nodes(got._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "FilterExec" and "might_contain" in n.toString()]
        assert filters, "no Bloom filter in the plan"
        assert 50 <= filters[0].metrics().apply("numOutputRows").value() < 5_000  # of 100,000 signatures
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_ablation_period_prefers_the_widest_gap_of_drift(spark):
    from quorate.operators import reports as rs
    det = spark.createDataFrame([(1, True, 0.9), (2, True, 0.5), (3, True, 0.5), (4, False, 2.0), (5, True, None)], "period int, drift_detected boolean, spectral_gap double")
    rows = spark.createDataFrame([(1, 10), (2, 60), (3, 60), (4, 60), (5, 60)], "period int, n bigint")
    assert tuple(rs.ablation_period(det, rows).first()) == (2, 0.5, True)
    assert tuple(rs.ablation_period(det, rows, min_rows=100).first()) == (5, None, False)


def test_pseudo_labels_by_the_models_of_each_period(spark):
    from quorate.operators import drift as dr
    rows = [(1, 1, [0.9, 0.8, 0.1]), (1, 0, [0.9, None, 0.1]), (2, 1, [0.9, 0.9, 0.9]), (3, 1, [0.2, 0.9, 0.9])]
    scores = spark.createDataFrame(rows, "period int, y int, scores array<double>")
    healthy = spark.createDataFrame([(1, [0, 1]), (2, [0]), (3, [1, 2])], "period int, healthy_models array<int>")
    got = {r["period"]: tuple(r)[1:] for r in dr.pseudo_by_period(scores, healthy, 3).collect()}
    assert got == {1: (2, 2, 1.0, 0.5), 2: (1, 0, 0.0, None), 3: (1, 1, 1.0, 1.0)}


def test_validate_vectors_periods_and_offsets(spark):
    from quorate.operators import corpus as co
    df = spark.createDataFrame([(1, 1, [0.0, 0.0]), (0, 2, [0.0]), (1, 2, None)], "label int, period int, v array<double>")
    offsets = spark.createDataFrame([(1, 0, 1), (2, 1, 5)], "period int, start bigint, count bigint")
    got = {r["check"]: (r["ok"], r["detail"]) for r in co.validate(df, "v", [1], [7], offsets).collect()}
    assert got["not_all_zero"] == (False, 3) and got["train_periods"] == (True, 1) and got["eval_periods"] == (False, 0) and got["offsets_total"] == (False, 6)
    assert set(got) - {r["check"] for r in co.validate(df).collect()} == {"train_periods", "eval_periods", "offsets_total"}


def test_manifest_names_what_differs(spark, tmp_path):
    from quorate.sources import sinks as sk
    df = spark.createDataFrame([(1, {"A": [1.0, 2.0]}), (1, {"A": [1.0], "B": [1.0]}), (2, {})], "period int, views map<string,array<double>>")
    got = [tuple(r) for r in sk.manifest_fields(df, {"A": 2, "B": 1, "C": 9}, [1], [3], {1: 2, 2: 4}).collect()]
    assert got == [("view_width", "A", "1,2"), ("view_width", "B", "1"), ("missing_view", "C", ""), ("train_period", "1", "2"), ("eval_period", "3", "0"), ("problem", "A", "1,2 instead of 2"), ("problem", "period 2", "1 rows instead of 4")]
    (tmp_path / "meta.json").write_bytes(b"abc")
    row = sk.source_checksums(spark, [str(tmp_path / "meta.json")]).first()
    assert row["bytes"] == 3 and row["sha256"].startswith("ba7816bf")


def test_neighbours_in_bounded_memory_and_ties_by_key(spark):
    import tracemalloc
    g = np.random.default_rng(5)
    pts, x = g.normal(size=(20_000, 16)), g.normal(size=(400, 16))
    pts[1000:3000] = pts[7]  # equal points: the first places win
    x[3] = pts[7]
    tracemalloc.start()
    at, d = mo.nearest(x, pts, (pts ** 2).sum(1), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000  # all distances of the batch would be 64 MB, each step of them once more
    assert at[3].tolist() == [7, 1000, 1001, 1002, 1003] and (d[3] == 0).all()
    for i in (0, 100, 399):
        own = np.sqrt(((pts - x[i]) ** 2).sum(1))
        assert at[i].tolist() == np.argsort(own, kind="stable")[:5].tolist()
    # of 12 equal training rows the five smallest keys vote: one of them has the label
    train = spark.createDataFrame([(n, [1.0, 2.0], int(n in (0, 9, 10, 11))) for n in reversed(range(12))], "sample_id bigint, vec array<double>, y int").repartition(3)
    test = spark.createDataFrame([(100, [1.0, 2.0])], "sample_id bigint, vec array<double>")
    assert mo.knn_classify(train, test, "sample_id").first()["probability"] == pytest.approx(0.2)


def test_neighbours_from_all_training_rows(spark):
    # more rows than the 50,000 that were once kept of them: every test row lies on one of its own label, with a row of the other label next to it
    train = spark.range(60_000).select(F.col("id").alias("sample_id"), F.array(F.col("id").cast("double")).alias("vec"), (F.col("id") % 2).cast("int").alias("y"))
    test = train.where("sample_id % 60 < 2").drop("y")
    got = mo.knn_classify(train, test, "sample_id").agg(F.count("*").alias("n"), F.sum((F.col("prediction") == F.col("sample_id") % 2).cast("int")).alias("right"), F.min(F.abs(F.col("probability") - 0.5)).alias("sure")).first()
    assert got["n"] == got["right"] == 2000 and got["sure"] > 0.499999


def test_neighbours_in_rounds(spark, monkeypatch):
    from quorate import session as se
    g = np.random.default_rng(8)
    width = 3
    vecs = g.integers(0, 4, size=(700, width)).astype(float)  # many equal vectors and equal distances
    vecs[350:] += g.normal(size=(350, width))
    vecs[20:30] = vecs[5]
    vecs[40:60, 1] = np.nan
    keys = [None if i % 50 == 0 else int(i // 2) for i in g.permutation(700)]  # repeated and missing keys
    y = [None if i % 31 == 0 else int(v) for i, v in enumerate(g.integers(0, 2, 700))]
    rows = [(k, [None if np.isnan(c) else float(c) for c in v], h) for k, v, h in zip(keys, vecs, y)] + [(3, None, 1)]
    tests = [(i, [float(c) for c in v]) for i, v in enumerate(g.integers(0, 4, size=(90, width)))] + [(None, [0.0, 1.0, 2.0]), (7, None)]
    train = spark.createDataFrame(rows, "sample_id int, vec array<double>, y int").repartition(5)
    test = spark.createDataFrame(tests, "sample_id int, vec array<double>").repartition(3)
    whole = sorted(mo.knn_classify(train, test, "sample_id").collect(), key=str)
    monkeypatch.setattr(mo, "BLOCK", 100 * 8 * width)
    monkeypatch.setattr(mo, "SORTED", 20 * 8 * width)
    monkeypatch.setattr(mo, "ROUND_ROWS", 16)
    sizes, written = [len(v) for v, _ in mo.training_blocks(train, "sample_id", "y", "vec", 5)], len(se._written)
    got = sorted(mo.knn_classify(train, test, "sample_id").collect(), key=str)
    assert len(sizes) >= 4 and max(sizes) < 300 and len(se._written) == written + 1  # of the rounds' tables the last one stays
    assert str(got) == str(whole) and len(got) == 91
    # plainly: by distance (not a number last), key (none last) and label; a group that shares all of these has one result
    for row in got:
        if row["sample_id"] is None:
            continue
        d = np.sqrt(((vecs - np.array(tests[row["sample_id"]][1])) ** 2).sum(1))
        near = sorted((np.inf if np.isnan(x) else x, k is None, k or 0, h == 1) for x, k, h in zip(d, keys, y))[:5]
        w = np.array([1 / (n[0] + 1e-8) for n in near])
        assert row["probability"] == pytest.approx((w * [n[3] for n in near]).sum() / w.sum())
        assert row["prediction"] == int(row["probability"] > 0.5)
    # without training rows there are no neighbours and no results; lengths must agree
    assert mo.knn_classify(train.where("false"), test, "sample_id").collect() == []
    with pytest.raises(ValueError, match="differ in length"):
        mo.knn_classify(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 1)], "sample_id int, vec array<double>, y int"), test, "sample_id")


def test_nearest_in_blocks_and_odd_numbers():
    def plain(x, pts, k):
        with np.errstate(all="ignore"):
            d = np.sqrt(((x[:, None] - pts[None]) ** 2).sum(2))
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        return at, np.take_along_axis(d, at, 1)

    g = np.random.default_rng(4)
    wild = g.normal(size=(2000, 4))
    for value in (np.nan, np.inf, -np.inf, 1e200):
        wild[g.random(wild.shape) < 0.02] = value
    near = 1e6 + 1e-3 * g.normal(size=(2000, 4))  # far from zero and close together
    for pts, x in ((wild, wild[:60] * 1.0), (near, near[:60] + 1e-4), (g.integers(0, 3, (2000, 4)).astype(float), g.integers(0, 3, (60, 4)).astype(float)), (wild[:3], wild[5:9])):
        at, d = plain(x, pts, 7)
        got = mo.nearest(x, pts, (pts ** 2).sum(1), 7)
        assert np.array_equal(got[0], at) and np.array_equal(got[1], d, equal_nan=True)
        far = np.empty((len(x), 0))
        for lo, hi in ((0, 2), (2, 900), (900, 900), (900, 2000)):  # the first block has fewer points than neighbours
            block = pts[lo:hi]
            if len(block):
                block = block[mo._first_of_equals(block, 7)]
                far = mo.nearest(x, block, (block ** 2).sum(1), 7, far)[1]
        assert np.array_equal(far, d, equal_nan=True)
    # of equal points and of those with a number missing the first ones stay, also where there are many
    few = np.array([[1.0, np.nan], [2.0, 2.0], [np.nan, 0.0], [2.0, 2.0], [0.0, 0.0]])
    assert mo._first_of_equals(few, 1).tolist() == [0, 1, 4] and mo._first_of_equals(np.repeat(few, 5000, axis=0), 2).tolist() == [0, 1, 5000, 5001, 20000, 20001]


def test_seeded_sample_is_the_ordered_prefix(spark):
    from quorate.functions.columns import seeded_order
    df = spark.range(5000).withColumnRenamed("id", "k")
    whole = [r["k"] for r in df.orderBy(seeded_order(F.col("k"), 42), "k").collect()]
    for n in (1, 700, 5000, 9000):
        assert [r["k"] for r in mo.seeded_sample(df, "k", n, 42).collect()] == whole[:n]


def test_equal_functions_are_walked_once(spark, monkeypatch):
    calls, walk = [], gr.cycles
    monkeypatch.setattr(gr, "cycles", lambda n, s, d: calls.append(n) or walk(n, s, d))
    frame = spark.createDataFrame([], "block_number int, block_edges array<array<bigint>>")
    rows = [(2, [[0, 1], [1, 0]]), (3, [[0], [1]]), (2, [[0, 1], [1, 0]]), (2, None), (1, [[0], [0]]), (2, [[0], None]), (None, []), (2, [[0, 1, 1], [1, 0, 1]])] * 50
    got = []

    class Frame:
        schema = frame.schema

        def mapInArrow(self, run, _):
            import pyarrow as pa
            t = pa.table({"block_number": pa.array([r[0] for r in rows], pa.int32()), "block_edges": pa.array([r[1] for r in rows], pa.list_(pa.list_(pa.int64())))})
            for b in run([t.to_batches()[0].slice(1)]):
                got.extend(zip(b.column(2).to_pylist(), b.column(3).to_pylist()))

    gr.loops_of(Frame())
    want = [[len(f), max(f, default=0)] for f in (walk(n or 0, *(e if e and None not in e else ([], []))) for n, e in rows[1:])]
    assert [list(g) for g in got] == want and len(calls) <= 6


def test_tokens_of_a_key_move_as_one_set(spark):
    df = spark.createDataFrame([(1, "B"), (1, "a"), (1, "b"), (1, ""), (1, None), (2, "")], "k int, t string").repartition(3)
    out = ct.set_fingerprint(df, "k", "t")
    import hashlib
    assert [tuple(r) for r in out.collect()] == [(1, hashlib.md5(b"a,b").hexdigest())]
    assert ct.set_fingerprint(df, "k", "t")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_pairs_of_long_and_repeated_keys_meet_without_a_table_of_counts(spark):
    rng = np.random.default_rng(5)
    rows = [(1, rng.integers(0, 256, 200_000, dtype=np.uint8).tobytes()), (2, b"abab"), (2, b"abc"), (None, b"xyx"), (None, b"xy"), (3, b""), (4, None), (5, b"q"), (2, b"zz")]
    df = spark.createDataFrame(rows, "sample_id bigint, content binary").repartition(3)
    want = {}
    for k, c in rows:
        for a, b in zip(c or b"", (c or b"")[1:]):
            want[k, a, b] = want.get((k, a, b), 0) + 1
    pairs = ct.transitions(df, "sample_id", "content")
    assert {(r["sample_id"], r["a"], r["b"]): r["n"] for r in pairs.collect()} == want and pairs.count() == len(want)
    # counts are never grouped in memory
    assert "HashAggregate" not in pairs._jdf.queryExecution().executedPlan().toString()
    per, cells = {}, {}
    for (k, a, b), n in want.items():
        per.setdefault((k, a), []).append(n)
        cells[k, a ^ b] = cells.get((k, a ^ b), 0) + n
    entropies = {(r["sample_id"], r["a"]): r["h"] for r in ct.row_entropy(df, "sample_id", "content").collect()}
    assert entropies == pytest.approx({k: -sum(n / sum(v) * np.log2(n / sum(v)) for n in v) for k, v in per.items()}, abs=1e-9)
    frames = [ct.byte_counts(df, "sample_id", "content"), ct.byte_histogram(df, "sample_id", "content"), ct.entropy(df, "sample_id", "content", 3)]
    assert not any("HashAggregate" in f._jdf.queryExecution().executedPlan().toString() for f in frames)
    assert {(r["sample_id"], r["byte"]): r["n"] for r in frames[0].collect() if r["sample_id"] == 2} == {(2, 97): 3, (2, 98): 3, (2, 99): 1, (2, 122): 2}
    assert {r["byte"]: r["share"] for r in frames[1].where("sample_id is null").collect()} == {120: 0.6, 121: 0.4}
    whole = {r["sample_id"]: (r["whole"], r["head"], r["tail"]) for r in frames[2].collect()}
    h = lambda *n: -sum(x / sum(n) * np.log2(x / sum(n)) for x in n)
    assert set(whole) == {None, 1, 2, 3, 4, 5} and whole[3] == whole[4] == whole[5] == (0.0, 0.0, 0.0)
    assert whole[2] == pytest.approx((h(3, 3, 1, 2), h(3, 2, 1, 2), 0.0)) and whole[None] == pytest.approx((h(3, 2), h(3, 2), 0.0))
    shares = {(r["sample_id"], r["cell"]): r["share"] for r in ct.folded_bigrams(df, "sample_id", "content").collect()}
    assert shares == pytest.approx({(k, c): n / sum(m for (o, _), m in cells.items() if o == k) for (k, c), n in cells.items()})


def test_pair_counts_hold_one_array_per_batch():
    import pyarrow as pa
    parts = [b"", b"a", b"abab", bytes(range(256)) * 40, None]
    got = ct._pair_counts.func(pa.array(parts, pa.binary()))
    assert isinstance(got, pa.StructArray)
    for b, row in zip(parts, got.to_pylist()):
        a = np.frombuffer(b or b"", dtype=np.uint8).astype(int)
        codes, n = np.unique(a[:-1] * 256 + a[1:], return_counts=True)
        assert row == {"code": codes.tolist(), "n": n.tolist()}
