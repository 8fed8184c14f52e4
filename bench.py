"""Headline queries at one scale.  Prints a single JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) pick data and cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quorate.operators import scores as sc  # noqa: E402
from quorate.plans.bindings import scores  # noqa: E402
from quorate.plans.registry import load  # noqa: E402
from quorate.session import build_session  # noqa: E402

HEADLINE = ["agg_06_period_scores", "agg_10_auc_by_model_period", "agg_13_disagreement", "drf_08_score_samples", "drf_05_detect", "drf_09_conformal", "drf_12_uncertainty",
            "drf_14_mask_variance", "jon_01_match_exact", "jon_02_match_with_bloom", "jon_03_match_tiered", "agg_21_byte_histogram", "agg_22_entropy", "agg_23_block_entropy",
            "agg_24_transitions", "agg_25_string_stats", "agg_26_hashed_signed", "agg_30_vocab", "win_01_assign_periods", "win_04_assign_grouped", "win_05_assign_balanced",
            "win_07_sample_by_period", "agg_01_dedup_content", "agg_32_anomaly_score", "jon_09_locate", "jon_10_isolation", "jon_11_knn", "prj_15_validate_header", "prj_18_term_flags"]


def disagreement_33(spark, d):
    """The disagreement matrix of 33 models: the eight score columns repeated with small fixed offsets."""
    wide = scores(spark, d).withColumn("scores", F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.transform("scores", lambda s: s * (F.lit(1.0) - i * 0.01)))), 1, 33))
    return sc.disagreement(wide, 33, ["period"])


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("quorate-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("OFF")
    registry = load()
    jobs = {name: registry[name][0] for name in HEADLINE}
    jobs["agg_13_disagreement_33"] = disagreement_33
    only = sys.argv[1:]
    times = {}
    spark.range(1000).write.format("noop").mode("overwrite").save()
    for name, fn in jobs.items():
        if only and not any(o in name for o in only):
            continue
        start = time.perf_counter()
        fn(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf else None}))


if __name__ == "__main__":
    main()
