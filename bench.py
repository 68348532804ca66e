"""Time the headline queries: ``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` cores.  Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "user_stats", "user_rating_distribution", "loo_user_stats", "dedupe_last", "item_similarity", "topk_similar_items",
    "cf_score_test", "cf_out_of_fold", "bias_proxy_train", "profile_scalars", "checkin_ratios", "features_stacked_test",
    "features_rich_train", "rmse_ladder", "fold_assignment", "boosted_contract",
]


def main() -> None:
    from starloom.session import build_session, temporary_tables
    from workload import queries

    queries.COMPARABLE = False
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first query would pay for the start of the JVM's compiler and of the readers.
    queries.QUERIES["global_mean"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        with temporary_tables(spark):
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
             "queries": seconds, "note": "without the rounding that the SQL comparison adds", "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}
        )
    )


if __name__ == "__main__":
    main()
