"""Times the headline queries at $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "presence_pruned",
    "presence_transactions",
    "presence_dedup",
    "folds_stratified",
    "metric_auc",
    "metric_macro_auc",
    "stability_toi",
    "itemsets_brands",
    "itemsets_words",
    "rules_all",
    "rules_subtracted",
    "groups_suggested",
    "cluster_labels",
    "importance_spread",
    "annotation_vote",
    "forest_report",
    "job_forest_markers",
    "job_continuous_net",
    "job_binary_net",
    "job_multiclass_net",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from markerloom.catalog import queries
    from markerloom.session import local_session

    spark = local_session(cores, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    known = queries()
    # Start-up and the first compilation belong to no query.
    known["presence_prevalence"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
