"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR  directory of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    cores of the local session (default 8)
BENCH_QUERIES comma-separated names or prefixes, or "all"
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import quillcheck.plans.all  # noqa: E402,F401
from quillcheck.plans.registry import PLANS  # noqa: E402
from quillcheck.session import local_session  # noqa: E402

HEADLINE = [
    "q08_in_subquery", "q15_inner_join", "q16_multi_join", "q18_self_join", "q21_distinct_aggregates", "q26_argmax", "q31_theta_join",
    "c04_primary_keys", "c05_foreign_keys", "c07_humanised_names",
    "v03_database_index", "v05_token_sort_score", "v06_nearest_vector", "v08_ranked_candidates", "v13_calibration",
    "l12_linked_questions", "p02_table_text_with_keys", "t03_lower_outside_quotes", "t10_mask_literals", "t16_typed_comparisons",
    "a06_hardness", "a17_exact_match", "e01_bag_equal", "e05_equal_up_to_columns", "e07_ordered_equal", "e09_suite_verdicts",
    "m05_joint", "m06_partial_rates", "m13_duplicates", "m14_running_mean", "r09_gap_choice", "r12_final_pick",
    "d04_decoded_columns", "d13_mixed_groups", "s04_sessions",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    asked = os.environ.get("BENCH_QUERIES")
    if asked == "all":
        names = sorted(PLANS)
    elif asked:
        names = [n for n in sorted(PLANS) if any(n.startswith(a) for a in asked.split(","))]
    else:
        names = HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{root}/lineitem.parquet").count()
    times = {}
    for name in names:
        began = time.perf_counter()
        PLANS[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
