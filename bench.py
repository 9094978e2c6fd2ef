"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import time

from checks import QUERIES
from perilscope.session import session

HEADLINE = [
    "area_risk_summary", "area_recommendation", "attach_detail", "kpis",
    "theme_crosstab", "cause_severity_share", "severity_share_by_group",
    "topn_cause_text", "cause_share_top3", "top20_causes", "null_counts", "describe",
    "clean_strings", "coerce_numeric", "duration_months", "clock_hour_period", "era_date",
    "month_to_quarter", "rule_cascade", "rule_full_cascade", "rule_first_contains",
    "rule_priority", "keyword_theme", "row_product_lookup", "master_join",
    "personalised_output", "union_years", "mode_profile", "yoy_trend", "subcause_forecast",
    "theme_forecast", "ordinal_encode", "stratified_split", "classification_report",
    "forest_importance", "rule_cascade_148", "pipeline_rows", "describe_in_ranges",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    QUERIES["area_risk_summary"](spark, folder).collect()  # warm the JVM
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
