"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.

Each query is executed in full through the ``noop`` sink (every row is
produced, nothing is collected to the driver), after one untimed warm-up
query, and with Spark's cache cleared before each, so that no query reads what
another one left.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from contentfit.plans.catalog import QUERIES  # noqa: E402
from contentfit.session import get_spark  # noqa: E402

HEADLINE = (
    "page_sections",
    "page_sections_tree",
    "section_counts",
    "title_fit_full",
    "lexical_fit",
    "best_section_per_query",
    "section_intent_fit",
    "section_intent_fit_all",
    "priority_terms",
    "query_intents",
    "dense_fit",
    "micro_edit",
    "improve_by_rules",
    "first_improving_attempt",
    "report_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    spark = get_spark("contentfit-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g"})
    times = {}
    QUERIES["page_titles"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        spark.catalog.clearCache()
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
