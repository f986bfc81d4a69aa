"""Times the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "site_best_page", "url_canonical", "url_dedupe", "clean_text", "name_normalize", "slug_unique", "validate_errors",
    "confidence_rubric", "completeness", "match_existing", "upsert", "renumber", "remap_ids", "brand_junction", "similar_names",
    "duplicate_pairs", "duplicate_groups", "golden_majority", "rank_candidates", "counters", "histogram_stats", "queue_size",
    "elements_count", "page_text", "cards", "tables_registry", "sections", "discovery", "evidence_page", "passages_found",
    "search_index", "search_many", "export_rows", "sitemap_parts", "stream_counters",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    only = sys.argv[1:]

    from tradebook.plans.catalog import QUERIES
    from tradebook.session import local_session

    spark = local_session(cpus, int(cpus), "tradebook-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times: dict[str, float] = {}
    for name in only or HEADLINES:
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begun, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_wall", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
