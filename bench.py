"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores.  Every query is run
once to warm the JVM and once timed, writing all result rows to a null sink.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "site_link_report", "u03_normalize_url", "u10_similar_url_key", "h01_extract_links",
    "h03_link_report", "h05_extract_metadata", "h07_page_blocks", "h08_main_content",
    "h09_site_boilerplate", "h12_markdown_with_fallback", "c01_filter_links", "c06_robots_allowed",
    "c07_sitemap_entries", "c10_claim_urls", "c11_crawl_corpus", "c13_reconcile_redirects",
    "c17_fetcher_verdict", "m01_site_map", "m06_rank_results", "j02_crawl_status", "j04_result_page",
    "j06_admit_per_crawl", "j17_done_jobs", "j22_job_latency", "k01_admit_memories",
    "k02_replace_memory", "k08_render_notes", "k10_build_exchanges", "k13_search_exchanges",
    "k13_search_many", "p03_items_to_lines", "p04_items_to_tables", "p06_strip_repeated_lines",
    "p07_heading_levels", "p14_paragraphs", "t03_rate_limit", "t04_lease_audit_batch",
)


def main() -> None:
    from netloom.session import local_session
    from netloom.suite.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session(cpus, "netloom-bench")
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in only:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_warm_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
