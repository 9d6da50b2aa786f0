"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loomsift.catalog.queries import all_queries  # noqa: E402
from loomsift.functions.session import local_session  # noqa: E402

HEADLINE = [
    "extract_text",
    "extract_links",
    "score_content",
    "page_quality",
    "junk_gate",
    "curation_funnel",
    "document_funnel",
    "training_rows",
    "render_chat_llama",
    "refilter_dataset",
    "crawl_frontier",
    "crawl_and_curate",
    "curate_code",
    "chunk_code",
    "endpoint_health",
    "request_gap_audit",
    "domain_counts",
    "observed_subdomains",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, "loomsift-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    # one untimed query starts the executors and compiles the hot paths
    registered["page_quality"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    rows = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("pages", "documents", "events")}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
                "warmed_up": True,
                "rows": rows,
                "pages_per_minute_extract": round(rows["pages"] / seconds["extract_text"] * 60),
                "pages_per_minute_curate": round(rows["pages"] / seconds["training_rows"] * 60),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
