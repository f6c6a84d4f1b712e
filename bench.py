"""Headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = (
    "bm25_topk", "term_statistics", "identifier_postings", "quality_dispositions", "exact_duplicates", "near_duplicate_pairs",
    "near_duplicate_groups", "dense_topk", "rrf_fusion", "rank_blend", "span_union", "span_coverage", "greedy_packing",
    "mmr_selection", "retrieval_metrics", "bootstrap_intervals", "journal_sequences", "event_sessions", "page_links",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from stratum.plans import catalog
    from stratum.runtime import build_session

    spark = build_session(
        f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
        spark__sql__files__maxPartitionBytes="4m",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {}
    for name in HEADLINES:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
