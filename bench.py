"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import importlib.util
import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["cosine_topk", "cosine_topk_batch", "ivf_topk", "ivf_stored", "bm25_topk", "bm25_stored", "rank_fusion", "pattern_matches", "session_coverage", "hybrid_retrieval", "index_counts", "chunk_documents", "file_changes", "postings_upkeep", "rolling_samples", "working_sets", "op1_chat", "op2_toxicity", "op3_minhash", "op4_bpe", "op5_token_files", "op6_suffix_dedup", "op7_mixing", "op8_html", "op9_exact_dedup", "op10_fingerprints", "op11_filter_audit", "op12_runs", "op13_urls", "pipeline"]


def main() -> None:
    spec = importlib.util.spec_from_file_location("entry", os.path.join(os.path.dirname(os.path.abspath(__file__)), "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = entry.queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()
    # the same work in every round, so that rounds on other machines compare
    began = time.time()
    spark.range(200_000_000).selectExpr("sum(xxhash64(id) % 1000)").collect()
    yardstick = round(time.time() - began, 3)
    for name in HEADLINE:
        if name in queries:
            began = time.time()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "yardstick": yardstick, "sf": os.path.basename(SF_DIR.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
