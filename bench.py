"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "clean_text", "word_count", "detect_language", "extract_entities", "keyword_category",
    "normalize_label_intent", "document_text", "analyzed_pairs", "value_shares", "basic_stats",
    "word_frequencies", "dedupe_keep_first", "preprocess_records", "last_user_message", "pair_turns",
    "export_conversations", "group_pairs", "conversation_analytics", "avg_response_time",
    "upsert_by_session", "next_steps", "missing_stats", "describe_numeric", "correlation_matrix",
    "iqr_bounds", "profile_frame", "histogram", "kde_curve", "daily_counts", "confusion_matrix",
    "class_report", "chunk_documents", "vector_topk", "vector_topk_filtered", "build_prompts",
    "tfidf_weights", "name_clusters", "score_intents", "read_grouped_json", "stream_hourly",
    "stream_last_state", "stream_sessions", "ann_topk", "rf_classifier", "cluster_texts", "pca_features",
]


def main() -> None:
    from supportlens.plans import catalog
    from supportlens.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "supportlens-bench",
        spark_sql_shuffle_partitions=cpus,
        spark_driver_memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        frame = catalog.QUERIES[name](spark, sf_dir)
        frame.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
