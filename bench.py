"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from itemforge import build_session
from itemforge.plans.catalog import CATALOG

HEADLINE = ("record_items", "order_items", "identity_items", "column_profile", "long_grouped", "dataset_guides", "clean_text", "html_documents",
            "document_chunks", "chunk_items", "structured_items", "content_matches", "eval_coverage", "entity_year_matches", "eval_items",
            "shape_verdicts", "item_issues", "grounding_scores", "score_report", "run_compare", "answer_overlap_f1", "row_ordinals")
ROWS = {"record_items": "customer", "identity_items": "customer", "eval_items": "customer", "column_profile": "lineitem", "row_ordinals": "lineitem",
        "order_items": "orders", "long_grouped": "orders", "dataset_guides": "orders", "entity_year_matches": "orders", "item_issues": "orders",
        "html_documents": "pages", "structured_items": "events", "grounding_scores": "conversations", "score_report": "conversations",
        "answer_overlap_f1": "conversations", "run_compare": "labels"}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds, rates = {}, {}
    for name in HEADLINE:
        source = ROWS.get(name, "documents")
        rows = spark.read.parquet(f"{sf}/{source}.parquet").count()
        start = time.perf_counter()
        CATALOG[name].build(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        rates[name] = round(rows / seconds[name])
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "rows_per_sec": rates, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
