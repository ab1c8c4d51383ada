"""Times of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lodestrata import catalog

HEADLINE = ["tf", "df", "doc_lengths", "dictionary", "bm25_top10", "bm25_skipping", "tfidf_top10", "bool_paren", "bool_then_bm25", "kw_technique", "technique_cve", "bm25_expanded", "topic_vocab", "tactic_topic_heatmap", "lsa_weights", "vector_top10", "lsa_top10"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
             .config("spark.sql.codegen.hugeMethodLimit", "8000").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    began, times = time.time(), {}
    catalog._engine(spark, sf)
    times["build_index"] = round(time.time() - began, 3)
    began = time.time()
    catalog._blocked(spark, sf).blocks.lists.count()
    times["build_blocks"] = round(time.time() - began, 3)
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
