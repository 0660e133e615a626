"""Time the headline queries: one JSON line on standard output.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (threads), BENCH_RUNS (runs per query, default 2;
the last run counts, so the JVM is warm). ``duckdb`` in the output holds the seconds of each query's SQL
counterpart in DuckDB on the same tables and threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from lexloom.registry import all_oracles, all_queries

HEADLINE = [
    "law_at_date", "resolve_citations", "decisions_citing", "postings", "bm25_search", "phrase", "search_all_weighted",
    "federated_topk", "cited_articles", "parse_refs", "by_rg", "mine_emails", "html_to_text", "expand_queries",
    "enumerate_pages", "topk_per_court", "merge_directory", "search_directory", "upsert", "apply_changes",
    "usage_by_hour_tool",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("lexloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    seconds = {}
    for name in HEADLINE:
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
        seconds[name] = round(spent, 3)
        print(f"{name}: {spent:.2f}s", file=sys.stderr)
    con, oracles, reference = duckdb.connect(), all_oracles(), {}
    con.sql(f"SET threads = {int(cpus)}")
    for file in sorted(os.listdir(folder)):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    for name in HEADLINE:
        start = time.perf_counter()
        con.sql(oracles[name]).fetchall()
        reference[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "duckdb": reference, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
