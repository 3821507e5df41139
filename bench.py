"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from siftwell.catalog import QUERIES, graph_queries, standins
from siftwell.operators import graph, lexical
from siftwell.runtime import session

HEADLINE = [
    "scan_chunks", "chunk_text", "tokenize", "bm25_search", "knn_exact", "semantic_links", "hybrid_rrf", "search",
    "project_summary", "debt_summary", "engineer_scores", "compare_baseline", "trend_direction", "coupling", "contributors",
    "evolution_phases", "blame_latest", "build_edges", "reachability", "cycles", "lca_score", "authorship",
    "doc_sections", "extract_entities", "changed_files", "detect_file_moves", "incremental_index", "debounce", "apply_changes",
]


def apart(spark, folder: str) -> dict[str, float]:
    """Index building and searching by themselves, the same batch of queries against a layout that is already stored; and two levels of calls from all classes,
    as the registered trace, from every entity, has some ten million rows at this size."""
    times, start = {}, time.time()
    blocks = lexical.bm25_blocks(lexical.bm25_index(standins.corpus(spark, folder)))
    times["bm25_index_alone"] = round(time.time() - start, 3)
    start = time.time()
    lexical.bm25_search(blocks, standins.search_queries(spark, folder), 10).write.format("noop").mode("overwrite").save()
    times["bm25_search_alone"] = round(time.time() - start, 3)
    start = time.time()
    classes = graph_queries.entities(spark, folder).filter("kind = 'class'").selectExpr("id AS start")
    graph.trace_flow(graph_queries.call_edges(spark, folder), classes, 2).write.format("noop").mode("overwrite").save()
    times["trace_flow_of_classes"] = round(time.time() - start, 3)
    return times


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    if not os.environ.get("BENCH_QUERIES"):
        times |= apart(spark, folder)
    out = {"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}
    print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
