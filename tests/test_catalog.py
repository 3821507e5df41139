"""A spread of registered queries against their SQL at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import rows_of

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "bm25_search", "knn_exact", "hybrid_rrf", "rank_features", "project_summary", "debt_summary", "compare_baseline", "trend_direction",
    "evolution_phases", "blame_latest", "build_edges", "find_related", "cycles", "lca_score", "doc_sections", "policy_claims", "changed_files",
    "detect_file_moves", "incremental_index", "debounce", "watch_changes", "read_commits", "python_metrics", "write_vectors",
    "neighbours", "trace_flow", "semantic_links", "ann_search", "rrf_three_way", "evidence_hits", "stored_index_search", "strong_components",
    "chunk_paragraphs", "overlap_dedup", "parse_in_sql", "register_aggregate", "doc_code_edges", "timeline_events",
]
if os.environ.get("ALL_ORACLES"):  # every query with SQL, but for the corpus ones, which tests/llm has
    NAMES = sorted(n for n in contract.oracle_sql() if n in contract.QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    cur = con.execute(contract.oracle_sql()[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry_and_registry(spark):
    assert contract.entry(spark).limit(1).count() == 1
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 164
