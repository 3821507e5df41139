"""The composed searches against plain Python: fused lists, filters before retrieval, similar chunks, reviews, routed evidence."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwell.operators import audit, fusion, lexical, vector
from siftwell.plans import search as sp

WORDS = ["parse", "reader", "token", "cache", "index", "query", "vector", "merge", "chunk", "graph", "stream", "config", "error", "login"]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(60):
        lang = ["python", "go"][i % 2]
        rows.append((f"c{i:02d}", f"src/{lang}/f{i // 3}.{lang[:2]}", " ".join(rnd.choices(WORDS, [1 / (1 + j) for j in range(14)], k=rnd.randint(4, 18))), "text", lang, None, None, 10 * (i % 3) + 1, 10 * (i % 3) + 10, i % 30, "ABCDF"[i % 5], i % 4 // 3, 100 - i))
    schema = "chunk_id string, file_path string, content string, chunk_type string, language string, function_name string, class_name string, start_line int, end_line int, cognitive_complexity int, complexity_grade string, smell_count int, quality_score int"
    chunks = spark.createDataFrame(rows, schema)
    docs = chunks.select("chunk_id", F.col("content").alias("doc_text"))
    return rows, sp.SearchTables(chunks, lexical.bm25_index(docs), vector.hash_vectors(docs, "chunk_id", "doc_text", 16), 16)


QUERIES = {1: "parse token cache", 2: "stream", 3: "config error login merge", 4: "graph graph index"}


def asked(spark, queries=QUERIES):
    return spark.createDataFrame(sorted(queries.items()), "query_id int, text string")


def tokens(text):
    return Counter(re.findall(r"\w+", text.lower()))


def slow_bm25(texts, query):
    docs = {c: tokens(t) for c, t in texts.items()}
    n, avg = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
    df = Counter(t for d in docs.values() for t in d)
    idf = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = {}
    for c, d in docs.items():
        dl = sum(d.values())
        out[c] = round(sum(q * idf[t] * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * dl / avg)) for t, q in tokens(query).items() if t in d), 6)
    return sorted(((s, c) for c, s in out.items() if s > 0), key=lambda x: (-x[0], x[1]))


def slow_vector(text, dim=16):
    v = [0.0] * dim
    for t, k in tokens(text).items():
        v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim] += k
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v]


def slow_near(texts, query):
    q = slow_vector(query)
    sims = {c: round(sum(a * b for a, b in zip(q, slow_vector(t))), 6) for c, t in texts.items()}
    return sorted(((round(max(0, 1 - round(1 - s, 6) / 2), 7), s, c) for c, s in sims.items()), key=lambda x: (-x[1], x[2]))


PLAIN = dict(expand=False, rerank=False, mmr=False, threshold=0.0)


@pytest.mark.parametrize("mode", ["bm25", "vector", "hybrid"])
def test_search_equals_plain_lists(spark, corpus, mode):
    rows, tables = corpus
    texts = {r[0]: r[2] for r in rows}
    found = sp.search(tables, asked(spark), sp.SearchOptions(limit=6, mode=mode, **PLAIN)).collect()
    raw = sp.SearchOptions(limit=6, mode=mode, **PLAIN)
    for q, text in QUERIES.items():
        prepared = sp.prepared_queries(asked(spark, {q: text}), raw).first()
        text_list, near = slow_bm25(texts, prepared.variant)[:6], slow_near(texts, prepared.variant)[:6]
        if mode == "bm25":
            want = {c: round(min(1, s / 10), 7) for s, c in text_list}
        elif mode == "vector":
            want = {c: s for s, _, c in near}
        else:
            score = Counter()
            for i, (_, _, c) in enumerate(near, 1):
                score[c] += prepared.alpha / (60 + i)
            for i, (_, c) in enumerate(text_list, 1):
                score[c] += (1 - prepared.alpha) / (60 + i)
            boost = {c: v * (fusion.TYPE_BOOST if prepared.natural else fusion.TYPE_DAMPEN) for c, v in score.items()}
            ranked = sorted(((round(v / max(boost.values()), 8), c) for c, v in boost.items()), key=lambda x: (-x[0], x[1]))[:6]
            want = {c: v for v, c in ranked}
        got = {r.chunk_id for r in found if r.query_id == q}
        assert got == set(want), (mode, q)
        # the final rank adds features of path and names to each score, which a plain call gives as well
        hits = [(q, text, *next(r for r in rows if r[0] == c), v) for c, v in want.items()]
        plain = spark.createDataFrame(hits, "query_id int, query_text string, chunk_id string, file_path string, content string, chunk_type string, language string, function_name string, class_name string, start_line int, end_line int, cognitive_complexity int, complexity_grade string, smell_count int, quality_score int, score double")
        again = {r.chunk_id: (r.score, r["rank"]) for r in fusion.rank_features(plain).collect()}
        assert {r.chunk_id: (pytest.approx(r.score, abs=2e-6), r["rank"]) for r in found if r.query_id == q} == again


def hits(df):
    return sorted((r.query_id, r.chunk_id, round(r.score, 6)) for r in df.collect())


def test_filters_apply_before_retrieval(spark, corpus):
    rows, tables = corpus
    narrowed = {
        "glob": (dict(path_glob="src/go/*"), lambda r: r[4] == "go"),
        "quality": (dict(quality={"max_complexity": 12, "no_smells": True}), lambda r: r[9] <= 12 and r[11] == 0),
        "filter": (dict(filters={"language": "python"}), lambda r: r[4] == "python"),
    }
    texts = {r[0]: r[2] for r in rows}
    for name, (option, test) in narrowed.items():
        found = sp.search(tables, asked(spark), sp.SearchOptions(limit=5, mode="bm25", **PLAIN, **option)).collect()
        for q, text in QUERIES.items():
            want = [c for _, c in slow_bm25(texts, text) if test(next(r for r in rows if r[0] == c))][:5]
            assert {r.chunk_id for r in found if r.query_id == q} == set(want), (name, q)


def test_second_space_and_quality_move_hits(spark, corpus):
    rows, tables = corpus
    plain = sp.SearchOptions(limit=5, mode="vector", **PLAIN)
    with_code = sp.SearchTables(tables.chunks, tables.index, tables.vectors, 16, code_vectors=tables.vectors.filter("chunk_id < 'c30'"))
    lifted = {(q, c): s for q, c, s in hits(sp.search(with_code, asked(spark), plain))}
    assert any(c < "c30" and s > 0.95 for (_, c), s in lifted.items())
    by_quality = sp.search(tables, asked(spark), sp.SearchOptions(limit=5, mode="vector", quality_rerank=True, **PLAIN)).collect()
    before = {(q, c): s for q, c, s in hits(sp.search(tables, asked(spark), plain))}
    quality = {r[0]: r[12] for r in rows}
    assert {(r.query_id, r.chunk_id): r.score for r in by_quality} == {(q, c): pytest.approx(0.7 * s + 0.3 * quality[c] / 100, abs=2e-6) for (q, c), s in before.items()}


def test_similar_chunks_leave_the_asked_one_out(spark, corpus):
    rows, tables = corpus
    texts = {r[0]: r[2] for r in rows}
    ids = spark.createDataFrame([("c05",), ("c41",)], "chunk_id string")
    found = sp.search_similar(tables, ids, sp.SearchOptions(limit=4, mode="vector", expand=False, rerank=False, mmr=False, threshold=0.0)).collect()
    for own in ("c05", "c41"):
        prepared = sp.prepared_queries(spark.createDataFrame([(own, texts[own])], "query_id string, text string"), sp.SearchOptions(expand=False)).first().variant
        best = {c for _, _, c in slow_near(texts, prepared)[:5]} - {own}
        got = [r for r in found if r.query_id == own]
        assert {r.chunk_id for r in got} <= best and sorted(r["rank"] for r in got) == [1, 2, 3, 4][: len(got)] and len(got) >= 3


def test_context_and_reviews(spark, corpus):
    _, tables = corpus
    opts = sp.SearchOptions(limit=5, mode="bm25", **PLAIN)
    by_context = sp.search_by_context(tables, spark.createDataFrame([(1, "parse token", ["cache"])], "query_id int, description string, focus_areas array<string>"), opts)
    assert hits(by_context) == hits(sp.search(tables, asked(spark, {1: "parse token cache"}), opts))
    reviews = spark.createDataFrame([("r", "parse token"), ("r", "stream"), ("s", "stream")], "review_id string, text string")
    got = {(r.review_id, r.chunk_id): r.score for r in sp.review_gather(tables, reviews).collect()}
    single = {t: sp.search(tables, asked(spark, {1: t}), sp.SearchOptions(limit=30, rerank=False, mmr=False)).collect() for t in ("parse token", "stream")}
    want = {}
    for review, text in (("r", "parse token"), ("r", "stream"), ("s", "stream")):
        for r in single[text]:
            want[review, r.chunk_id] = max(want.get((review, r.chunk_id), 0), r.score)
    top = {k: v for k, v in want.items() if k[0] == "s"}
    assert {k: v for k, v in got.items() if k[0] == "s"} == {k: pytest.approx(v) for k, v in top.items()}
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_evidence_goes_to_the_engine_of_its_tool(spark, corpus):
    rows, tables = corpus
    claims = spark.createDataFrame([("x", "encryption", [], "we encrypt"), ("y", "other", ["parse", "token"], "we parse tokens")], "claim_id string, category string, keywords array<string>, normalized string")
    nodes = spark.createDataFrame([("n1", "encryption_key", "src/keys.py"), ("n2", "caller", "src/a.py"), ("n3", "cipher_box", "src/keys.py")], "id string, name string, file_path string")
    edges = spark.createDataFrame([("n2", "n1"), ("n2", "n3")], "src string, dst string")
    found = audit.evidence_hits(claims, tables.index, tables.chunks, 4, tables.vectors, nodes, edges, 16).collect()
    graph = [r for r in found if r.tool in audit.GRAPH_TOOLS]
    assert [(r.claim_id, r.file_path, r.start_line, r.score, r.call_path) for r in graph] == [("x", "src/keys.py", 0, 0.7, ["caller -> encryption_key"])]
    texts = {r[0]: r[2] for r in rows}
    place = {r[0]: (r[1], r[7], r[8]) for r in rows}
    code = [r for r in found if r.claim_id == "y" and r.tool == "search_code"]
    near = {place[c]: s for s, _, c in slow_near(texts, "parse token")[:4]}
    assert code and all((r.file_path, r.start_line, r.end_line) in near and r.score == near[r.file_path, r.start_line, r.end_line] and r.weight == 1.0 for r in code)
    assert {r.tool for r in found} >= {"kg_query", "search_hybrid"}
    for claim in ("x", "y"):
        own = [(r.file_path, r.start_line, r.end_line) for r in found if r.claim_id == claim]
        assert len(own) == len(set(own))


def test_suggestions_and_three_way_lists(spark, corpus):
    _, tables = corpus
    nodes = spark.createDataFrame([("a", "TokenReader", "src/x.py"), ("b", "other", "src/y.py"), ("c", "third", "src/z.py")], "id string, name string, file_path string")
    edges = spark.createDataFrame([("a", "b"), ("c", "a")], "src string, dst string")
    listed = sp.graph_hits(asked(spark, {1: "the reader of it", 2: "nothing known"}), nodes, edges)
    assert sorted(tuple(r) for r in listed.collect()) == [(1, "src/y.py", 1), (1, "src/z.py", 2)]
    both = sp.SearchTables(tables.chunks, tables.index, tables.vectors, 16, nodes=nodes, edges=edges)
    fused = sp.three_way_search(both, asked(spark, {1: "reader token"}), 5).collect()
    assert len(fused) == 5 and [r["rank"] for r in sorted(fused, key=lambda r: -r.score)] == [1, 2, 3, 4, 5] and all(r.score >= 0.01 for r in fused)
    only = sp.three_way_search(both, asked(spark, {1: "reader token"}), 5, ["graph"]).collect()
    assert {(r.file_path, r.strategies, r.score) for r in only} == {("src/y.py", "graph", round(1.15 / 61, 6)), ("src/z.py", "graph", round(1.15 / 62, 6))}
    hits_ = spark.createDataFrame([(1, 1, "parse_file", "Reader", "src/file_reader.py"), (1, 2, "apply", "", "src/tool.py"), (1, 9, "zeta", "", "src/late.py")], "query_id int, rank int, function_name string, class_name string, file_path string")
    got = fusion.suggest_queries(hits_, asked(spark, {1: "apply reader"}))
    assert [(r.suggestion, r.place) for r in sorted(got.collect(), key=lambda r: r.place)] == [("parse_file", 1), ("zeta", 2), ("file", 3), ("tool", 4)]
