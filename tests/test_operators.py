"""Operators on small hand-made inputs, checked by hand or by brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.functions import extensions as ext
from siftwell.functions import metrics as mx
from siftwell.functions import pycode
from siftwell.functions import queries as qx
from siftwell.functions import text as tx
from siftwell.operators import audit, chunking, documents, fusion, graph, joins, lexical, names, predicates, vector
from siftwell.sources import formats, tables
from siftwell.streaming import changes


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_global_numbering_splits_a_hot_value(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), ((F.col("id") * 37) % 1000).alias("id")).repartition(5)
    out = runtime.number_rows(df, ["k", "id"], "n")
    assert [tuple(r) for r in out.orderBy("n").select("n", "id").collect()] == [(i + 1, i) for i in range(1000)]


def test_running_sum_and_max_match_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["a", "a", "a", "b"], 400), "o": rng.permutation(400), "v": rng.integers(-50, 50, 400)})
    df = spark.createDataFrame(pdf)
    total = runtime.running(df, ["k"], ["o"], F.col("v"), "sum", "s").toPandas().sort_values(["k", "o"])
    assert (total.groupby("k")["v"].cumsum() == total["s"]).all()
    top = runtime.running(df, ["k"], ["o"], F.col("v"), "max", "m", inclusive=False).toPandas().sort_values(["k", "o"])
    want = top.groupby("k")["v"].transform(lambda x: x.cummax().shift())
    assert (want.fillna(-999) == top["m"].fillna(-999)).all()


def test_tokens_of_identifiers(spark):
    df = spark.createDataFrame([(1, "getstream.io HybridSearchHandler find_by_tag 42 tag tag Étion")], "id int, text string")
    got = dict(rows(tx.token_counts(df, "id", "text"), "term", "tf"))
    assert got["getstream.io"] == 1 and got["getstream"] == 1 and got["io"] == 1
    assert got["hybrid"] == got["search"] == got["handler"] == 1
    assert got["tag"] == 2 and got["find"] == 1 and "42" not in got and got["étion"] == 1


def test_no_task_groups_tokens_of_many_texts(spark, monkeypatch):
    monkeypatch.setattr(tx, "SLICE_TOKENS", 50)
    texts = [(i, " ".join(f"w{i * j % 90} fooBar{j % 3} {j}" for j in range(i))) for i in range(60)] + [(60, None), (61, ""), (62, "7 8")]
    df = spark.createDataFrame(texts, "id int, text string").repartition(1)
    tokens = tx.token_rows(df, "id", "text")
    assert "Aggregate" not in tokens._jdf.queryExecution().executedPlan().toString()
    got = rows(tokens, "id", "term", "tf", "dl")
    want = []
    for i, text in texts:
        n = {}
        for w in (text or "").lower().split():
            if not w.isdecimal():
                n[w] = n.get(w, 0) + 1
        parts = {"foo", "bar"} if any(w.startswith("foobar") for w in n) else set()
        n |= {p: 1 for p in parts if p not in n}
        want += [(i, w, c, sum(n.values())) for w, c in n.items()]
    assert sorted(got) == sorted(want)


def test_bm25_formula_on_three_texts(spark):
    docs = spark.createDataFrame([("a", "apple apple pear"), ("b", "pear plum"), ("c", "fig fig fig"), ("d", "kiwi")], "chunk_id string, doc_text string")
    hits = lexical.bm25_search(lexical.bm25_index(docs), spark.createDataFrame([(1, "apple")], "query_id int, text string"))
    idf = np.log(4 - 1 + 0.5) - np.log(1.5)
    want = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (9 / 4)))
    assert rows(hits, "chunk_id", "score", "rank") == [("a", round(want, 6), 1)]


def test_paragraphs_merge_and_windows(spark):
    text = "\n".join(["# Title of a text here", "", "x" * 150, "", "y" * 150, "", "z" * 390, ""])
    df = spark.createDataFrame([("f.md", text)], "file_path string, text string")
    got = rows(chunking.chunk_text(df), "start_line", "end_line")
    assert got == [(1, 5), (7, 7)]
    long = spark.createDataFrame([("f.md", "\n".join(str(i) for i in range(60)))], "file_path string, text string")
    assert rows(chunking.chunk_text(long, mode="lines"), "start_line", "end_line") == [(1, 30), (27, 56), (53, 60)]


def test_rrf_by_hand(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, chunk_id string, rank int")
    got = {r.chunk_id: r.score for r in fusion.hybrid_rrf(v, b, 0.7).collect()}
    raw = {"a": 0.7 / 61, "b": 0.7 / 62 + 0.3 / 61, "c": 0.3 / 62}
    top = max(raw.values())
    assert got == {k: round(x / top, 8) for k, x in raw.items()}


def vectors(spark, n=300, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    return m, spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "chunk_id long, vector array<double>")


def brute(m, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    return {i: [int(j) for j in np.lexsort((np.arange(len(m)), -s[i]))[:k]] for i in range(len(m))}


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


def test_knn_broadcast_blocks_and_all_cells_agree_with_brute_force(spark):
    m, df = vectors(spark)
    want = brute(m, 5)
    assert by_query(vector.knn_exact(df, df, 5, query_id="chunk_id")) == want
    assert by_query(vector.block_top_k(df, df, 5, "chunk_id", "vector", "chunk_id", "vector", block_rows=70)) == want
    assigned, centres = vector.ann_index(df, cells=6)
    assert by_query(vector.ann_search(assigned, centres, df, 5, nprobe=6, query_id="chunk_id", block_rows=20)) == want
    near = by_query(vector.ann_search(assigned, centres, df, 5, nprobe=3, query_id="chunk_id"))
    recall = np.mean([len(set(near[i]) & set(want[i])) / 5 for i in want])
    assert recall > 0.7


def test_blocks_do_not_multiply_with_the_rows():
    assert [-(-n // vector._block_size(n, 40)) for n in (100, 640, 10_000, 500_000)] == [3, 16, 16, 16]
    assert vector._block_size(10_000_000, 40) == vector.HELD_ROWS


def test_a_block_product_with_near_copies_is_exact(monkeypatch):
    monkeypatch.setattr(vector, "TILE_CELLS", 4000)
    rng = np.random.default_rng(4)
    m = rng.normal(size=(400, 16))
    m[100:250] = m[0]
    m[250:300] = m[1] + rng.normal(size=(50, 16)) * 1e-6
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = rng.permutation(400)
    sims = np.round(m @ m.T, 6)
    for not_self in (False, True):
        q, c, s = vector._block_product(ids, m, ids, m, 7, not_self)
        assert len(q) == 2800
        for i in range(400):
            order = [j for j in np.lexsort((ids, -sims[i])) if not not_self or j != i][:7]
            assert list(c[q == ids[i]]) == [ids[j] for j in order] and np.allclose(s[q == ids[i]], sims[i][order])


def test_related_nodes_of_alike_starts_are_walked_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART_ROWS", 50)
    pairs = [("a", f"s{i}") for i in range(30)] + [("b", f"s{i}") for i in range(25, 50)] + [("r", "a"), ("r", "b"), ("s3", "s3"), ("s4", "s5")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    around = {}
    for x, y in pairs:
        around.setdefault(x, set()).add(y)
        around.setdefault(y, set()).add(x)
    starts = [f"s{i}" for i in range(50)] + ["a", "zz"]
    frame = spark.createDataFrame([(x,) for x in starts * 2], "start string")
    for far in (1, 2, 3):
        want = []
        for x in starts:
            depth, at = {x: 0}, [x]
            for n in range(1, far + 1):
                at = sorted({z for y in at for z in around.get(y, ()) if z not in depth})
                depth |= {z: n for z in at}
            want += [(x, y, n) for y, n in depth.items() if n]
        assert sorted(rows(graph.find_related(e, frame, far), "start", "node", "depth")) == sorted(want)
    alike = graph._alike(frame, graph.undirected(e))
    assert alike.select("like").distinct().count() < 12 and alike.count() == 51


def test_similar_pairs_match_brute_force_and_only_near_ones_meet_their_words(spark):
    rng = np.random.default_rng(5)
    base = [rng.choice(3000, rng.integers(1, 700), replace=False) for _ in range(25)]
    texts = [[f"w{x}" for x in b] + [f"n{i}x{j}" for j in range(rng.integers(0, max(1, len(b) // 4)))] for b in base for i in range(4)]
    texts += [["rare"] + [f"u{i}x{j}" for j in range(30)] for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "claim_id long, normalized string")
    sets = [set(t) for t in texts]
    want = {(i, j): round(len(a & b) / len(a | b), 6) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and round(len(a & b) / len(a | b), 6) >= 0.8 and a != b}
    got = joins.similar_pairs(df, df, 0.8).filter("left_id < right_id")
    first = {tuple(sorted(s)): i for i, s in reversed(list(enumerate(sets)))}
    kept = set(first.values())
    assert {(r.left_id, r.right_id): r.jaccard for r in got.collect()} == {p: v for p, v in want.items() if kept.issuperset(p)} and want
    other = df.filter("claim_id % 2 = 0")
    pairs = {(r.left_id, r.right_id) for r in joins.similar_pairs(other, df.select("*"), 0.8).filter("left_id < right_id").collect()}
    assert pairs and all(p in want for p in pairs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan


def test_mmr_matches_plain_greedy(spark):
    m, df = vectors(spark, 40)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    score = (u @ u[0] + 1) / 2
    cand = spark.createDataFrame([(1, i, float(score[i]), i + 1, [float(x) for x in m[i]]) for i in range(40)], "query_id int, chunk_id long, score double, rank int, vector array<double>")
    got = [r.chunk_id for r in vector.mmr(cand, 0.5, 8).orderBy("mmr_rank").collect()]
    chosen = []
    while len(chosen) < 8:
        left = [i for i in range(40) if i not in chosen]
        value = {i: 0.5 * score[i] - 0.5 * max((u[i] @ u[j] for j in chosen), default=0.0) for i in left}
        chosen.append(max(left, key=lambda i: (value[i], -i)))
    assert got == chosen


def greedy_ranges(evidence):
    best = {}
    for c, f, s, e, x in evidence:
        best[c, f, s, e] = max(x, best.get((c, f, s, e), -1))
    kept = []
    for (c, f, s, e), x in sorted(best.items(), key=lambda t: (-t[1], t[0][2], t[0][3])):
        clash = any(k[:2] == (c, f) and ((s, e) == (0, 0)) == (k[2:4] == (0, 0)) and (((s, e) == (0, 0)) or (k[2] <= e and s <= k[3])) for k in kept)
        if not clash:
            kept.append((c, f, s, e, x))
    return sorted(kept)


def test_overlap_dedup_small_and_hot_islands(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(300):
        s = int(rng.integers(1, 400))
        data.append(("c1" if i % 3 else "c2", "f", s, s + int(rng.integers(0, 12)), float(i % 97) + i / 1000))
    data += [("c1", "f", 0, 0, 1.0), ("c1", "f", 0, 0, 2.0)]
    df = spark.createDataFrame(data, "claim_id string, file_path string, start_line int, end_line int, score double")
    want = greedy_ranges(data)
    cols = ["claim_id", "file_path", "start_line", "end_line", "score"]
    assert rows(joins.overlap_dedup(df), *cols) == want
    assert rows(joins.overlap_dedup(df, hot=5), *cols) == want


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b)


def test_fuzzy_claim_merge_matches_plain_greedy(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words, 6, replace=False)) for _ in range(60)]
    base, extra = list(enumerate(texts[:10])), list(enumerate(texts[10:], 100))
    schema = "claim_id int, normalized string"
    got = rows(joins.fuzzy_claim_merge(spark.createDataFrame(base, schema), spark.createDataFrame(extra, schema), 0.7), "claim_id")
    kept = list(base)
    for i, t in extra:
        if all(jaccard(t, k) < 0.7 for _, k in kept):
            kept.append((i, t))
    assert got == sorted((i,) for i, _ in kept)


def test_pairs_within_a_hot_group(spark):
    df = spark.createDataFrame([("k", i) for i in range(50)] + [("j", 1), ("j", 2)], "key string, item int")
    got = rows(joins.pairs_within(df, "key", "item", hot=7), "key", "a", "b")
    assert got == sorted([("k", a, b) for a in range(50) for b in range(a + 1, 50)] + [("j", 1, 2)])


def edge_table(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_cycles_self_two_long_and_acyclic(spark):
    e = edge_table(spark, [("a", "a"), ("b", "c"), ("c", "b"), ("d", "e"), ("e", "f"), ("f", "d"), ("x", "y"), ("y", "z")])
    assert rows(graph.cycles(e), "cycle") == [("a",), ("b>c",), ("d>e>f",)]
    assert rows(graph.cycles(e, self_loops=False), "cycle") == [("b>c",), ("d>e>f",)]


def test_lca_on_a_tree_of_depth_four(spark):
    e = edge_table(spark, [("root", "m1"), ("root", "m2"), ("m1", "file"), ("file", "cls"), ("cls", "a"), ("cls", "b"), ("q", "r")])
    pairs = spark.createDataFrame([("a", "b"), ("a", "m2"), ("a", "a"), ("a", "r")], "a string, b string")
    got = {(r.a, r.b): (r.lca, r.resonance) for r in graph.lca_score(e, pairs).collect()}
    assert got[("a", "b")] == ("cls", 1 - 2 / 8)
    assert got[("a", "m2")] == ("root", round(1 - (4 + 1 + 1.5) / 8, 6))
    assert got[("a", "a")] == ("a", 1.0) and got[("a", "r")] == (None, 0.0)


def test_trace_goes_as_deep_as_asked(spark):
    e = edge_table(spark, [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n0", f"k{i}") for i in range(5)])
    start = spark.createDataFrame([("n0",)], "start string")
    assert graph.trace_flow(e, start, 50).agg(F.max("depth")).first()[0] == graph.trace_flow(e, start, None).agg(F.max("depth")).first()[0] > 8
    assert graph.trace_flow(e, start, 0).agg(F.max("depth")).first()[0] == 1
    assert graph.trace_flow(e, start, 8, max_nodes=4).count() == 5
    assert graph.trace_flow(e, spark.createDataFrame([("zz",)], "start string")).count() == 1


def test_components_and_find_entity(spark):
    m = spark.createDataFrame([("C", "m1", "x"), ("C", "m2", "x"), ("C", "m2", "y"), ("C", "m3", "y"), ("C", "m4", "z")], "class string, method string, attribute string")
    assert rows(graph.lcom4(m), "class", "lcom4") == [("C", 2)]
    nodes = spark.createDataFrame([("1", "parse_file"), ("2", "FileReader"), ("3", "main")], "id string, name string")
    asked = spark.createDataFrame([("parse_file",), ("reader",), ("main",), ("load",), ("zz",)], "query_name string")
    assert rows(graph.find_entity(nodes, asked), "query_name", "id") == [("main", "3"), ("parse_file", "1"), ("reader", "2")]


def test_substring_pairs_match_plain_search(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcd"), 9)) for _ in range(80)]
    needles = sorted({"".join(rng.choice(list("abcd"), n)) for n in (1, 2, 3, 4, 5) for _ in range(6)})
    a = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    b = spark.createDataFrame([(n,) for n in needles], "needle string")
    want = sorted((i, n) for i, t in enumerate(texts) for n in needles if n in t)
    assert rows(names.substring_pairs(a, b), "text_id", "needle") == want


def test_documents_sections_links_and_categories(spark):
    text = "---\ntags: a, b\nlabels:\n- c\n---\n# One\nsee `run_it` and [x](../d/two.md#s)\n## Two\n```py\nz()\n```\n"
    df = spark.createDataFrame([("d/one.md", text), ("d/two.md", "plain")], "file_path string, text string")
    s = documents.doc_sections(df)
    assert rows(s, "title", "level", "line", "end_line") == [("One", 1, 6, 7), ("Two", 2, 8, 12)]
    assert rows(documents.related_documents(df), "src", "dst") == [("d/one.md", "d/two.md")]
    assert df.select(documents.frontmatter_tags(F.col("text")).alias("t")).first().t == ["a", "b", "c"]
    paths = ["README.md", "docs/api/x.md", "a/b.yaml", "notes/faq.md", "x/plain.md", "my-fix.md"]
    p = spark.createDataFrame([(x,) for x in paths], "p string")
    got = {r.p: r.c for r in p.select("p", documents.classify_document(F.col("p")).alias("c")).collect()}
    assert got == {"README.md": "readme", "docs/api/x.md": "api_doc", "a/b.yaml": "configuration", "notes/faq.md": "faq", "x/plain.md": "other", "my-fix.md": "bugfix"}


def test_html_sections_drop_scripts_and_merge(spark):
    page = "<html><script>bad()</script><h1>Head</h1><p>small text</p><p>" + "long words " * 60 + "</p></html>"
    got = documents.html_sections(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("section").collect()
    assert got[0].chunk_type == "heading" and "small text" in got[0].content and "bad" not in " ".join(r.content for r in got)


def test_policy_claims(spark):
    text = "# Privacy\nWe never sell your data. We share records with partners and delete your data on request.\nNothing here."
    got = audit.policy_claims(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    by = {r.sentence: (r.category, r.confidence, r.section) for r in got.collect()}
    assert by["We never sell your data."] == ("data_sharing", 0.9, "Privacy")
    assert len(by) >= 2 and all("Nothing" not in k for k in by)
    assert got.filter("normalized = 'The application does not sell your data'").count() == 1


def test_metrics_queries_and_globs(spark):
    df = spark.createDataFrame([(5,), (6,), (21,), (31,)], "c int")
    assert [r[0] for r in df.select(mx.grade(F.col("c"))).collect()] == ["A", "B", "D", "F"]
    assert predicates.grade_set("A-C,F") == ["A", "B", "C", "F"]
    q = spark.createDataFrame([("auth middleware",), ("find retry with backoff",), ("StreamApp",), ("retry_count += 1",)], "text string")
    flags = [tuple(r) for r in q.select(qx.is_nl_query(F.col("text")), qx.is_identifier_query(F.col("text"))).collect()]
    assert flags == [(False, False), (True, False), (False, True), (False, False)]
    variants = q.limit(1).select(F.explode(qx.expand_query(F.col("text")))).collect()
    assert [r[0] for r in variants][:2] == ["auth middleware", "authentication middleware"] and len(variants) == 1 + 6 + 5
    paths = spark.createDataFrame([("a/b/x.py",), ("a/.git/x.py",), ("node_modules/x.js",), (".github/w.yml",)], "file_path string")
    assert rows(predicates.file_filter(paths, ["node_*"]), "file_path") == [(".github/w.yml",), ("a/b/x.py",)]


def test_log_and_diff_text(spark):
    log = "x1|x|Merge b|body|Ann|a@b|2024-01-02T03:04:05+00:00\n3\t1\ta.py\n-\t-\tb.bin\n\nx2|y|fix|z|Bob|b@c|2024-01-03T00:00:00+00:00\n"
    got = formats.read_commits(spark.createDataFrame([(log,)], "text string"))
    assert rows(got, "sha", "author", "files_changed", "insertions", "deletions", "is_merge") == [("x1", "Ann", 2, 3, 1, True), ("x2", "Bob", 0, 0, 0, False)]
    diff = "diff --git a/p.py b/p.py\n--- a/p.py\n+++ b/p.py\n@@\n+one\n-two\n+three\n"
    assert rows(formats.parse_diff_stats(spark.createDataFrame([(1, diff)], "id int, text string"), "id"), "file", "additions", "deletions") == [("p.py", 2, 1)]


def test_python_facts(spark):
    code = "def f(a, *, b):\n    if a and b:\n        for x in a:\n            g(x)\n    return [y for y in b if y]\n\ndef test_a():\n    f(1)\n    test_b()\n\ndef test_b():\n    pass\n"
    df = spark.createDataFrame([("t.py", code), ("bad.py", "def (")], "file_path string, text string")
    m = {r.name: (r.cyclomatic_complexity, r.max_nesting, r.parameter_count, r.lines) for r in pycode.python_metrics(df).collect()}
    assert m["f"] == (6, 2, 2, 5)
    assert rows(pycode.test_anti_patterns(df), "test", "pattern") == [("test_a", "no_assertion"), ("test_a", "test_calls_test"), ("test_b", "empty_body")]


def test_parser_and_versions_and_stream(spark):
    ext.register_parser(".foo", lambda t, p: [{"content": t, "start_line": 1, "end_line": 1, "chunk_type": "all", "name": p}])
    df = spark.createDataFrame([("a.foo", "x"), ("b.bar", "y")], "file_path string, text string")
    assert rows(ext.parse_files(df), "file_path", "content") == [("a.foo", "x")]
    root = runtime.scratch_path(spark, "t")
    v = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, x int")
    now = F.lit("2024-01-01").cast("timestamp")
    tables.write_vectors(v, root, "m1", now)
    tables.write_vectors(v.filter("x = 1").withColumn("x", F.lit(9)), root, "m2", now)
    assert rows(tables.read_keyed(spark, root), "chunk_id", "x", "model_version") == [("a", 9, "m2"), ("b", 2, "m1")]


def test_debounce_gap_rules(spark):
    base = [("f", i, 100.0 + t) for i, t in enumerate([0.0, 0.5, 1.4, 2.4, 9.0])]
    df = spark.createDataFrame(base, "file_path string, event_id int, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert rows(changes.debounce_batch(df, 1.0), "events") == rows(changes.debounce(df, "1 second"), "events") == [(1,), (4,)]


def test_long_cycles_hubs_and_cyclic_trees(spark):
    ring = [(f"c{i}", f"c{(i + 1) % 8}") for i in range(8)]
    e = edge_table(spark, [*ring, ("in", "c0"), ("c3", "out"), ("out", "end")])
    assert rows(graph.cycles(e), "cycle", "length") == [(">".join(f"c{i}" for i in range(8)), 8)]
    assert graph.cycles(e, max_length=6).count() == 0
    hub = edge_table(spark, [("hub", f"n{i:03}") for i in range(200)])
    start = spark.createDataFrame([("hub",)], "start string")
    assert graph.find_related(hub, start, 1).count() == 200 and graph.find_related(hub, start, 1, limit=7).count() == 7
    tree = edge_table(spark, [("root", "a"), ("root", "b"), ("a", "m"), ("b", "m"), ("m", "x"), ("x", "m"), ("y", "z"), ("z", "y")])
    assert rows(graph.tree_paths(tree), "node", "depth") == [("a", 1), ("b", 1), ("m", 2), ("root", 0), ("x", 3)]


def test_snapshot_of_one_project_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "snap")
    tables.save_snapshot(spark.createDataFrame([("a", "2024-01-01", 1), ("b", "2024-01-01", 2)], "project string, day string, n int"), path)
    tables.save_snapshot(spark.createDataFrame([("a", "2024-01-01", 9)], "project string, day string, n int"), path)
    assert rows(spark.read.parquet(path), "project", "n") == [("a", 9), ("b", 2)]


def test_late_events_do_not_bring_files_back(spark, tmp_path):
    root, folder = str(tmp_path / "live"), str(tmp_path / "in")
    tables.write_keyed(spark.createDataFrame([("f", "old"), ("g", "old")], "file_path string, content string"), root, "file_path", 4)
    for i, event in enumerate([(2, "2024-01-02", "f", "deleted"), (1, "2024-01-01", "f", "modified"), (3, "2024-01-03", "g", "modified")]):
        day = spark.createDataFrame([event], "event_id long, ts string, file_path string, event_type string")
        day.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("new_path", F.lit(None).cast("string")).coalesce(1).write.mode("append").parquet(folder)
        changes.stream_changes(changes.watch_changes(spark, folder, files_per_trigger=1), root, lambda p: p.withColumn("content", F.lit("new")), str(tmp_path / "state")).awaitTermination()
    assert rows(tables.read_keyed(spark, root), "file_path", "content") == [("g", "new")]


def test_id_follows_the_whole_content(spark):
    df = spark.createDataFrame([("x" * 100 + t,) for t in ("a", "b", "a")], "content string")
    key = tx.chunk_id(F.lit("p"), F.lit("text"), F.lit(None).cast("string"), F.lit(1), F.lit(2), F.col("content"))
    assert df.select(key.alias("k")).distinct().count() == 2


def test_products_in_tiles_are_the_same(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    table = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(300)], "chunk_id long, vector array<double>")
    asked = table.select(F.col("chunk_id").alias("query_id"), "vector")
    whole = rows(vector.knn_exact(table, asked, 3), "query_id", "chunk_id", "rank")
    monkeypatch.setattr(vector, "TILE_CELLS", 700)
    assert rows(vector.knn_exact(table, asked, 3), "query_id", "chunk_id", "rank") == whole
    cells = table.withColumn("cell", F.lit(0))
    centre = spark.createDataFrame([(0, [1.0] * 8)], "cell int, centroid array<double>")
    assert rows(vector.ann_search(cells, centre, asked, 3, nprobe=1, block_rows=64), "query_id", "chunk_id", "rank") == whole


@pytest.mark.parametrize("kind", ["long", "string"])
def test_shared_file_edges_shuffle_no_pairs(spark, kind):
    rnd = random.Random(8)
    name = (lambda i: i * 1_000_003 - 40) if kind == "long" else (lambda i: f"dev {i:03d}@x")
    made = [(name(i), "hot") for i in range(90)] + [(name(rnd.randrange(90)), f"p{rnd.randrange(40)}") for _ in range(600)] + [(name(3), None), (None, "hot"), (name(3), "p1"), (name(3), "p1")]
    got = rows(joins.shared_file_edges(spark.createDataFrame(made, f"author {kind}, path string"), block_pairs=300, hot=25), "a", "b", "shared", "weight")
    files = {}
    for author, path in set(made):
        files.setdefault(author, set()).add(path)
    files.pop(None)
    own = {a: p - {None} for a, p in files.items()}
    want = [(a, b, len(own[a] & own[b])) for a in own for b in own if a < b and own[a] & own[b]]
    assert [r[:3] for r in got] == sorted(want)
    assert all(abs(w - n / max(len(files[a]), len(files[b]))) < 1e-6 for a, b, n, w in got)
    plan = joins.shared_file_edges(spark.createDataFrame(made, f"author {kind}, path string"))._jdf.queryExecution().executedPlan().toString()
    assert "shared#" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    assert plan.count("Exchange hashpartitioning") == 2


def test_tokens_of_odd_texts_are_those_of_the_patterns(spark):
    rnd = random.Random(11)
    letters = ["a", "b", "Z", "QU", "é", "É", "ß", "İ", "Σ", "σ", "語", "٣", "7", "_", ".", "-", "/", " ", "\n", "\u0301", "😀", "ǅ", "²", "\x00", "fooBar", "HTTPServer", "snake_case_2", "v1.2-rc"]
    texts = [(i, "".join(rnd.choices(letters, k=rnd.randint(0, 60)))) for i in range(400)] + [(900, None), (901, ""), (902, "."), (903, "x"), (904, "a." * 40 + "é"), (905, "-a-")]
    df = spark.createDataFrame(texts, "id int, text string")
    low, lists = F.lower("text"), {}
    for r in df.select("id", F.regexp_extract_all(low, F.lit(tx.COMPOUND_PATTERN), 0).alias("c"), F.regexp_extract_all(low, F.lit(tx.WORD_PATTERN), 0).alias("w"),
                       F.regexp_extract_all("text", F.lit(tx.WORD_PATTERN), 0).alias("m")).collect():
        parts = [p for w in r.m or [] for p in tx.sub_words(w)]
        for t in {*(r.c or []), *(r.w or []), *parts}:
            if not t.isdecimal():
                lists[r.id, t] = r.c.count(t) or max(1, r.w.count(t))
    got = tx.token_rows(df, "id", "text").collect()
    assert {(r.id, r.term): r.tf for r in got} == lists and len(got) == len(lists)
    sizes = {}
    for (i, _), n in lists.items():
        sizes[i] = sizes.get(i, 0) + n
    assert all(r.dl == sizes[r.id] for r in got)
    assert not [line for line in tx.token_rows(df, "id", "text")._jdf.queryExecution().executedPlan().toString().splitlines() if "regexp_extract_all" in line]


def test_sub_words_of_identifiers(spark):
    words = ["fooBar", "HTTPServer", "snake_case_2", "_x_yy__", "aB", "ÉcoleNormale", "größe", "X1", "parseHTML", "a_1_22_b3", "JSONtoXML", "İstanbul_Ort"]
    snake = F.filter(F.split("w", "_"), lambda p: (F.length(p) > 1) & ~p.rlike(r"^\p{Nd}+$"))
    camel = F.filter(F.regexp_extract_all("w", F.lit(tx.CAMEL_PATTERN), 0), lambda p: F.length(p) > 1)
    want = {r.w: sorted(set(r.p)) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.transform(F.concat(snake, camel), F.lower).alias("p")).collect()}
    assert {w: sorted(tx.sub_words(w)) for w in words} == want


def test_bars_of_earlier_batches_leave_every_best_row(spark):
    m, df = vectors(spark)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    ids = np.array([f"c{i:03d}" for i in range(len(m))], object)
    best = vector._Best(5, np.full(len(m), -np.inf))
    for a in range(0, len(m), 90):
        own = slice(a, a + 90)
        bar = best.bar if np.isfinite(best.bar).all() else None
        q, c, s = vector._block_best(ids, unit, ids[own], unit[own], 5, False, bar)
        assert bar is None or (s >= bar[q]).all()
        best.add(q, ids[own][c], s)
    order = np.lexsort((best.ids.astype(str), -best.sims, best.query))
    got = {int(i): [int(x[1:]) for x in best.ids[order][best.query[order] == i]] for i in range(len(m))}
    assert got == brute(m, 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 80)
    try:
        assert by_query(vector.knn_exact(df, df, 5, query_id="chunk_id")) == brute(m, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ranker_lowers_a_text_once_a_row(spark):
    made = [(1, "c1", "a b c missing", "Alpha Bravo x", "x/alpha_b.py", "function", "py", "ab_Fn", None, 0.5)]
    names_ = "query_id int, chunk_id string, query_text string, content string, file_path string, chunk_type string, language string, function_name string, class_name string, score double"
    df = spark.createDataFrame(made, names_).withColumn("kw", F.array(F.lit("ABC"), F.lit("zz")))
    ranked = fusion.rank_features(df, keywords="kw")
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(lower(content" not in plan.lower() and "lower(content" in plan.lower()
    one, none = (fusion.rank_features(df.withColumn("kw", F.array(F.lit(w))), keywords="kw").first().score for w in ("ABC", "zz"))
    assert abs(one - none - fusion.KEYWORD_MATCH) < 1e-9
    counted = spark.createDataFrame([(["al", "x", "no"], "AL x"), ([], "a"), (["a"], None)], "w array<string>, t string").select(fusion._matches(F.col("w"), F.lower("t")).alias("n"))
    assert [r.n for r in counted.collect()] == [2, 0, 0]
