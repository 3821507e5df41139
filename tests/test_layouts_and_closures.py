"""Block-max postings, exact cells, quantised cells, name automaton, components, closures and tree labels against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.operators import documents, graph, lexical, names, vector
from siftwell.runtime import cut_lineage


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


# ------------------------------------------------------------ postings


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    made = [(f"c{i:04d}", " ".join(rnd.choices(words, [1 / (1 + j) for j in range(60)], k=rnd.randint(1, 40)))) for i in range(700)]
    made += [(f"d{i}", "rare w1 word") for i in range(3)]
    asked = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 6)))) for i in range(40)] + [(100, "rare rare word"), (101, "nothing known"), (102, "w0 w0 w1")]
    return lexical.bm25_index(spark.createDataFrame(made, "chunk_id string, doc_text string")), spark.createDataFrame(asked, "query_id int, text string")


@pytest.mark.parametrize("size", [50, 300, 4096])
def test_block_search_equals_full_scoring(corpus, size, tmp_path):
    index, asked = corpus
    want = rows(lexical.assign_rank(lexical.bm25_scores(index, asked), 5), "query_id", "chunk_id", "score", "rank")
    blocks = lexical.bm25_blocks(index, size)
    assert rows(lexical.block_search(blocks, asked, 5), "query_id", "chunk_id", "score", "rank") == want
    blocks.write(str(tmp_path / "ix"))
    stored = lexical.Bm25Blocks.read(asked.sparkSession, str(tmp_path / "ix"))
    assert stored.buckets <= blocks.buckets
    assert rows(lexical.bm25_search(stored, asked, 5), "query_id", "chunk_id", "score", "rank") == want


def test_block_search_with_a_first_pass_and_beyond_its_bound(corpus, monkeypatch):
    index, asked = corpus
    want = rows(lexical.assign_rank(lexical.bm25_scores(index, asked), 3), "query_id", "chunk_id", "score", "rank")
    monkeypatch.setattr(lexical, "SEED_BUCKETS", 2)
    blocks = lexical.bm25_blocks(index, 40)
    assert blocks.buckets > 10
    assert rows(lexical.block_search(blocks, asked, 3), "query_id", "chunk_id", "score", "rank") == want
    monkeypatch.setattr(lexical, "MAX_ASKED_ROWS", 5)
    assert lexical.block_search(blocks, asked, 3) is None
    assert rows(lexical.bm25_search(index, asked, 3), "query_id", "chunk_id", "score", "rank") == want
    with pytest.raises(ValueError):
        lexical.bm25_search(blocks, asked, 3)


def test_buckets_below_the_bar_are_passed_over(corpus):
    import pyarrow as pa

    asked = lexical._Asked(pa.table({"query_id": [1, 1, 2], "term": ["a", "b", "b"], "weight": [1.0, 2.0, 3.0]}))
    number = {t: i for i, t in enumerate(asked.terms.to_pylist())}
    q = {x: i for i, x in enumerate(asked.queries.to_pylist())}
    term, top = np.array([number["a"], number["b"]]), np.array([0.5, 1.0])
    lists = [(np.array([0, 2]), np.array([0.5, 0.1])), (np.array([1]), np.array([1.0]))]
    bar = np.zeros(2)
    query, slot, score, scored = lexical.score_bucket(asked, term, top, lists, 3, 1, bar)
    assert scored == 2 and sorted(zip(query.tolist(), slot.tolist(), score.tolist())) == sorted([(q[1], 1, 2.0), (q[2], 1, 3.0)])
    assert bar[q[1]] == 2.0 and bar[q[2]] == 3.0
    bar[q[1]] = 2.6
    query, _, _, scored = lexical.score_bucket(asked, term, top, lists, 3, 1, bar)
    assert scored == 1 and query.tolist() == [q[2]]


def test_no_query_chunk_pairs_are_shuffled(corpus):
    index, asked = corpus
    plan = lexical.block_search(lexical.bm25_blocks(index, 100), asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Exchange hashpartitioning(query_id") == 1


def test_narrowed_search_only_sees_what_is_allowed(corpus):
    index, asked = corpus
    allowed = index.postings.select("chunk_id").distinct().filter(F.col("chunk_id") < "c0100")
    want = lexical.bm25_scores(index, asked).join(allowed, "chunk_id", "left_semi")
    got = lexical.bm25_search(index, asked, 5, allowed=allowed)
    assert rows(got, "query_id", "chunk_id", "score") == rows(lexical.assign_rank(want, 5), "query_id", "chunk_id", "score")


# ------------------------------------------------------------ vectors


def grouped_vectors(spark, n=600, groups=12, dim=16):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(groups, dim)) * 4
    m = middle[rng.integers(0, groups, n)] + rng.normal(size=(n, dim))
    m[7] = 0
    m[9] = m[8]
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id int, vec array<double>")


def nearest(m, k):
    unit = m / np.where((norm := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, norm)
    sims = np.round(unit @ unit.T, 6)
    return [(i, int(j), r + 1) for i in range(len(m)) for r, j in enumerate([j for j in np.lexsort((np.arange(len(m)), -sims[i])) if j != i][:k])]


@pytest.mark.parametrize(("cells", "block"), [(1, 8192), (12, 8192), (40, 25)])
def test_exact_neighbours_by_cells(spark, cells, block):
    m, df = grouped_vectors(spark)
    got = vector.metric_top_k(df, 4, "id", "vec", cells=cells, block_rows=block)
    assert rows(got, "query_id", "id", "rank") == sorted(nearest(m, 4))


def test_cells_out_of_reach_are_not_visited(spark):
    _, df = grouped_vectors(spark)
    placed, centres = vector.metric_cells(df, "id", "vec", 12)
    exact = vector.knn_exact(df, df, 4, "id", "vec", "id", "vec", not_self=True).groupBy("query_id").agg((1 - F.max("distance")).alias("bar"))
    radii = {r.cell: (r.near, r.far) for r in placed.groupBy("cell").agg(F.min("away").alias("near"), F.max("away").alias("far")).collect()}
    asks = vector.cell_asks(placed, exact, centres, radii, "id").count()
    assert asks < 600 * 11 / 4


@pytest.mark.parametrize("visit", [1500, 9000])
def test_cells_travel_in_slices_and_a_crowd_is_split(spark, visit):
    m, _ = grouped_vectors(spark)
    m[100:300] = m[100]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id int, vec array<double>")
    got = vector.metric_top_k(df, 4, "id", "vec", cells=12, visit_bytes=visit)
    assert rows(got, "query_id", "id", "rank") == sorted(nearest(m, 4))
    placed, _ = vector.metric_cells(df, "id", "vec", 12)
    slices = vector._slices(placed, visit)
    size = 8 * m.shape[1]
    held = [placed.filter(F.col("cell").between(a, b) & (F.pmod(F.xxhash64("id"), F.lit(n)) == part)).count() for (a, b), part, n in slices]
    assert sum(held) == len(m) and len(slices) > 3 and max(held) * size < 3 * visit


def test_quantised_index_recall_and_stored_cells(spark, tmp_path):
    m, df = grouped_vectors(spark, 1500, 20)
    assigned, centres = vector.ann_index(df, 16, "id", "vec")
    vector.quantised(assigned, centres, "id", "vec").write(str(tmp_path / "q"))
    index = vector.QuantisedIndex.read(spark, str(tmp_path / "q"), "id", "vec")
    asked = df.filter("id % 10 = 1")
    want = {(r.query_id, r.id) for r in vector.knn_exact(df, asked, 10, "id", "vec", "id", "vec").collect()}
    found = vector.quantised_search(index, asked, 10, nprobe=8, query_id="id", query_vec="vec", block_rows=200)
    got = {(r.query_id, r.id) for r in found.collect()}
    assert len(got & want) / len(want) >= 0.95
    every = vector.quantised_search(index, asked, 10, nprobe=16, query_id="id", query_vec="vec")
    assert len({(r.query_id, r.id) for r in every.collect()} & want) / len(want) >= 0.99
    assert index.codes.schema["code"].dataType.simpleString() == "array<tinyint>"


# ------------------------------------------------------------ names


def test_many_names_are_found_in_one_pass(spark, monkeypatch):
    rnd = random.Random(6)
    letters = "abAé語_ "
    texts = [("".join(rnd.choices(letters, k=rnd.randint(0, 400))), "".join(rnd.choices(letters, k=9)), i) for i in range(60)] + [(None, "ab", 60), ("x" * 5000 + "langer name" * 50, None, 61)]
    needles = sorted({"".join(rnd.choices("abAé語", k=rnd.randint(1, 7))) for _ in range(120)}) + ["", "x" * 700, "langer name"]
    a = spark.createDataFrame(texts, "one string, two string, text_id int")
    b = spark.createDataFrame([(n,) for n in needles] + [(None,)], "needle string")
    monkeypatch.setattr(names, "LEAST_BITS", 8)  # many strings pass the filter that are no names
    found = names.name_counts(a, ["one", "two"], ["text_id"], b, slice_bytes=1)
    want = {}
    for one, two, i in texts:
        for n in needles:
            counts = [(t or "").lower().count(n.lower()) for t in (one, two)] if n else [0]
            if any(counts):
                want[i, n] = counts
    got = found.collect()
    assert {(r.text_id, r.needle): r.counts for r in got} == want and len(got) == len(want)
    assert "MapInArrow" in (plan := found._jdf.queryExecution().executedPlan().toString()) and plan.count("mapInArrow") + plan.count("MapInArrow") < 4 and "Union" not in plan


def test_texts_are_looked_at_in_windows(spark, monkeypatch):
    wanted = ["ab", "abc", "é", "x" * 300, "語ab語", "q"]
    filters = names._filters(spark.createDataFrame([(n,) for n in wanted], "low string"), len(wanted))
    monkeypatch.setattr(names, "WINDOW", 16)
    texts = ["abcab" * 9 + "語ab語" * 5, None, "", "é" * 40 + "x" * 305 + "q", "a", "b"]
    found, first = {}, np.cumsum([0] + [len((x or "").encode()) for x in texts])
    for row, at, string in names._likely(pa.array(texts), filters):
        if (word := string.decode()) in wanted:
            found.setdefault((row, word), []).append(at - first[row])
    want = {(i, w): [at for at in range(len(t)) if t.startswith(w.encode(), at)] for i, x in enumerate(texts) for t in [(x or "").encode()] for w in wanted}
    assert found == {k: v for k, v in want.items() if v}


def test_names_in_slices_find_all(spark):
    rnd = random.Random(3)
    texts = [("".join(rnd.choices("abAB ", k=rnd.randint(0, 30))), i) for i in range(150)] + [(None, 150)]
    needles = sorted({"".join(rnd.choices("abA", k=rnd.randint(1, 4))) for _ in range(40)}) + [""]
    a = spark.createDataFrame(texts, "text string, text_id int")
    b = spark.createDataFrame([(n,) for n in needles] + [(None,)], "needle string")
    want = sorted((i, n) for t, i in texts for n in needles if t and n and n.lower() in t.lower())
    assert rows(names.substring_pairs(a, b), "text_id", "needle") == want
    assert rows(names.substring_pairs(a, b, slice_bytes=900), "text_id", "needle") == want
    counted = {(r.text_id, r.needle): r.counts for r in names.name_counts(a, ["text"], ["text_id"], b).collect()}
    assert counted == {(i, n): [texts[i][0].lower().count(n.lower())] for i, n in want}


def test_texts_stay_where_they_are(spark):
    sections = spark.createDataFrame([(1, "The parse_file call", "parse_file reads; parse_file ends. It returns", "docs/readme.md")], "section_id int, title string, content string, file_path string")
    ents = spark.createDataFrame([("e", "parse_file", "function", "docs/a.py"), ("f", "FileReader", "class", "src/b.py")], "id string, name string, kind string, file_path string")
    found = documents.doc_code_edges(sections, ents)
    assert rows(found) == [(1, "e", 1.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "content" in line]


# ------------------------------------------------------------ components and closures


def slow_components(edges):
    nodes = sorted({x for e in edges for x in e})
    out = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            out[a] = out[a] | out[b]
    return sorted((n, min(m for m in nodes if m in out[n] and n in out[m])) for n in nodes)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = {(rnd.randrange(40), rnd.randrange(40)) for _ in range([30, 55, 90][seed - 1])}
    got = graph.strong_components(spark.createDataFrame(sorted(edges), "src int, dst int"))
    assert rows(got) == slow_components(edges)


def test_components_of_long_lines_and_rings(spark):
    line = [(i, i + 1) for i in range(1500)]
    ring = [(2000 + i, 2000 + (i + 1) % 700) for i in range(700)]
    tied = [(1400, 1000), (2005, 5)]
    got = dict(rows(graph.strong_components(spark.createDataFrame(line + ring + tied + [(9999, 9999)], "src int, dst int"))))
    assert all(got[i] == (1000 if 1000 <= i <= 1400 else i) for i in range(1501))
    assert {got[2000 + i] for i in range(700)} == {2000} and got[9999] == 9999


def test_components_of_nothing(spark):
    assert graph.strong_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_module_links_flag_cycles_of_any_length(spark):
    files = spark.createDataFrame([("a/x",)], "file_path string")
    smells = spark.createDataFrame([], "file_path string, severity string")
    imports = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")], "src string, dst string")
    links = graph.module_graph(files, imports, smells)[1]
    assert {(r.src, r.dst): (r.mutual, r.circular) for r in links.collect()} == {
        ("a", "b"): (False, True), ("b", "c"): (False, True), ("c", "a"): (False, True), ("c", "d"): (False, False), ("e", "e"): (True, True),
    }


@pytest.mark.parametrize("merges", [[], [(i, i - 9) for i in range(9, 700, 5)]])
def test_ancestors_in_doubling_rounds(spark, monkeypatch, merges):
    parents = spark.createDataFrame([(i, i - 1) for i in range(1, 700)] + merges + [(5000, 5001), (5001, 5000)], "src int, dst int")
    starts = spark.createDataFrame([(699,), (3,), (5000,), (7777,)], "start int")
    written = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df: written.append(1) or cut_lineage(df))
    got = rows(graph.ancestors(parents, starts))
    assert got == sorted([(699, i) for i in range(700)] + [(3, i) for i in range(4)] + [(5000, 5000), (5000, 5001), (7777, 7777)])
    # one table a doubling for the jumps and one for taking them, and six around; with merges every fifth node they are taken some times more
    doublings = (700).bit_length() + 2
    assert len(written) <= (2 * doublings + 6 if not merges else 5 * doublings + 6)


def test_ancestors_over_shortened_lines(spark, monkeypatch):
    rnd = random.Random(4)
    parents = {(i, i - 1) for i in range(1, 300)} | {(i, i - 9) for i in range(9, 300, 7)} | {(1000 + i, rnd.randrange(300)) for i in range(100)}
    parents |= {(2000 + i, 2000 + (i + 1) % 30) for i in range(30)} | {(3000, 3000), (4000, 2007), (4001, 4000)} | {(5000 + i, rnd.randrange(5000, 5000 + i)) for i in range(1, 120)}
    starts = [299, 120, 3, 0, 1005, 1050, 2003, 3000, 4001, 5119, 5118, 9999]
    monkeypatch.setattr(graph, "LINE_ROWS", 20)
    got = rows(graph.ancestors(spark.createDataFrame(sorted(parents), "src int, dst long"), spark.createDataFrame([(s,) for s in starts], "start int")))
    want = set()
    for start in starts:
        seen, todo = {start}, [start]
        while todo:
            at = todo.pop()
            more = {d for s, d in parents if s == at} - seen
            seen |= more
            todo += more
        want |= {(start, n) for n in seen}
    assert got == sorted(want)


def test_what_a_shortened_line_moves_grows_with_its_length(spark, monkeypatch):
    monkeypatch.setattr(graph, "LINE_ROWS", 100)
    sizes = []
    for n in (1000, 4000):
        line = cut_lineage(spark.range(1, n).selectExpr("id AS src", "id - 1 AS dst"))
        levels, rest = graph._shortened(line)
        assert rest.count() <= 100
        sizes.append(sum(level.count() for _, level in levels))
    assert sizes[1] <= 5 * sizes[0] and sizes[1] <= 4 * 4000


def test_callers_as_of_a_commit(spark):
    ents = spark.createDataFrame([("f", "f", 1), ("g", "g", 2), ("h", "h", 3), ("x", "x", None), ("t", "target", 1)], "id string, name string, commit int")
    edges = spark.createDataFrame([("f", "t"), ("g", "t"), ("h", "t"), ("x", "t"), ("t", "f")], "src string, dst string")
    parents = spark.createDataFrame([(2, 1), (3, 2), (9, 1)], "commit int, parent int")
    asked = spark.createDataFrame([(2, "target"), (9, "target"), (3, "f")], "start int, callee_name string")
    got = rows(graph.callers_at_commit(edges, ents, parents, asked))
    assert got == [(2, "target", "f", "f", 1), (2, "target", "g", "g", 2), (3, "f", "t", "target", 1), (9, "target", "f", "f", 1)]


# ------------------------------------------------------------ trees


def test_common_ancestors_by_intervals(spark):
    rnd = random.Random(8)
    parent = {i: rnd.randrange(max(0, i - 6), i) for i in range(1, 120) if i != 60}
    edges = spark.createDataFrame([(p, c) for c, p in parent.items()], "src int, dst int")
    known = sorted({*parent, *parent.values()})
    pairs = [(rnd.choice(known), rnd.choice(known)) for _ in range(200)]

    def way(n):
        out = [n]
        while out[-1] in parent:
            out.append(parent[out[-1]])
        return out

    deepest = max(len(way(n)) - 1 for n in known)
    want = {}
    for a, b in pairs:
        shared = [x for x in way(a) if x in way(b)]
        da, db = len(way(a)) - 1, len(way(b)) - 1
        if shared:
            dl = len(way(shared[0])) - 1
            penalty = da + db - 2 * dl + 0.5 * abs(da - db)
            want[a, b] = (shared[0], penalty, round(max(0, 1 - penalty / (2 * deepest)), 6))
        else:
            want[a, b] = (None, None, 0.0)
    tree = graph.tree_labels(edges)
    got = {(r.a, r.b): (r.lca, r.penalty, r.resonance) for r in graph.lca_score(tree, spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == want
    below = rows(graph.descendants(tree, spark.createDataFrame(sorted(set(pairs)), "a int, b int")))
    assert below == sorted((a, b) for a, b in set(pairs) if a in way(b))


def test_labels_of_a_deep_line(spark):
    n = 10_000
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    tree = graph.tree_labels(edges)
    assert len(tree.jumps) == 14
    facts = tree.labels.agg(F.min("depth"), F.max("depth"), F.count("*"), F.count_distinct("first")).first()
    assert tuple(facts) == (0, n, n + 1, n + 1)
    pairs = spark.createDataFrame([(9999, 4321), (0, 10_000), (7, 7)], "a long, b long")
    assert rows(graph.lca_score(tree, pairs), "a", "b", "lca") == [(0, 10_000, 0), (7, 7, 7), (9999, 4321, 4321)]


def test_labels_with_several_parents_and_rings(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("x", "y"), ("y", "x"), ("a", "a")], "src string, dst string")
    got = {r.node: (r.parent, r.depth) for r in graph.tree_labels(edges).labels.collect()}
    assert got == {"r": (None, 0), "a": ("r", 1), "b": ("r", 1), "c": ("a", 2)}


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    from siftwell.sources import tables

    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "65536")
    try:
        rows_ = spark.range(0, 100_000, numPartitions=8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
        tables.write_keyed(rows_, str(tmp_path / "t"), "id", 1)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "t" / "_bucket=0").glob("*.parquet"))) > 4
    stored = tables.read_keyed(spark, str(tmp_path / "t"))
    assert stored.count() == stored.select("id").distinct().count() == 100_000


def test_text_files_lie_in_few_folders(spark, monkeypatch):
    import glob

    from siftwell.catalog import table_queries

    seen, load = [], table_queries.tables.load_text_files
    monkeypatch.setattr(table_queries.tables, "load_text_files", lambda s, path: seen.append(path) or load(s, path))
    got = {r.lang: r.files for r in table_queries.load_text_files(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.col("text").rlike(r"\S"))
    assert got == {r.lang: r.files for r in docs.groupBy("lang").agg(F.count("*").alias("files")).collect()}
    root = seen[0].removesuffix("/*/*").removeprefix("file:")
    assert len(glob.glob(f"{root}/*/*/")) <= 32 and len(glob.glob(f"{root}/*/*/*.txt")) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_a_task_packs_about_one_bucket(spark):
    postings = spark.range(60).selectExpr("concat('c', lpad(string((id * 7) % 60), 2, '0')) AS chunk_id", "'x' AS term", "id % 3 + 1 AS tf", "4L AS dl")
    index = lexical.Bm25Index(postings, spark.createDataFrame([("x", 1.0, 4.0)], "term string, idf double, avgdl double"))
    blocks = lexical.bm25_blocks(index, chunks_per_bucket=2, materialize=False)
    assert blocks.buckets == 30 and blocks.lists.rdd.getNumPartitions() == 30
    rows = blocks.lists.collect()
    ids = {r.bucket: r.ids for r in rows if r.term is None}
    assert all(own == sorted(own) for own in ids.values()) and sorted(i for own in ids.values() for i in own) == sorted(r.chunk_id for r in postings.collect())
    tf = {r.chunk_id: r.tf for r in postings.collect()}
    for r in rows:
        if r.term is not None:
            assert r.slots == sorted(r.slots) and [round(w, 9) for w in r.weights] == [round(tf[ids[r.bucket][s]] * 2.5 / (tf[ids[r.bucket][s]] + 1.5), 9) for s in r.slots]


def test_every_hit_is_scored_by_bucket_and_ranked_by_parts(spark, corpus, monkeypatch):
    index, asked = corpus
    monkeypatch.setattr(lexical, "MAX_ASKED_ROWS", 0)
    want = rows(lexical.bm25_scores(index, asked), "query_id", "chunk_id", "score")
    monkeypatch.undo()
    monkeypatch.setattr(lexical, "BUCKET_CHUNKS", 100)
    hits = lexical.bm25_scores(index, asked)
    assert rows(hits, "query_id", "chunk_id", "score") == want
    assert "Join" not in [line for line in hits._jdf.queryExecution().executedPlan().toString().splitlines() if "MapInArrow" in line][0]
    assert "HashAggregate" not in hits._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(bucket")[0]
    monkeypatch.setattr(lexical, "RANKED_ROWS", 50)
    monkeypatch.setattr(lexical, "PACKED_HITS", 300)
    by_query = {}
    for q, c, s in want:
        by_query.setdefault(q, []).append((-s, c))
    ranks = sorted((q, c, -s, i) for q, own in by_query.items() for i, (s, c) in enumerate(sorted(own), 1))
    assert rows(lexical.assign_rank(hits), "query_id", "chunk_id", "score", "rank") == ranks


def test_ranks_of_odd_scores(spark, monkeypatch):
    monkeypatch.setattr(lexical, "RANKED_ROWS", 2)
    made = [(None, "a", 1.0, [1]), ("q", "b", None, None), ("q", "a", float("nan"), []), ("q", "é", -2.5, [2]), ("q", "c", 0.1234567891, [3]), ("q", "", 0.1234567891, [4]), ("q", "z", 1e300, [5])]
    df = spark.createDataFrame(made, "query_id string, chunk_id string, score double, more array<int>")
    got = {(r.query_id, r.chunk_id): (r["rank"], r.more) for r in lexical.assign_rank(df).collect()}
    assert got == {(None, "a"): (1, [1]), ("q", "b"): (1, None), ("q", "z"): (2, [5]), ("q", ""): (3, [4]), ("q", "c"): (4, [3]), ("q", "é"): (5, [2]), ("q", "a"): (6, [])}
