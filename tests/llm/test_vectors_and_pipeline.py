"""Embedding near-duplicates and the pipeline against brute force; registration and oracles of the corpus queries."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from siftwell.llm import embeddings, simhash
from tools.check import rows_of

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, unit string, n_links string"


def slow_links(rows, cosine=0.98):
    units = []
    for _, v, label, *_ in rows:
        x = np.array(v if v is not None else [], float)
        ok = label is not None and len(x) and np.isfinite(x).all() and (x != 0).any()
        units.append(x / np.linalg.norm(x) if ok else None)
    near = lambda i, j: i != j and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine
    links = [[j for j in range(len(rows)) if near(i, j)] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
    return links, root


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    rows = [(i, (base[i % 30] + 0.06 * rng.standard_normal(16) * (i % 4)).astype(np.float32).tolist(), i % 30 % 3) for i in range(300)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, rows[0][1], None), (305, [], 1), (306, [1.0] * 4, 1), (307, [2.0] * 4, 1), (308, [float("inf")] + [1.0] * 15, 1)]
    rows.append(rows[5])
    out = embeddings.near_duplicates(spark.createDataFrame([(*r, "u", "n") for r in rows], VECTORS)).collect()
    links, root = slow_links(rows)
    want = sorted((r[0], len(links[i]), rows[root[i]][0]) for i, r in enumerate(rows))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_dense_group_is_counted_across_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (np.ones(8) + 0.001 * rng.standard_normal(8)).tolist(), 1, "u", "n") for i in range(120)]
    members = spark.createDataFrame([(7, r[0], (np.array(r[1]) / np.linalg.norm(r[1])).tolist(), 1 + r[0] % 2) for r in rows], "root long, node long, unit array<double>, n long")
    got = {r.node: r.n_links for r in embeddings.link_counts(members, 8, 0.98, block=25).collect()}
    assert got == {i: 180 - (1 + i % 2) for i in range(120)}


def test_registry():
    names = [n for n in contract.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in contract.queries() and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["op2_decontamination", "op4_sharding", "op9_source_mixing", "op11_fill_in_middle", "op13_merkle_manifest"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = contract.queries()[name](spark, FOLDER)
    cur = con.execute(contract.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("op1_simhash_near_dedup", ["doc_id", "fingerprint", "component_id"]),
        ("op3_substring_dedup", ["doc_id", "text", "n_units", "n_removed", "removed", "kept"]),
        ("op5_language_id", ["doc_id", "held_out", "lang_pred", "score"]),
        ("op6_secret_scan", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]),
        ("op7_embedding_near_dedup", ["vec_id", "n_links", "component_id", "kept"]),
        ("op8_toxicity", ["doc_id", "severity", "grade", "toxic_chance", "toxic"]),
        ("op10_quality_classifier", ["doc_id", "weak_label", "quality", "kept"]),
        ("op12_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    ],
)
def test_query_covers_its_whole_table(spark, name, columns):
    df = contract.queries()[name](spark, FOLDER)
    source = "embeddings" if "embedding" in name else "documents"
    assert df.columns[: len(columns)] == columns and df.count() == spark.read.parquet(f"{FOLDER}/{source}.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "source_mixing", "sharding"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, FOLDER)
        rows = {r.doc_id: r for r in after.collect()}
        was = {r.doc_id: r for r in before.collect()}
        assert set(rows) <= set(was) and len(rows) == after.count() and all(rows[d].text == was[d].text for d in rows)
        if name != "sharding":
            assert after.columns == docs.columns
        if name == "toxicity":
            assert not [d for d in was if d not in rows and labels.get(d) == 0]
        if name == "simhash_near_dedup":
            shingles = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, r in was.items() for w in [r.text.lower().split()]}
            close = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
            assert not [(a, b) for a in rows for b in rows if a < b and close(a, b)]
            assert all(any(close(d, o) for o in was if o != d) for d in was if d not in rows)
        if name == "sharding":
            assert set(rows) == set(was)
        before = spark.createDataFrame(list(rows.values()), after.schema)
    again = {r.doc_id: r["shard"] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert again == {d: r["shard"] for d, r in rows.items()}


def test_pipeline_over_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


def test_near_copies_are_found_in_a_crowd_of_equal_words(spark):
    import random

    rnd, words = random.Random(5), [f"word{i}" for i in range(60)]
    texts = [" ".join(rnd.sample(words, len(words))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, " ".join([*t.split()[1:], t.split()[0]])) for i, t in enumerate(texts[:20])]
    kept = {r.doc_id for r in simhash.one_per_group(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8).collect()}
    assert kept == set(range(600))


def test_simhash_offers_each_text_its_group(spark):
    import random

    rnd = random.Random(3)
    long = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(3000)) for _ in range(3)]
    rows = [(i * 10 + j, t + (f" tail{j}" if j else "")) for i, t in enumerate(long) for j in range(4)] + [(900, None)]
    nodes = simhash.distinct_texts(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8)
    own = {r.node: r for r in nodes.collect()}
    assert all(simhash.set_fingerprint(simhash.shingle_set(dict(rows)[r.doc_id].encode(), 5)) == r.fingerprint for r in own.values() if r.n)
    bits = lambda x, y: ((own[x].fingerprint ^ own[y].fingerprint) & (2**64 - 1)).bit_count()
    pairs = {(r.a, r.b) for r in simhash.simhash_pairs(nodes).collect()}
    assert pairs and all(own[a].doc_id // 10 == own[b].doc_id // 10 for a, b in pairs) and len({a for a, _ in pairs}) == len(pairs)
    assert {a for a, _ in pairs} >= {x for x in own for y in own if y < x and own[x].n and own[y].n and bits(x, y) <= simhash.STAR_BITS}


def test_a_crowd_of_near_copies_leaves_few_other_pairs_and_the_same_groups(spark, monkeypatch):
    import random

    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(200):
        own = list(base)
        for at in rnd.sample(range(150), 1 if i < 40 else 4):
            own[at] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    first = list(range(200))
    for a in range(200):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and first[a] != first[b]:
                low, high = sorted((first[a], first[b]))
                first = [low if x == high else x for x in first]
    made = {}
    for name in ("missed_pairs", "distinct_texts"):
        monkeypatch.setattr(simhash, name, lambda *args, name=name, real=getattr(simhash, name): made.setdefault(name, real(*args)))
    monkeypatch.setattr(simhash, "drop_written", lambda *tables: None)
    kept = {r.doc_id for r in simhash.one_per_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 0.8).collect()}
    assert kept == set(first) and 1 < len(kept) < 200
    own = {r.node: sets[r.doc_id] for r in made["distinct_texts"].collect()}
    left = [(own[r.a], own[r.b]) for r in made["missed_pairs"].collect()]
    assert sum(len(x & y) < 0.8 * len(x | y) for x, y in left) <= 120


def test_parities_differ_in_no_more_bits_than_sets_in_shingles():
    rnd = np.random.default_rng(4)
    for size, apart in ((0, 3), (50, 0), (150, 20), (4000, 700)):
        one = rnd.integers(0, 2**64, size, np.uint64)
        other = np.concatenate([one[apart // 2 :], rnd.integers(0, 2**64, apart, np.uint64)])
        differ = np.bitwise_count((simhash.parities(one) ^ simhash.parities(other)).view(np.uint64)).sum()
        assert differ <= len(set(one.tolist()) ^ set(other.tolist())) and (apart > 0) == (differ > 0)


def test_block_pairs_of_a_component_are_dealt_out(spark):
    members = spark.createDataFrame([(1, i, [1.0, i / 1000.0], 1) for i in range(40)] + [(2, 100, [0.0, 1.0], 1), (2, 101, [0.0, 1.0], 2)], "root long, node long, unit array<double>, n long")
    counted = embeddings.link_counts(members, 2, 0.9, 8)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(root" in plan and any("Exchange" in line and "root" in line and "p#" in line and "q#" in line for line in plan.splitlines())
    assert {r.node: r.n_links for r in counted.collect()} == {r.node: r.n_links for r in embeddings.link_counts(members, 2, 0.9).collect()}


def test_pipeline_with_null_texts_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = docs.limit(60).unionAll(docs.limit(5)).unionAll(docs.limit(3).withColumn("text", F.lit(None).cast("string"))).unionAll(
        docs.limit(2).withColumn("text", F.lit(" \n")).withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string"))
    )
    rows = odd.count()
    for name, stage in corpus_pipeline.STAGES:
        odd = spark.createDataFrame(stage(spark, odd, FOLDER).collect(), stage(spark, odd, FOLDER).schema)
        assert 0 < odd.count() <= rows, name
        rows = odd.count()
        if name == "simhash_near_dedup":
            assert odd.count() == odd.select("text").distinct().count()
            assert odd.where("text is null or trim(text) = ''").count() <= 1
