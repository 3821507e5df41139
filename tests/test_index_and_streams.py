"""A stored index under changes, keyed tables, quiet files in a stream, overlapping ranges, plug-ins."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftwell.operators import chunking, joins, lexical, vector
from siftwell.plans.index import StoredIndex, file_hash
from siftwell.sources import tables
from siftwell.streaming import changes


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


# ------------------------------------------------------------ keyed tables


def test_keyed_tables_replace_and_drop_keys(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.write_keyed(spark.createDataFrame([(f"k{i}", i) for i in range(40)] + [("k1", 100)], "key string, n int"), root, "key", 5)
    tables.upsert_keyed(spark.createDataFrame([("k1", 7, 1.5), ("new", 8, 2.5)], "key string, n int, more double"), root, "key", gone=spark.createDataFrame([("k2",), ("none",)], "key string"))
    want = sorted([(f"k{i}", i) for i in range(40) if i not in (1, 2)] + [("k1", 7), ("new", 8)])
    assert rows(tables.read_keyed(spark, root)) == want
    every = spark.createDataFrame([(k,) for k, _ in want], "key string")
    tables.upsert_keyed(spark.createDataFrame([], "key string, n int"), root, "key", gone=every)
    assert tables.read_keyed(spark, root).count() == 0


def test_only_touched_folders_are_written(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.write_keyed(spark.range(200).select(F.col("id").cast("string").alias("key"), "id"), root, "key", 10)
    files = lambda: {f.rsplit("/", 2)[1]: f for f in spark.read.parquet(root).inputFiles()}
    before = files()
    tables.upsert_keyed(spark.createDataFrame([("5", 50)], "key string, id long"), root, "key")
    after = files()
    assert sum(before[b] != after[b] for b in before) == 1
    assert tables.read_keyed(spark, root).filter("key = '5'").first()["id"] == 50


# ------------------------------------------------------------ stored index


def stored(spark, root):
    cut = lambda files: chunking.chunk_text(files.select("file_path", "text"), mode="lines")
    embed = lambda texts: vector.hash_vectors(texts, "chunk_id", "doc_text", 16)
    return StoredIndex(spark, root, cut, lexical.document_text(F.col("content"), path=F.col("file_path")), embed, 4)


def as_files(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "file_path string, text string").withColumn("file_hash", file_hash(F.col("text")))


@pytest.mark.parametrize("seed", [1, 2])
def test_index_after_changes_equals_a_rebuild(spark, tmp_path, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    text = lambda: "\n".join(" ".join(rnd.choices(words, k=5)) for _ in range(rnd.randint(1, 60)))
    state = {f"f{i}.txt": text() for i in range(12)}
    index = stored(spark, str(tmp_path / "ix"))
    assert index.update(as_files(spark, state)).filter("change = 'new'").count() == 12
    for _ in range(2):
        for f in rnd.sample(sorted(state), 3):
            state[f] = text()
        for f in rnd.sample(sorted(state), 2):
            del state[f]
        state[f"g{rnd.random()}.txt"] = text()
        state["same.txt"] = state.get("f1.txt", "w1 w2")
        index.update(as_files(spark, state))
    assert index.update(as_files(spark, state)).count() == 0
    fresh = stored(spark, str(tmp_path / "fresh"))
    fresh.update(as_files(spark, state))
    for name, columns in (("files", None), ("chunks", None), ("postings", None), ("terms", None), ("vectors", None)):
        a, b = index.read(name), fresh.read(name)
        assert rows(a.select(*sorted(a.columns))) == rows(b.select(*sorted(b.columns))), name
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w9"), (3, "same f1")], "query_id int, text string")
    assert rows(lexical.bm25_search(index.lexical_index(), asked, 5)) == rows(lexical.bm25_search(fresh.lexical_index(), asked, 5))
    fresh.rebuild(as_files(spark, state))
    assert rows(fresh.read("terms")) == rows(index.read("terms"))


# ------------------------------------------------------------ quiet files


def test_quiet_files_leave_a_stream_as_they_leave_a_table(spark, tmp_path):
    rnd = random.Random(6)
    start = datetime(2024, 1, 1)
    events, clock = [], {f"f{i}": 0.0 for i in range(6)}
    for n in range(240):
        f = rnd.choice(sorted(clock))
        clock[f] = max(clock[f], n * 2.0) + rnd.choice([1, 3, 40])
        events.append((n, start + timedelta(seconds=clock[f]), f, rnd.choice(["modified", "deleted", "created"])))
    events.sort(key=lambda e: e[1])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    folder, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    schema = "event_id long, ts timestamp, file_path string, event_type string"
    parts = [events[i : i + 30] for i in range(0, len(events), 30)]

    def run() -> None:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        due = changes.due_changes(stream, 10, "0 seconds")
        due.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        if i in (3, len(parts) - 1):
            run()
    late = [(9000, events[40][1], events[40][2], "deleted")]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(folder)
    last = max(e[1] for e in events) + timedelta(hours=1)
    spark.createDataFrame([(9999, last, "end", "created")], schema).coalesce(1).write.mode("append").parquet(folder)
    run()
    got = {r for r in rows(spark.read.parquet(out), "file_path", "event_type", "start", "last", "event_id", "events") if r[0] != "end"}
    want = set(rows(changes.due_batch(spark.createDataFrame(events, schema), 10), "file_path", "event_type", "start", "last", "event_id", "events"))
    assert got == want


# ------------------------------------------------------------ overlapping ranges


def greedy(ranges):
    kept = []
    for r in sorted(ranges, key=lambda r: (-r[2], r[0], r[1])):
        if not any(r[0] <= k[1] and k[0] <= r[1] for k in kept):
            kept.append(r)
    return sorted(kept)


def test_large_islands_are_settled_in_few_rounds(spark, monkeypatch):
    rnd = random.Random(9)
    ranges = [(a := rnd.randint(1, 3000), a + rnd.randint(0, 40), rnd.random()) for _ in range(1500)] + [(1, 4000, 0.5), (7, 7, 2.0), (0, 0, 1.0)]
    df = spark.createDataFrame([(1, "f", *r) for r in ranges] + [(2, "f", 5, 9, 1.0), (2, "f", 9, 12, 0.5)], "claim_id int, file_path string, start_line int, end_line int, score double")
    rounds = []
    found = joins._best_overlapping
    monkeypatch.setattr(joins, "_best_overlapping", lambda *a: rounds.append(1) or found(*a))
    got = [tuple(r)[2:] for r in joins.overlap_dedup(df, hot=20).collect() if r.claim_id == 1]
    assert sorted(got) == sorted(greedy([r for r in ranges if r[:2] != (0, 0)]) + [(0, 0, 1.0)])
    assert len(rounds) / 2 <= 11
    assert rows(joins.overlap_dedup(df, hot=20).filter("claim_id = 2"), "start_line", "end_line") == [(5, 9)]


def test_small_islands_are_swept_without_python(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, "a", 1, 10, nan), (1, "a", 5, 12, 0.5), (1, "a", 12, 20, None), (1, "a", 21, 30, nan), (1, "a", 25, 26, 0.1), (1, "b", 3, 4, 0.2)], "claim_id int, file_path string, start_line int, end_line int, score double")
    found = joins.overlap_dedup(df)
    assert rows(found, "file_path", "start_line", "end_line") == [("a", 5, 12), ("a", 25, 26), ("b", 3, 4)]
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
