"""Join, source, streaming, extension and search queries."""

from pyspark.sql import functions as F

from siftwell.catalog import standins as st
from siftwell.catalog.graph_queries import entities
from siftwell.catalog.metric_queries import page_paths
from siftwell.catalog.registry import query
from siftwell.functions import extensions as ext
from siftwell.functions import pycode
from siftwell.operators import joins, lexical, vector
from siftwell.plans import search as sp
from siftwell.runtime import scratch_path
from siftwell.sources import formats, tables
from siftwell.streaming import changes

# ------------------------------------------------------------------ joins


@query("unembedded_chunks", f"WITH {st.CHUNKS} SELECT chunk_id FROM chunks WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def unembedded_chunks(spark, d):
    v = st.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    c = st.chunks(spark, d)
    return joins.unembedded_chunks(c, c.join(v, "doc_id").select("chunk_id"))


def two_versions(spark, d):
    """(current, indexed): documents with changed, vanished, new and renamed files."""
    f = st.files(spark, d).withColumn("file_hash", F.md5(F.col("text").cast("binary")))
    k = F.col("source")
    indexed = f.filter(k != "src1").select("file_path", "file_hash", "text")
    current = f.filter(k != "src2").select(
        F.when(k == "src3", F.concat(F.lit("moved/"), "file_path")).otherwise(F.col("file_path")).alias("file_path"),
        F.when(k == "src4", F.md5(F.concat("text", F.lit("x")).cast("binary"))).otherwise(F.col("file_hash")).alias("file_hash"),
        F.when(k == "src4", F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"),
    )
    return current, indexed


TWO = st.FILES + """,
idx AS (SELECT file_path, md5(text) AS file_hash, text FROM files WHERE source <> 'src1'),
cur AS (SELECT CASE WHEN source = 'src3' THEN 'moved/' || file_path ELSE file_path END AS file_path, md5(CASE WHEN source = 'src4' THEN text || 'x' ELSE text END) AS file_hash,
  CASE WHEN source = 'src4' THEN text || 'x' ELSE text END AS text FROM files WHERE source <> 'src2'),
orphan AS (SELECT file_path, file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY file_path) AS r, count(*) OVER (PARTITION BY file_hash) AS n FROM idx WHERE file_path NOT IN (SELECT file_path FROM cur)),
fresh AS (SELECT file_path, file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY file_path) AS r, count(*) OVER (PARTITION BY file_hash) AS n FROM cur WHERE file_path NOT IN (SELECT file_path FROM idx)),
moves AS (SELECT o.file_path AS old_path, f.file_path AS new_path, o.file_hash FROM orphan o JOIN fresh f ON o.file_hash = f.file_hash AND o.r = f.r AND o.n = f.n)"""


@query(
    "changed_files",
    f"WITH {TWO} SELECT coalesce(c.file_path, i.file_path) AS file_path, CASE WHEN i.file_path IS NULL THEN 'new' WHEN c.file_path IS NULL THEN 'deleted' WHEN c.file_hash <> i.file_hash THEN 'changed' ELSE 'same' END AS change FROM cur c FULL JOIN idx i ON c.file_path = i.file_path",
)
def changed_files(spark, d):
    return joins.changed_files(*two_versions(spark, d))


@query("detect_file_moves", f"WITH {TWO} SELECT * FROM moves")
def detect_file_moves(spark, d):
    return joins.detect_file_moves(*two_versions(spark, d))


@query("stale_entries", f"WITH {TWO} SELECT DISTINCT file_path FROM idx WHERE file_path NOT IN (SELECT file_path FROM cur)")
def stale_entries(spark, d):
    current, indexed = two_versions(spark, d)
    return joins.stale_entries(indexed, current)


def bm25_hits(spark, d, k=20):
    hits = lexical.bm25_search(lexical.bm25_index(st.corpus(spark, d)), st.search_queries(spark, d), k)
    return hits.select("query_id", "chunk_id", "rank")


@query(
    "stale_result_filter",
    f"""WITH {st.BM25_HITS}, h AS (SELECT query_id, chunk_id, rank, file_path, lang = 'en' AS alive FROM bm_rank JOIN chunks USING (chunk_id) WHERE rank <= 20)
    SELECT query_id, chunk_id, rank FROM (SELECT *, bool_or(alive) OVER (PARTITION BY query_id) AS anyone FROM h) WHERE alive OR NOT anyone""",
)
def stale_result_filter(spark, d):
    h = bm25_hits(spark, d).join(st.chunks(spark, d).select("chunk_id", "file_path"), "chunk_id")
    return joins.stale_result_filter(h, st.files(spark, d).filter("lang = 'en'")).select("query_id", "chunk_id", "rank")


@query("hydrate_results", f"WITH {st.BM25_HITS} SELECT query_id, chunk_id, rank, file_path, lang FROM bm_rank JOIN chunks USING (chunk_id) WHERE rank <= 20")
def hydrate_results(spark, d):
    return joins.hydrate_results(bm25_hits(spark, d), st.chunks(spark, d).select("chunk_id", "file_path", "lang"))


def ranges(spark, d):
    return st.table(spark, d, "lineitem").select(
        F.floor(F.col("l_suppkey") / 7).alias("claim_id"), F.concat(F.lit("f"), F.col("l_returnflag")).alias("file_path"), F.floor(F.col("l_partkey") * 3).alias("start_line"),
        F.floor(F.col("l_partkey") * 3 + F.col("l_quantity")).alias("end_line"), (F.col("l_extendedprice") + F.col("l_orderkey") / 1e6).alias("score"),
    )


@query(
    "overlap_dedup",
    """WITH RECURSIVE ev AS (SELECT (l_suppkey // 7)::BIGINT AS claim_id, 'f' || l_returnflag AS file_path, (l_partkey * 3)::BIGINT AS start_line, floor(l_partkey * 3 + l_quantity)::BIGINT AS end_line, max(l_extendedprice + l_orderkey / 1e6)::DOUBLE AS score FROM lineitem GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY claim_id, file_path ORDER BY score DESC, start_line, end_line) AS n, count(*) OVER (PARTITION BY claim_id, file_path) AS size FROM ev),
    g AS (SELECT claim_id, file_path, 0::BIGINT AS n, []::STRUCT(a BIGINT, b BIGINT, s DOUBLE)[] AS kept, any_value(size) AS size FROM o GROUP BY ALL
      UNION ALL SELECT g.claim_id, g.file_path, o.n, CASE WHEN len(list_filter(kept, lambda k: k.a <= end_line AND start_line <= k.b)) > 0 THEN kept ELSE list_append(kept, {'a': start_line, 'b': end_line, 's': score}) END, g.size
      FROM g JOIN o ON o.claim_id = g.claim_id AND o.file_path = g.file_path AND o.n = g.n + 1),
    k AS (SELECT claim_id, file_path, unnest(kept) AS k FROM g WHERE n = size) SELECT claim_id, file_path, k.a AS start_line, k.b AS end_line, k.s AS score FROM k""",
)
def overlap_dedup(spark, d):
    return joins.overlap_dedup(ranges(spark, d), hot=50)


@query(
    "similar_pairs",
    """WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS ws FROM documents),
    d AS (SELECT ws, min(doc_id) AS doc_id, len(ws) AS n FROM w WHERE len(ws) > 0 GROUP BY ws), t AS (SELECT doc_id, n, unnest(ws) AS x FROM d),
    c AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, count(*) AS c, any_value(a.n) AS an, any_value(b.n) AS bn FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY ALL)
    SELECT left_id, right_id, round(c / (an + bn - c), 6) AS jaccard FROM c WHERE c / (an + bn - c) >= 0.8""",
)
def similar_pairs(spark, d):
    t = st.table(spark, d, "documents").select(F.col("doc_id").alias("claim_id"), F.col("text").alias("normalized"))
    return joins.similar_pairs(t, t, 0.8).filter("left_id < right_id")


@query("fuzzy_claim_merge")
def fuzzy_claim_merge(spark, d):
    b = st.table(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("normalized"))
    e = st.table(spark, d, "documents").select((F.col("doc_id") + 1000000).alias("claim_id"), F.col("text").alias("normalized"))
    return joins.fuzzy_claim_merge(b, e, 0.8).select("claim_id")


@query("dedup_chunks", "SELECT source AS chunk_id, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_chunks(spark, d):
    return joins.dedup_chunks(st.table(spark, d, "documents").select(F.col("source").alias("chunk_id"), "doc_id"), ["doc_id"])


@query(
    "shared_file_edges",
    f"""WITH {st.COMMITS}, t AS (SELECT DISTINCT author, path FROM cf), n AS (SELECT author, count(*) AS n FROM t GROUP BY 1),
    s AS (SELECT a.author AS a, b.author AS b, count(*) AS shared FROM t a JOIN t b ON a.path = b.path AND a.author < b.author GROUP BY ALL)
    SELECT a, b, shared, round(shared / greatest(x.n, y.n), 6) AS weight FROM s JOIN n x ON x.author = a JOIN n y ON y.author = b""",
)
def shared_file_edges(spark, d):
    return joins.shared_file_edges(st.commit_files(spark, d))


def cases(spark, d):
    c = F.col("o_custkey").cast("string")
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("test_fn_"), c)).when(F.col("o_orderstatus") == "O", F.concat(F.lit("it_fn_"), c)).otherwise(F.concat(F.lit("Testfn_"), c))
    return st.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), name.alias("name"), F.array(F.concat(F.lit("fn_"), c), F.lit("missing")).alias("fixture_deps"))


@query("tests_edges", f"WITH {st.CODE} SELECT o_orderkey AS case_id, id AS entity FROM orders JOIN ent ON name = 'fn_' || o_custkey WHERE o_orderstatus IN ('F', 'O')")
def tests_edges(spark, d):
    return joins.tests_edges(cases(spark, d), entities(spark, d))


@query("fixture_edges", f"WITH {st.CODE} SELECT o_orderkey AS case_id, id AS entity FROM orders JOIN ent ON name = 'fn_' || o_custkey WHERE kind IN ('function', 'method')")
def fixture_edges(spark, d):
    return joins.fixture_edges(cases(spark, d), entities(spark, d))


@query(
    "coverage_gaps",
    f"WITH {st.CODE} SELECT id, name, file_path FROM ent WHERE name NOT IN (SELECT 'fn_' || o_custkey FROM orders WHERE o_orderstatus <> 'P') AND file_path NOT LIKE '%/promo.py'",
)
def coverage_gaps(spark, d):
    e = entities(spark, d).select("id", "name", "file_path")
    named = cases(spark, d).select(joins.strip_test_prefix(F.col("name")).alias("name"))
    return joins.coverage_gaps(e, named, e.filter(F.endswith("file_path", F.lit("/promo.py"))))


@query(
    "assign_subproject",
    """WITH pp AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS file_path FROM pages)
    SELECT page_id, CASE WHEN contains(file_path, '/fr/') THEN split_part(file_path, '/', 1) || '+fr' ELSE split_part(file_path, '/', 1) END AS subproject FROM pp""",
)
def assign_subproject(spark, d):
    p = page_paths(spark, d).select("page_id", "file_path")
    host = F.split_part("file_path", F.lit("/"), F.lit(1))
    top = p.select(host.alias("prefix"), host.alias("subproject")).distinct()
    fr = p.select(F.concat(host, F.lit("/fr")).alias("prefix"), F.concat(host, F.lit("+fr")).alias("subproject")).distinct()
    return joins.assign_subproject(p, top.unionByName(fr)).select("page_id", "subproject")


# ------------------------------------------------------------------ sources and sinks


@query("load_text_files", f"WITH {st.FILES} SELECT lang, count(*) AS files, sum(len(text))::BIGINT AS characters FROM files WHERE regexp_matches(text, '\\S') GROUP BY 1")
def load_text_files(spark, d):
    path = scratch_path(spark, "texts")
    texts = st.files(spark, d).select("lang", "doc_id", F.col("text").alias("value")).repartition(F.col("doc_id")).withColumn("part", F.spark_partition_id())
    # one file a text, in few folders: a task writes into folders of its own
    texts.drop("doc_id").write.partitionBy("part", "lang").option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    files = tables.load_text_files(spark, f"{path}/*/*")
    body = F.regexp_replace("text", r"\n\z", "")
    return files.groupBy(F.regexp_extract("file_path", "lang=([a-z]+)", 1).alias("lang")).agg(F.count("*").alias("files"), F.sum(F.length(body)).alias("characters"))


@query("write_chunks", f"WITH {st.CHUNKS} SELECT chunk_id, lang AS language, 'pending' AS embedding_status, md5(file_path) AS file_hash FROM chunks")
def write_chunks(spark, d):
    path = scratch_path(spark, "chunks")
    c = st.chunks(spark, d).withColumnRenamed("lang", "language")
    tables.write_chunks(c, path, F.md5(F.col("file_path").cast("binary")), F.lit("2024-01-01").cast("timestamp"))
    return tables.scan_chunks(spark, path).select("chunk_id", "language", "embedding_status", "file_hash")


@query("write_vectors", "SELECT vec_id AS chunk_id, CASE WHEN label < 5 THEN 'm2' ELSE 'm1' END AS model_version, label FROM embeddings")
def write_vectors(spark, d):
    root = scratch_path(spark, "vectors")
    v = st.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").alias("vector"))
    tables.write_vectors(v, root, "m1", F.lit("2024-01-01").cast("timestamp"))
    tables.write_vectors(v.filter("label < 5"), root, "m2", F.lit("2024-01-02").cast("timestamp"))
    return tables.read_keyed(spark, root).select("chunk_id", "model_version", "label")


@query("save_snapshot", f"WITH {st.SNAPSHOTS} SELECT project, ts AS day, total_chunks + (project = (SELECT min(project) FROM snap))::INT AS total_chunks FROM snap")
def save_snapshot(spark, d):
    path = scratch_path(spark, "snapshots")
    s = st.snapshots(spark, d).select("project", F.col("ts").alias("day"), "total_chunks")
    tables.save_snapshot(s, path)
    one = s.join(s.agg(F.min("project").alias("project")), "project", "left_semi")
    tables.save_snapshot(one.withColumn("total_chunks", F.col("total_chunks") + 1), path)
    return spark.read.schema(s.select("total_chunks", "project", "day").schema).parquet(path)


def export_rows(spark, d):
    c = st.chunks(spark, d).select("chunk_id", "file_path", "start_line", "content")
    hits = lexical.bm25_search(lexical.bm25_index(st.corpus(spark, d)), st.search_queries(spark, d), 5)
    return hits.join(c, "chunk_id").select("rank", "file_path", "start_line", "score", "content")


@query("export_results", f"WITH {st.BM25_HITS}, n AS (SELECT count(*) AS n FROM bm_rank WHERE rank <= 5) SELECT 'csv' AS fmt, n AS results FROM n UNION ALL SELECT 'json', n FROM n UNION ALL SELECT 'markdown', n FROM n")
def export_results(spark, d):
    rows = export_rows(spark, d)
    path = scratch_path(spark, "exports")
    for fmt in ("json", "csv", "markdown"):
        formats.export_results(rows.drop("content") if fmt == "csv" else rows, f"{path}/{fmt}", fmt)
    n = spark.read.json(f"{path}/json").agg(F.count("*").alias("results")).select(F.lit("json").alias("fmt"), "results")
    n = n.unionByName(spark.read.option("header", "true").csv(f"{path}/csv").agg(F.count("*").alias("results")).select(F.lit("csv").alias("fmt"), "results"))
    md = spark.read.text(f"{path}/markdown").filter(F.col("value").rlike(r"^## \d+\. .*:\d+$")).agg(F.count("*").alias("results"))
    return n.unionByName(md.select(F.lit("markdown").alias("fmt"), "results"))


@query(
    "export_sarif",
    f"""WITH {st.SMELLS} SELECT replace(lower(name), ' ', '-') AS rule_id, 'warning' AS level, substr(sha256(name || ':' || file_path || ':7:' || metric_value::BIGINT || '.0'), 1, 16) AS fingerprint, file_path AS uri FROM smells""",
)
def export_sarif(spark, d):
    from siftwell.operators import aggregates as ag

    s = ag.detect_smells(st.chunk_metrics(spark, d)).withColumn("location", F.concat("file_path", F.lit(":7")))
    out = formats.sarif_results(s)
    return out.select("rule_id", "level", "fingerprint", F.get_json_object("result", "$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"))


@query(
    "read_commits",
    f"""WITH {st.COMMITS} SELECT sha::VARCHAR AS sha, author::VARCHAR AS author, strftime(ts, '%Y-%m-%d') AS day, files_changed, insertions, deletions FROM commits""",
)
def read_commits(spark, d):
    lines = st.commit_files(spark, d).select("sha", F.concat_ws("\t", F.col("insertions").cast("string"), F.col("deletions").cast("string"), F.col("path")).alias("l"))
    log = st.commits(spark, d).select("sha", "author", "ts", "message").join(lines, "sha", "left")
    head = F.concat_ws("|", F.col("sha").cast("string"), F.lit("h"), "message", F.lit(""), F.col("author").cast("string"), F.lit("a@b"), F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00:00+00:00")))
    text = F.concat(head, F.lit("\n"), F.coalesce("l", F.lit("")), F.lit("\n\n"))
    out = formats.read_commits(log.select(F.concat(text, F.regexp_replace(text, r"^\d+", "x")).alias("text"))).filter("sha <> 'x'")
    return out.groupBy("sha", "author", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        *[F.sum(c).alias(c) for c in ("files_changed", "insertions", "deletions")]
    )


@query(
    "parse_diff_stats",
    """SELECT l_orderkey AS id, 'src/f' || l_partkey || '.py' AS file, l_linenumber AS additions, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS deletions FROM lineitem""",
)
def parse_diff_stats(spark, d):
    f = F.concat(F.lit("src/f"), F.col("l_partkey").cast("string"), F.lit(".py"))
    plus = F.repeat(F.lit("+line\n"), F.col("l_linenumber"))
    minus = F.when(F.col("l_returnflag") == "R", "-x\n-y\n").otherwise("-x\n")
    text = F.concat(F.lit("diff --git a/"), f, F.lit(" b/"), f, F.lit("\n--- a/"), f, F.lit("\n+++ b/"), f, F.lit("\n@@ -1 +1 @@\n"), plus, F.lit(" same\n"), minus)
    return formats.parse_diff_stats(st.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), text.alias("text")), "id")


@query("filter_dependency_commits", f"WITH {st.COMMITS} SELECT sha FROM commits WHERE message NOT LIKE 'Bump%' AND message NOT LIKE 'chore: update%' AND sha % 9 <> 0")
def filter_dependency_commits(spark, d):
    files = F.when(F.col("sha") % 9 == 0, F.array(F.lit("a/yarn.lock"), F.lit("go.mod"))).otherwise(F.array(F.lit("go.mod"), F.lit("a.py")))
    return formats.filter_dependency_commits(st.commits(spark, d).withColumn("files", files)).select("sha")


# ------------------------------------------------------------------ changes over time


def event_rows(spark, d):
    return st.table(spark, d, "events").select("event_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_path"), "event_type")


SESSIONS = """ev AS (SELECT event_id, epoch(ts)::DOUBLE AS t, 'u' || user_id AS file_path FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY file_path ORDER BY t, event_id) <= 7200 THEN 0 ELSE 1 END AS o FROM ev),
s AS (SELECT *, sum(o) OVER (PARTITION BY file_path ORDER BY t, event_id) AS s FROM g)"""


@query("debounce", f"WITH {SESSIONS} SELECT file_path, count(*) AS events, round(min(t), 3) AS start, round(max(t) + 7200, 3) AS finish FROM s GROUP BY file_path, s")
def debounce(spark, d):
    e = event_rows(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = changes.debounce(e, "2 hours")
    return out.select("file_path", "events", F.round(F.col("start").cast("double"), 3).alias("start"), F.round(F.col("end").cast("double"), 3).alias("finish"))


@query("debounce_batch", f"WITH {SESSIONS} SELECT file_path, count(*) AS events, round(min(t), 3) AS start, round(max(t), 3) AS last FROM s GROUP BY file_path, s")
def debounce_batch(spark, d):
    e = event_rows(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return changes.debounce_batch(e, 7200.0).withColumn("start", F.round("start", 3)).withColumn("last", F.round("last", 3))


def change_events(spark, d):
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "purchase", "moved").otherwise("modified")
    return st.table(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_path"), kind.alias("event_type"),
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("new_path"),
    )


WATCHED = """w AS (SELECT event_id, 'u' || user_id AS file_path, CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'deleted' ELSE 'modified' END AS event_type, ts FROM events
  UNION ALL SELECT event_id, 'n' || user_id, 'created', ts FROM events WHERE event_type = 'purchase')"""


@query("watch_changes", f"WITH {WATCHED} SELECT event_id, file_path, event_type FROM w")
def watch_changes(spark, d):
    folder, sink = scratch_path(spark, "incoming"), scratch_path(spark, "watched")
    change_events(spark, d).repartition(4).write.parquet(folder)
    stream = changes.watch_changes(spark, folder)
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", sink + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink).select("event_id", "file_path", "event_type")


LAST = f"""{WATCHED}, l AS (SELECT file_path, arg_max(event_type, (ts, event_id)) AS event_type FROM w GROUP BY 1),
old AS (SELECT 'u' || c_custkey AS file_path, 'old' AS content FROM customer)"""


def applied_inputs(spark, d):
    old = st.table(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("file_path"), F.lit("old").alias("content"))
    return old, changes.split_moves(change_events(spark, d))


@query("apply_changes", f"WITH {LAST} SELECT * FROM old WHERE file_path NOT IN (SELECT file_path FROM l) UNION ALL SELECT file_path, 'new' FROM l WHERE event_type <> 'deleted'")
def apply_changes(spark, d):
    old, ev = applied_inputs(spark, d)
    fresh = ev.select("file_path").distinct().withColumn("content", F.lit("new"))
    return changes.apply_changes(old, ev, fresh)


@query("stream_changes", f"WITH {LAST} SELECT * FROM old WHERE file_path NOT IN (SELECT file_path FROM l) UNION ALL SELECT file_path, 'new' FROM l WHERE event_type <> 'deleted'")
def stream_changes(spark, d):
    old, _ = applied_inputs(spark, d)
    root, folder = scratch_path(spark, "live"), scratch_path(spark, "incoming")
    tables.write_keyed(old, root, "file_path", 8)
    change_events(spark, d).repartition(5, F.xxhash64("event_id")).write.parquet(folder)
    q = changes.stream_changes(changes.watch_changes(spark, folder, files_per_trigger=1), root, lambda p: p.withColumn("content", F.lit("new")), folder + "-state")
    q.awaitTermination()
    return tables.read_keyed(spark, root)


@query(
    "incremental_index",
    f"""WITH {TWO} SELECT file_path, 'old' AS origin FROM cur JOIN idx USING (file_path, file_hash) UNION ALL SELECT new_path, 'old' FROM moves
    UNION ALL SELECT file_path, 'new' FROM cur WHERE file_path NOT IN (SELECT new_path FROM moves) AND (file_path, file_hash) NOT IN (SELECT (file_path, file_hash) FROM idx)""",
)
def incremental_index(spark, d):
    current, indexed = two_versions(spark, d)
    old = indexed.select("file_path", F.lit("old").alias("origin"))
    return changes.incremental_index(old, indexed, current, lambda f: f.select("file_path", F.lit("new").alias("origin")))


@query(
    "claim_state",
    """WITH b AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'complete' ELSE 'error' END AS s, doc_id % 60 AS age FROM documents),
    r AS (SELECT doc_id, CASE WHEN s = 'processing' AND age > 30 THEN 'pending' ELSE s END AS s FROM b), c AS (SELECT doc_id, CASE WHEN s = 'pending' AND doc_id IN (SELECT doc_id FROM labels) THEN 'complete' ELSE s END AS s FROM r)
    SELECT s AS embedding_status, count(*) AS n FROM c GROUP BY 1""",
)
def claim_state(spark, d):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    k = F.col("doc_id") % 4
    base = st.table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.when(k == 0, "pending").when(k == 1, "processing").when(k == 2, "complete").otherwise("error").alias("embedding_status"),
        F.lit(0).alias("batch_id"), (now - F.make_dt_interval(mins=(F.col("doc_id") % 60).cast("int"))).alias("updated_at"),
    )
    out = changes.release_stuck(base, now, 30)
    out = changes.claim_batch(out, st.table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id")), 7, now)
    return changes.finish_batch(out, 7, now).groupBy("embedding_status").agg(F.count("*").alias("n"))


@query(
    "staleness",
    """WITH f AS (SELECT source || doc_id AS p, n_chars AS m, doc_id, lang FROM documents), i AS (SELECT p, CASE WHEN doc_id % 3 = 0 THEN m - 1 ELSE m END AS s FROM f WHERE lang <> 'es')
    SELECT count(*) AS total_files, count_if(coalesce(m > s, true))::BIGINT AS stale_files, max(m) AS newest_file, min(s) AS oldest_index, (SELECT count(*) FROM i) AS indexed_files, 1000000 - min(s) AS age_seconds, 1000000 - min(s) > 300 AS is_stale FROM f LEFT JOIN i USING (p)""",
)
def staleness(spark, d):
    f = st.table(spark, d, "documents").select(F.concat("source", F.col("doc_id").cast("string")).alias("file_path"), F.col("n_chars").alias("mtime"), "doc_id", "lang")
    i = f.filter("lang <> 'es'").select("file_path", F.when(F.col("doc_id") % 3 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"))
    return changes.staleness(f, i, F.lit(1000000).cast("long"))


@query("phase_metrics", "SELECT event_type AS phase, count(*) AS items, round(sum(value), 4) AS seconds, round(count(*) / sum(value), 6) AS throughput FROM events GROUP BY 1")
def phase_metrics(spark, d):
    e = st.table(spark, d, "events").select(F.col("event_type").alias("phase"), F.lit(1).alias("items"), F.col("value").alias("seconds"))
    return changes.phase_metrics(e).withColumn("seconds", F.round("seconds", 4))


# ------------------------------------------------------------------ Python sources and extensions


def python_files(spark, d):
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    branch = F.when(s > 25, "        if b and a:\n            return helper(a)\n").otherwise("        helper(b)\n")
    body = F.concat(F.lit("import pytest\n\ndef fn_"), k, F.lit("(a, b=1, *, c=2):\n    for x in a:\n"), branch, F.lit("    return obj.fn_"), s.cast("string"), F.lit("(b)\n\n"))
    test = F.concat(
        F.lit("def test_fn_"), k, F.lit("(tmp_path, db):\n"),
        F.when(s % 4 == 0, "    pass\n").when(s % 4 == 1, F.concat(F.lit("    fn_"), k, F.lit("(1)\n"))).otherwise(F.concat(F.lit("    assert fn_"), k, F.lit("(1)\n"))),
    )
    broken = F.when(s == 50, "def broken(:\n").otherwise("")
    return st.table(spark, d, "part").select(F.concat(F.lit("tests/test_"), k, F.lit(".py")).alias("file_path"), F.concat(broken, body, test).alias("text"), "p_partkey", "p_size")


@query("extract_calls", "SELECT 'tests/test_' || p_partkey || '.py' AS file_path, unnest(list_sort(list_distinct(list_concat(['fn_' || p_size, 'helper'], CASE WHEN p_size % 4 = 0 THEN [] ELSE ['fn_' || p_partkey] END)))) AS called FROM part WHERE p_size <> 50")
def extract_calls(spark, d):
    return python_files(spark, d).select("file_path", F.explode(pycode.extract_calls(F.col("text"))).alias("called"))


@query(
    "python_metrics",
    """SELECT 'tests/test_' || p_partkey || '.py' AS file_path, 'fn_' || p_partkey AS name, 3 AS start_line, CASE WHEN p_size > 25 THEN 7 ELSE 6 END AS end_line, CASE WHEN p_size > 25 THEN 5 ELSE 4 END AS lines, CASE WHEN p_size > 25 THEN 4 ELSE 2 END AS cyclomatic_complexity, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS max_nesting, 3 AS parameter_count FROM part WHERE p_size <> 50
    UNION ALL SELECT 'tests/test_' || p_partkey || '.py', 'test_fn_' || p_partkey, CASE WHEN p_size > 25 THEN 9 ELSE 8 END, CASE WHEN p_size > 25 THEN 10 ELSE 9 END, 2, 1, 0, 2 FROM part WHERE p_size <> 50""",
)
def python_metrics(spark, d):
    return pycode.python_metrics(python_files(spark, d))


@query(
    "test_anti_patterns",
    """SELECT 'tests/test_' || p_partkey || '.py' AS file_path, 'test_fn_' || p_partkey AS test, CASE WHEN p_size % 4 = 0 THEN 'empty_body' ELSE 'no_assertion' END AS pattern FROM part WHERE p_size % 4 < 2 AND p_size <> 50""",
)
def test_anti_patterns(spark, d):
    return pycode.test_anti_patterns(python_files(spark, d)).select("file_path", "test", "pattern")


@query(
    "test_nodes",
    """SELECT 'testsuite::tests/test_' || p_partkey || '.py' AS id, 'pytest' AS framework, 1::BIGINT AS test_count FROM part""",
)
def test_nodes(spark, d):
    c = python_files(spark, d).select("file_path", F.concat(F.lit("test_fn_"), F.col("p_partkey").cast("string")).alias("name"), F.col("text").alias("content"))
    return pycode.test_nodes(c)[0].select("id", "framework", "test_count")


@query("test_cases", "SELECT 'testcase::tests/test_' || p_partkey || '.py::test_fn_' || p_partkey AS case_id, false AS is_parametrized, CASE WHEN p_size = 50 THEN 'b,c' ELSE 'a,b,c' END AS fixtures FROM part")
def test_cases(spark, d):
    c = python_files(spark, d).select("file_path", F.concat(F.lit("test_fn_"), F.col("p_partkey").cast("string")).alias("name"), F.col("text").alias("content"))
    return pycode.test_nodes(c)[1].select("case_id", "is_parametrized", F.array_join("fixture_deps", ",").alias("fixtures"))


def line_parser(text, path):
    """Small demonstration parser: one chunk per line that ends a sentence."""
    return [
        {"content": x, "start_line": i, "end_line": i, "chunk_type": "line", "name": None}
        for i, x in enumerate(text.split("\n"), 1) if x.endswith(".")
    ]


@query("register_parser", f"WITH {st.FILES}, l AS (SELECT file_path, unnest(string_split(text, chr(10))) AS content FROM files) SELECT file_path, content FROM l WHERE content LIKE '%.'")
def register_parser(spark, d):
    ext.register_parser(".md", line_parser)
    return ext.parse_files(st.files(spark, d)).select("file_path", "content")


@query("register_metric", f"WITH {st.CHUNKS} SELECT chunk_id, len(content) - len(replace(content, ' ', '')) AS blanks FROM chunks")
def register_metric(spark, d):
    ext.register_metric("blanks", lambda s: s.str.count(" "), "long")
    return st.chunks(spark, d).select("chunk_id", ext.metric("blanks", "content"))


@query(
    "register_aggregate",
    f"""WITH {st.CHUNKS}, l AS (SELECT chunk_id, unnest(string_split(content, chr(10))) AS line FROM chunks)
    SELECT chunk_id, max(len(line))::BIGINT AS longest, count(DISTINCT line)::BIGINT AS different FROM l GROUP BY 1""",
)
def register_aggregate(spark, d):
    ext.register_aggregate("longest", int, lambda s, rows: max(s, int(rows["line"].str.len().max())), max, int, "long")
    ext.register_aggregate("different", set, lambda s, rows: s | set(rows["line"]), lambda a, b: a | b, len, "long")
    lines = st.chunks(spark, d).select("chunk_id", F.explode(F.split("content", "\n")).alias("line"))
    return ext.grouped_metrics(lines, ["chunk_id"], ["longest", "different"])


@query("parse_in_sql", f"WITH {st.FILES}, l AS (SELECT file_path, string_split(text, chr(10)) AS ls FROM files) SELECT file_path, count(*) AS chunks FROM (SELECT file_path, unnest(ls) AS x FROM l) WHERE x LIKE '%.' GROUP BY 1")
def parse_in_sql(spark, d):
    ext.register_parser(".md", line_parser)
    ext.parser_function(spark)
    st.files(spark, d).createOrReplaceTempView("siftwell_files")
    return spark.sql("SELECT f.file_path, count(*) AS chunks FROM siftwell_files f, LATERAL parse_file(f.text, f.file_path) c GROUP BY f.file_path")


# ------------------------------------------------------------------ whole searches


def search_tables(spark, d, vectors_read=True):
    c = st.chunks(spark, d).select(
        "chunk_id", "file_path", "content", "chunk_type", F.col("lang").alias("language"), F.regexp_extract("content", "[A-Za-z]+", 0).alias("function_name"),
        F.lit(None).cast("string").alias("class_name"), "start_line", "end_line",
    )
    corpus = st.corpus(spark, d)
    from siftwell.runtime import cut_lineage

    vectors = vector.hash_vectors(corpus, "chunk_id", "doc_text")
    return sp.SearchTables(c, lexical.bm25_index(corpus), cut_lineage(vectors) if vectors_read else vectors, files=st.files(spark, d))


SHOWN = ["query_id", "chunk_id", "score", "rank"]


@query("search")
def search(spark, d):
    return sp.search(search_tables(spark, d), st.search_queries(spark, d)).select(*SHOWN)


@query("search_filtered_lexical")
def search_filtered_lexical(spark, d):
    opts = sp.SearchOptions(mode="bm25", filters={"language": ["en", "fr"]})
    return sp.search(search_tables(spark, d, vectors_read=False), st.search_queries(spark, d), opts).select(*SHOWN)


@query("search_similar")
def search_similar(spark, d):
    t = search_tables(spark, d)
    ids = st.chunks(spark, d).filter("doc_id % 100 = 0")
    return sp.search_similar(t, ids, sp.SearchOptions(limit=5, mode="vector", expand=False, rerank=False)).select(*SHOWN)


@query("search_by_context")
def search_by_context(spark, d):
    r = st.search_queries(spark, d).select("query_id", F.col("text").alias("description"), F.array(F.lit("config"), F.lit("error")).alias("focus_areas"))
    return sp.search_by_context(search_tables(spark, d), r, sp.SearchOptions(expand=False)).select(*SHOWN)


@query("review_gather")
def review_gather(spark, d):
    q = st.search_queries(spark, d).select(F.concat(F.lit("r"), F.col("query_id") % 4).alias("review_id"), "text")
    q = q.unionByName(sp.canned_reviews(spark, ["security", "testing"]))
    changed = st.files(spark, d).filter("lang <> 'de'").select("file_path")
    return sp.review_gather(search_tables(spark, d), q, changed)


