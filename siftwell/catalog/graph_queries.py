"""Graph queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.catalog import standins as st
from siftwell.catalog.registry import query
from siftwell.operators import graph as g
from siftwell.runtime import number_rows


def key(prefix, col):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def entities(spark, d):
    return g.build_entities(st.code_chunks(spark, d))


def calls(spark, d):
    return g.resolve_entities(st.code_refs(spark, d), entities(spark, d)).distinct()


CALLS = f"{st.CODE}, {st.REFS}, ce AS (SELECT DISTINCT src, dst FROM calls WHERE src IN (SELECT id FROM ent))"


def call_edges(spark, d):
    return calls(spark, d).join(entities(spark, d).select(F.col("id").alias("src")), "src", "left_semi")


@query("build_entities", f"WITH {st.CODE} SELECT * FROM ent")
def build_entities(spark, d):
    return entities(spark, d)


@query("resolve_entities", f"WITH {st.CODE}, {st.REFS} SELECT DISTINCT src, dst FROM calls")
def resolve_entities(spark, d):
    return calls(spark, d)


@query(
    "build_edges",
    f"""WITH {CALLS} SELECT src, dst, 'CALLS' AS rel FROM ce
    UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'module:lib' || (l_suppkey // 10), 'IMPORTS' FROM lineitem WHERE l_linenumber <> 7
    UNION ALL SELECT DISTINCT x.id, u.bid, 'INHERITS' FROM (SELECT ent.id, ps.l_suppkey FROM ent JOIN lineitem ps ON ent.id = 'part:' || ps.l_partkey WHERE ps.l_linenumber = 3) x JOIN (SELECT name, min(id) AS bid FROM ent GROUP BY 1 HAVING count(*) = 1) u ON u.name = 'fn_' || l_suppkey
    UNION ALL SELECT DISTINCT 'file:' || file_path, chunk_id, 'CONTAINS' FROM code""",
)
def build_edges(spark, d):
    li = st.table(spark, d, "lineitem")
    lib = F.concat(F.lit("lib"), F.floor(F.col("l_suppkey") / 10).cast("string"))
    imports = li.select(key("part:", "l_partkey").alias("chunk_id"), F.when(F.col("l_linenumber") == 7, F.lit(".local")).otherwise(F.concat(lib, F.lit(".x"))).alias("target"))
    inherits = li.filter("l_linenumber = 3").select(key("part:", "l_partkey").alias("chunk_id"), F.lit(None).cast("string").alias("class_name"), key("fn_", "l_suppkey").alias("target"))
    parents = st.code_chunks(spark, d).select("chunk_id", F.concat(F.lit("file:"), "file_path").alias("parent_id"))
    return g.build_edges(entities(spark, d), st.code_refs(spark, d), imports, inherits, parents)


@query("import_edges", "SELECT DISTINCT 'part:' || l_partkey AS src, 'module:lib' || (l_suppkey // 10) AS dst FROM lineitem")
def import_edges(spark, d):
    lib = F.concat(F.lit("lib"), F.floor(F.col("l_suppkey") / 10).cast("string"), F.lit(".util.x"))
    return g.import_edges(st.table(spark, d, "lineitem").select(key("part:", "l_partkey").alias("chunk_id"), lib.alias("target")))


@query("caller_map", f"WITH {CALLS} SELECT a.id AS chunk_id, b.id AS caller, b.file_path FROM ce JOIN ent a ON a.id = dst JOIN ent b ON b.id = src WHERE a.file_path <> b.file_path")
def caller_map(spark, d):
    from siftwell.operators import joins

    e = entities(spark, d)
    resolved = calls(spark, d)
    return joins.caller_map_by_id(e, resolved)


@query("caller_map_by_name", f"WITH {st.CODE}, {st.REFS} SELECT DISTINCT a.chunk_id, b.chunk_id AS caller, b.file_path FROM refs JOIN code b USING (chunk_id) JOIN code a ON a.name = refs.target AND a.file_path <> b.file_path WHERE b.name <> '__init__'")
def caller_map_by_name(spark, d):
    from siftwell.operators import joins

    return joins.caller_map(st.code_chunks(spark, d), st.code_refs(spark, d).select("chunk_id", F.col("target").alias("called")))


@query(
    "upsert_graph",
    f"""WITH {CALLS}, newn AS (SELECT id, 'changed' AS kind, name, class_name, file_path FROM ent WHERE kind = 'class'),
    alln AS (SELECT * FROM ent WHERE id NOT IN (SELECT id FROM newn) UNION ALL SELECT * FROM newn),
    alle AS (SELECT src, dst, 'CALLS' AS rel FROM ce UNION SELECT src, 'module:x', 'IMPORTS' FROM ce UNION SELECT dst, src, 'CALLED' FROM ce)
    SELECT 'node' AS part, kind AS key, count(*) AS n FROM alln GROUP BY ALL UNION ALL
    SELECT 'edge', rel, count(*) FROM alle WHERE src IN (SELECT id FROM alln) AND dst IN (SELECT id FROM alln) GROUP BY ALL""",
)
def upsert_graph(spark, d):
    e, n = call_edges(spark, d).withColumn("rel", F.lit("CALLS")), entities(spark, d)
    new_n = n.filter("kind = 'class'").withColumn("kind", F.lit("changed"))
    bad = e.select("src", F.lit("module:x").alias("dst"), F.lit("IMPORTS").alias("rel"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("CALLED").alias("rel"))
    nn, ee = g.upsert_graph(n, e, new_n, bad.unionByName(back))
    return g.kg_stats(nn, ee).withColumnRenamed("section", "part")


@query(
    "delete_files",
    f"""WITH {CALLS}, gone AS (SELECT id FROM ent WHERE file_path LIKE '%/small.py') SELECT 'node' AS section, kind AS key, count(*) AS n FROM ent WHERE id NOT IN (SELECT id FROM gone) GROUP BY ALL
    UNION ALL SELECT 'edge', 'CALLS', count(*) FROM ce WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)""",
)
def delete_files(spark, d):
    n = entities(spark, d)
    files = n.filter(F.endswith("file_path", F.lit("/small.py"))).select("file_path").distinct()
    return g.kg_stats(*g.delete_files(n, call_edges(spark, d).withColumn("rel", F.lit("CALLS")), files))


@query(
    "incremental_graph",
    f"""WITH {CALLS}, gone AS (SELECT id FROM ent WHERE file_path LIKE '%/small.py'), n2 AS (SELECT id, kind FROM ent WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT id, 'fresh' FROM ent WHERE id IN (SELECT id FROM gone))
    SELECT 'node' AS section, kind AS key, count(*) AS n FROM n2 GROUP BY ALL
    UNION ALL SELECT 'edge', 'CALLS', count(*) FROM ce WHERE (src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) OR src IN (SELECT id FROM gone)""",
)
def incremental_graph(spark, d):
    n, e = entities(spark, d), call_edges(spark, d).withColumn("rel", F.lit("CALLS"))
    hit = n.filter(F.endswith("file_path", F.lit("/small.py")))
    fresh_e = e.join(hit.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "rel")
    out = g.incremental_graph(n, e.select("src", "dst", "rel"), hit.select("file_path").distinct(), hit.withColumn("kind", F.lit("fresh")), fresh_e)
    return g.kg_stats(*out)


@query("kg_stats", f"WITH {CALLS} SELECT 'node' AS section, kind AS key, count(*) AS n FROM ent GROUP BY ALL UNION ALL SELECT 'edge', 'CALLS', count(*) FROM ce")
def kg_stats(spark, d):
    return g.kg_stats(entities(spark, d), call_edges(spark, d).withColumn("rel", F.lit("CALLS")))


@query("part_of_edges", f"WITH {st.CODE} SELECT id AS src, 'project:p' AS dst, 'PART_OF' AS rel FROM ent UNION ALL SELECT id, 'lang:python', 'WRITTEN_IN' FROM ent")
def part_of_edges(spark, d):
    return g.part_of_edges(entities(spark, d), "project:p")


@query(
    "framework_edges",
    """WITH k(language, package, framework) AS (VALUES ('python', 'ring', 'Django'), ('python', 'widget', 'FastAPI'), ('go', 'bolt', 'Gin')),
    dep AS (SELECT CASE WHEN p_size < 25 THEN 'python' ELSE 'go' END AS language, split_part(p_name, ' ', 2) AS package FROM part), h AS (SELECT DISTINCT language, framework FROM dep JOIN k USING (language, package))
    SELECT 'project:p' AS src, 'framework:' || framework AS dst, 'USES_FRAMEWORK' AS rel FROM h UNION SELECT 'framework:' || framework, 'lang:' || language, 'FRAMEWORK_FOR' FROM h""",
)
def framework_edges(spark, d):
    from siftwell.runtime import fixed_table

    known = fixed_table(spark, [("python", "ring", "Django"), ("python", "widget", "FastAPI"), ("go", "bolt", "Gin")], "language string, package string, framework string")
    dep = st.table(spark, d, "part").select(F.when(F.col("p_size") < 25, "python").otherwise("go").alias("language"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("package"))
    return g.framework_edges(dep, known, "project:p")


def part_files(spark, d):
    return st.code_chunks(spark, d).select(F.col("chunk_id").alias("id"), F.concat(F.lit("p"), F.split_part("chunk_id", F.lit(":"), F.lit(2))).alias("file_path"))


PF = "pf AS (SELECT chunk_id AS id, 'p' || split_part(chunk_id, ':', 2) AS file_path FROM code)"


@query(
    "authorship",
    f"""WITH {st.CODE}, {PF}, {st.COMMITS}, f AS (SELECT path, 'person:' || substr(sha256(author::VARCHAR), 1, 16) AS person, min(ts) AS ts FROM cf GROUP BY ALL),
    m AS (SELECT path, min(struct_pack(ts := ts, person := person)).person AS founder FROM f GROUP BY 1)
    SELECT person, id AS entity, CASE WHEN person = founder THEN 'AUTHORED' ELSE 'MODIFIED' END AS rel, ts FROM f JOIN m USING (path) JOIN pf ON file_path = path""",
)
def authorship(spark, d):
    return g.authorship(st.commit_files(spark, d), part_files(spark, d))


@query(
    "commit_edges",
    f"""WITH {st.CODE}, {PF}, {st.COMMITS} SELECT sha AS src, id AS dst, sum(insertions)::BIGINT AS lines_added, sum(deletions)::BIGINT AS lines_deleted FROM cf JOIN pf ON file_path = path GROUP BY ALL""",
)
def commit_edges(spark, d):
    return g.commit_edges(st.commit_files(spark, d), part_files(spark, d))


NAMES = "asked AS (SELECT DISTINCT event_type AS query_name FROM events UNION SELECT split_part(p_name, ' ', 1) FROM part UNION SELECT 'fn_' || s_suppkey FROM supplier UNION SELECT 'main')"


@query(
    "find_entity",
    f"""WITH {st.CODE}, {NAMES}, e AS (SELECT query_name, min(id) AS id FROM asked JOIN ent ON name = query_name GROUP BY 1),
    p AS (SELECT query_name, min(id) AS id FROM asked JOIN ent ON contains(lower(name), lower(query_name)) WHERE query_name <> 'main' AND query_name NOT IN (SELECT query_name FROM e) GROUP BY 1)
    SELECT * FROM e UNION ALL SELECT * FROM p""",
)
def find_entity(spark, d):
    ev = st.table(spark, d, "events").select(F.col("event_type").alias("query_name"))
    pt = st.table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("query_name"))
    sp = st.table(spark, d, "supplier").select(key("fn_", "s_suppkey").alias("query_name"), )
    asked = ev.unionByName(pt).unionByName(sp).unionByName(ev.select(F.lit("main").alias("query_name"))).distinct()
    return g.find_entity(entities(spark, d), asked)


UND = "und AS (SELECT src, dst FROM tree UNION SELECT dst, src FROM tree)"


@query(
    "find_related",
    f"""WITH {st.TREE}, {UND}, h AS (SELECT a.src AS start, a.dst AS node, 1 AS depth FROM und a UNION ALL SELECT a.src, b.dst, 2 FROM und a JOIN und b ON b.src = a.dst),
    m AS (SELECT start, node, min(depth)::INT AS depth FROM h WHERE start <> node AND start LIKE 'supplier%' GROUP BY ALL)
    SELECT start, node, depth FROM m""",
)
def find_related(spark, d):
    starts = st.table(spark, d, "supplier").select(key("supplier:", "s_suppkey").alias("start"))
    return g.find_related(st.tree_edges(spark, d), starts, 2)


@query(
    "time_decay",
    """SELECT o_orderkey AS id, round(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE pow(0.5, greatest(0, date_diff('day', o_orderdate::DATE, DATE '1999-01-01')) / 90.0::DOUBLE) END, 6) AS decay FROM orders""",
)
def time_decay(spark, d):
    ts = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    return st.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(g.time_decay(ts, F.lit("1999-01-01").cast("date"), 90.0), 6).alias("decay"))


@query("find_by_tags", "SELECT user_id AS section FROM events WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY 1 HAVING count(DISTINCT event_type) = 3")
def find_by_tags(spark, d):
    return g.find_by_tags(st.table(spark, d, "events").select(F.col("user_id").alias("section"), F.col("event_type").alias("tag")), ["error", "purchase", "signup"])


@query("call_graph", f"WITH {CALLS} SELECT id AS start, dst AS node, 'calls' AS direction FROM ent JOIN ce ON src = id UNION SELECT id, src, 'called_by' FROM ent JOIN ce ON dst = id")
def call_graph(spark, d):
    return g.call_graph(call_edges(spark, d), entities(spark, d).select(F.col("id").alias("start")))


TRACE = f"""{CALLS}, starts AS (SELECT id AS start FROM ent),
    h1 AS (SELECT DISTINCT start, dst AS node FROM starts JOIN ce ON src = start WHERE dst <> start),
    h2 AS (SELECT DISTINCT start, dst AS node FROM h1 JOIN ce ON src = node), k2 AS (SELECT h2.* FROM h2 ANTI JOIN h1 ON h1.start = h2.start AND h1.node = h2.node WHERE h2.node <> h2.start),
    h3 AS (SELECT DISTINCT start, dst AS node FROM k2 JOIN ce ON src = node),
    k3 AS (SELECT h3.* FROM h3 ANTI JOIN (FROM h1 UNION ALL FROM k2) k ON k.start = h3.start AND k.node = h3.node WHERE h3.node <> h3.start),
    traced AS (SELECT start, start AS node, 0 AS depth FROM starts UNION ALL SELECT start, node, 1 FROM h1 UNION ALL SELECT start, node, 2 FROM k2 UNION ALL SELECT start, node, 3 FROM k3)"""


def traced(spark, d):
    return g.trace_flow(call_edges(spark, d), entities(spark, d).select(F.col("id").alias("start")))


@query("trace_flow", f"WITH {TRACE} SELECT * FROM traced")
def trace_flow(spark, d):
    return traced(spark, d)


@query("trace_edges", f"WITH {TRACE} SELECT a.start, src, dst FROM ce JOIN traced a ON a.node = src JOIN traced b ON b.node = dst AND b.start = a.start")
def trace_edges(spark, d):
    return g.trace_edges(call_edges(spark, d), traced(spark, d))


@query(
    "trace_paths",
    f"""WITH {st.TRANSITIONS}, p0 AS (SELECT DISTINCT src AS start, [src] AS path, src AS node FROM trans),
    p1 AS (SELECT start, list_append(path, dst) AS path, dst AS node FROM p0 JOIN trans ON src = node WHERE NOT list_contains(path, dst)),
    p2 AS (SELECT start, list_append(path, dst) AS path, dst AS node FROM p1 JOIN trans ON src = node WHERE NOT list_contains(path, dst)),
    ended AS (SELECT start, path FROM p2 UNION ALL SELECT start, path FROM p1 WHERE path NOT IN (SELECT path[1:2] FROM p2)),
    t AS (SELECT start, array_to_string(path, '>') AS path FROM ended) SELECT start, path FROM t""",
)
def trace_paths(spark, d):
    e = st.transitions(spark, d)
    return g.trace_paths(e, e.select(F.col("src").alias("start")).distinct(), 2)


@query(
    "inheritance_tree",
    f"""WITH RECURSIVE {st.TREE}, up AS (SELECT dst AS start, src AS node FROM tree UNION SELECT start, src FROM up JOIN tree ON dst = node)
    SELECT start, node, 'parent' AS relation FROM up UNION ALL SELECT node, start, 'child' FROM up""",
)
def inheritance_tree(spark, d):
    t = st.tree_edges(spark, d)
    starts = t.select(F.explode(F.array("src", "dst")).alias("start")).distinct()
    return g.inheritance_tree(t.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts)


PATHS = f"""{st.TREE}, paths AS (SELECT DISTINCT src AS node, [src] AS path, 0 AS depth FROM tree WHERE src LIKE 'region%'
    UNION ALL SELECT dst, [src, dst], 1 FROM tree WHERE src LIKE 'region%'
    UNION ALL SELECT t2.dst, [t1.src, t1.dst, t2.dst], 2 FROM tree t1 JOIN tree t2 ON t2.src = t1.dst WHERE t1.src LIKE 'region%')"""


@query("tree_paths", f"WITH {PATHS} SELECT node, array_to_string(path, '/') AS path, depth FROM paths")
def tree_paths(spark, d):
    return g.tree_paths(st.tree_edges(spark, d)).withColumn("path", F.array_join("path", "/"))


@query(
    "lca_score",
    f"""WITH {PATHS}, pr AS (SELECT DISTINCT 'supplier:' || l_suppkey AS a, 'nation:' || c_nationkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
    j AS (SELECT a, b, x.path AS pa, y.path AS pb, x.depth AS da, y.depth AS db, len(list_filter(generate_series(1, least(len(x.path), len(y.path))), lambda i: x.path[i] = y.path[i])) AS c FROM pr JOIN paths x ON x.node = a JOIN paths y ON y.node = b),
    k AS (SELECT *, CASE WHEN c > 0 THEN da - (c - 1) + db - (c - 1) + 0.5 * abs(da - db) END::DOUBLE AS penalty FROM j)
    SELECT a, b, CASE WHEN c > 0 THEN pa[c] END AS lca, penalty, CASE WHEN c > 0 THEN round(greatest(0, 1 - penalty / 4), 6) ELSE 0 END::DOUBLE AS resonance FROM k""",
)
def lca_score(spark, d):
    li = st.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), key("supplier:", "l_suppkey").alias("a"))
    o = st.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    c = st.table(spark, d, "customer").select(F.col("c_custkey").alias("c"), key("nation:", "c_nationkey").alias("b"))
    return g.lca_score(st.tree_edges(spark, d), li.join(o, "k").join(c, "c").select("a", "b").distinct())


KG_RELATIONS = ["calls", "called_by", "inherits", "inherited_by", "imports", "imported_by", "contains", "contained_by", "related"]
KG_NEAR = ["imports", "imported_by", "contains", "contained_by"]


@query(
    "kg_query",
    f"""WITH RECURSIVE {PATHS}, {UND}, starts AS (SELECT 'nation:' || n_nationkey AS start FROM nation),
    rel AS (SELECT src, dst FROM tree WHERE src LIKE 'region%'), sub AS (SELECT src, dst FROM tree WHERE src LIKE 'nation%'),
    up AS (SELECT start, s.dst AS node FROM starts JOIN sub s ON s.src = start UNION SELECT start, s.dst FROM up JOIN sub s ON s.src = node),
    down AS (SELECT start, s.src AS node FROM starts JOIN sub s ON s.dst = start UNION SELECT start, s.src FROM down JOIN sub s ON s.dst = node),
    one AS (SELECT start, dst AS node FROM starts JOIN und ON src = start WHERE dst <> start),
    two AS (SELECT start, node FROM one UNION SELECT start, dst FROM one JOIN und ON src = node WHERE dst <> start),
    f AS (SELECT DISTINCT 'calls' AS relation, start, dst AS node FROM starts JOIN rel ON src = start UNION SELECT DISTINCT 'called_by', start, src FROM starts JOIN rel ON dst = start
      UNION ALL SELECT 'inherits', * FROM up UNION ALL SELECT 'inherited_by', * FROM down
      {' '.join(f"UNION ALL SELECT '{r}', start, node FROM one" for r in KG_NEAR)} UNION ALL SELECT 'related', start, node FROM two),
    j AS (SELECT relation, start, f.node, x.depth AS da, y.depth AS db, len(list_filter(generate_series(1, least(len(x.path), len(y.path))), lambda i: x.path[i] = y.path[i])) AS c
      FROM f JOIN paths x ON x.node = start JOIN paths y ON y.node = f.node),
    s AS (SELECT relation, start, node, round(1 + 0.15 * CASE WHEN c > 0 THEN round(greatest(0, 1 - (da - c + 1 + db - c + 1 + 0.5 * abs(da - db)) / 4), 6) ELSE 0 END, 6)::DOUBLE AS final_score FROM j)
    SELECT *, (row_number() OVER (PARTITION BY relation, start ORDER BY final_score DESC, node))::INT AS rank FROM s""",
)
def kg_query(spark, d):
    t = st.tree_edges(spark, d)
    tree = g.tree_labels(t)
    rel = F.when(F.startswith("src", F.lit("region")), "CALLS").otherwise("INHERITS")
    starts = st.table(spark, d, "nation").select(key("nation:", "n_nationkey").alias("start"))
    found = [g.kg_query(t.withColumn("rel", rel), tree, starts, r).select(F.lit(r).alias("relation"), "*") for r in KG_RELATIONS]
    return reduce(DataFrame.unionByName, found)


@query(
    "doc_references",
    f"""WITH {st.CODE}, s AS (SELECT doc_id, source AS file_path, n_chars AS start_line FROM documents), e AS (SELECT doc_id AS src, 'part:' || (n_chars // 10) AS dst FROM documents)
    SELECT name, src AS section_id, s.file_path, start_line, 'REFERENCES' AS rel FROM e JOIN ent ON dst = id JOIN s ON s.doc_id = src""",
)
def doc_references(spark, d):
    docs = st.table(spark, d, "documents")
    s = docs.select(F.col("doc_id").alias("section_id"), F.col("source").alias("file_path"), F.col("n_chars").alias("start_line"))
    e = docs.select(F.col("doc_id").alias("src"), F.concat(F.lit("part:"), F.floor(F.col("n_chars") / 10).cast("string")).alias("dst"), F.lit("REFERENCES").alias("rel"))
    return g.doc_references(e, s, entities(spark, d).select("id", "name"))


@query(
    "entities_at_commit",
    """WITH RECURSIVE par AS (SELECT c_custkey AS commit, c_custkey // 3 AS parent FROM customer WHERE c_custkey > 0), up AS (SELECT s_suppkey * 7 AS start, s_suppkey * 7 AS commit FROM supplier UNION SELECT start, parent FROM up JOIN par USING (commit))
    SELECT start, p_partkey AS id, commit FROM up JOIN part ON p_partkey // 4 = commit""",
)
def entities_at_commit(spark, d):
    par = st.table(spark, d, "customer").filter("c_custkey > 0").select(F.col("c_custkey").alias("commit"), F.floor(F.col("c_custkey") / 3).alias("parent"))
    e = st.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 4).alias("commit"))
    return g.entities_at_commit(e, par, st.table(spark, d, "supplier").select((F.col("s_suppkey") * 7).alias("start")))


def commit_line(spark, d):
    """orders in date order as a line of commits, each the parent of the next, and every seventh merged with the one ten before."""
    o = st.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    line = number_rows(o, ["o_orderdate", "o_orderkey"], "nth").select(F.col("o_orderkey").alias("commit"), "nth")
    before = lambda n: line.select((F.col("nth") + n).alias("nth"), F.col("commit").alias("parent"))
    merges = line.filter("nth % 7 = 0").join(before(10), "nth")
    return line, line.join(before(1), "nth").unionByName(merges).select("commit", "parent")


COMMIT_LINE = """line AS (SELECT o_orderkey AS commit, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS nth FROM orders)"""


@query(
    "commit_ancestors",
    f"""WITH {COMMIT_LINE}, tips AS (SELECT commit, nth FROM line WHERE nth = (SELECT max(nth) FROM line) OR commit IN (SELECT min(o_orderkey) FROM orders GROUP BY o_orderpriority))
    SELECT t.commit AS start, l.commit AS node FROM tips t JOIN line l ON l.nth <= t.nth""",
)
def commit_ancestors(spark, d):
    line, parents = commit_line(spark, d)
    last = line.agg(F.max("nth").alias("nth")).join(line, "nth").select(F.col("commit").alias("start"))
    first = st.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("start")).select("start")
    return g.ancestors(parents.select(F.col("commit").alias("src"), F.col("parent").alias("dst")), last.unionByName(first).distinct())


@query(
    "callers_at_commit",
    f"""WITH {CALLS}, {COMMIT_LINE}, held AS (SELECT id, name, nth FROM ent JOIN line ON commit = split_part(id, ':', 2)::BIGINT),
    tips AS (SELECT min(o_orderkey) AS start FROM orders GROUP BY o_orderpriority), called AS (SELECT DISTINCT e.name AS callee_name FROM ce JOIN ent e ON e.id = dst)
    SELECT start, callee_name, a.id AS caller, a.name AS caller_name, split_part(a.id, ':', 2)::BIGINT AS commit
    FROM tips JOIN line t ON t.commit = start CROSS JOIN called JOIN ent e ON e.name = callee_name JOIN ce ON ce.dst = e.id JOIN held a ON a.id = ce.src AND a.nth <= t.nth GROUP BY ALL""",
)
def callers_at_commit(spark, d):
    _, parents = commit_line(spark, d)
    n = entities(spark, d).select("id", "name").withColumn("_own", F.substring_index("id", ":", -1).cast("long"))
    n = n.join(st.table(spark, d, "orders").select(F.col("o_orderkey").alias("_own"), F.col("o_orderkey").alias("commit")), "_own", "left").drop("_own")
    e = call_edges(spark, d)
    called = e.join(n.select(F.col("id").alias("dst"), F.col("name").alias("callee_name")), "dst").select("callee_name").distinct()
    tips = st.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("start")).select("start").distinct()
    return g.callers_at_commit(e, n, parents, tips.crossJoin(called))


@query(
    "reachability",
    f"""WITH RECURSIVE {CALLS}, r AS (SELECT id AS node FROM ent WHERE file_path LIKE '%/economy.py' UNION SELECT dst FROM r JOIN ce ON src = node)
    SELECT id, name, CASE WHEN file_path LIKE '%/promo.py' THEN 'low' ELSE 'medium' END AS confidence FROM ent WHERE id NOT IN (SELECT node FROM r) AND kind IN ('function', 'method')""",
)
def reachability(spark, d):
    n = entities(spark, d)
    deco = F.when(F.endswith("file_path", F.lit("/promo.py")), F.array(F.lit("@cached"))).otherwise(F.array().cast("array<string>"))
    roots = n.filter(F.endswith("file_path", F.lit("/economy.py"))).select(F.col("id").alias("node"))
    return g.reachability(n.withColumn("decorators", deco), call_edges(spark, d), roots).select("id", "name", "confidence")


@query(
    "entry_points",
    """SELECT p_partkey AS id, CASE WHEN p_size = 1 THEN 'main' WHEN p_size = 2 THEN 'cli' WHEN p_size = 3 THEN 'route' WHEN p_size = 4 OR p_name LIKE 'red%' THEN 'test' WHEN p_size = 5 THEN 'export' WHEN p_name NOT LIKE 'blue%' AND p_type <> 'SMALL' THEN 'public' END AS entry_type,
      CASE WHEN p_size > 5 AND p_name NOT LIKE 'red%' THEN 0.7 ELSE 1.0 END::DOUBLE AS confidence FROM part WHERE p_size <= 5 OR p_name LIKE 'red%' OR (p_name NOT LIKE 'blue%' AND p_type <> 'SMALL')""",
)
def entry_points(spark, d):
    s, n = F.col("p_size"), F.col("p_name")
    deco = F.when(s == 2, F.array(F.lit("@app.command()"))).when(s == 3, F.array(F.lit("@router.get('/x')"))).when(s == 4, F.array(F.lit("@pytest.fixture"))).otherwise(F.array().cast("array<string>"))
    name = F.when(n.like("red%"), F.concat(F.lit("test_"), n)).when(n.like("blue%"), F.concat(F.lit("_"), n)).otherwise(n)
    fns = st.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), name.alias("name"), F.when(F.col("p_type") == "SMALL", "method").otherwise("function").alias("kind"), deco.alias("decorators"), (s == 1).alias("in_main"), (s == 5).alias("exported")
    )
    return g.entry_points(fns)


@query("import_graph", "SELECT DISTINCT 'm' || l_suppkey AS module, 'f' || l_partkey AS importer, l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AS internal FROM lineitem")
def import_graph(spark, d):
    imports = st.table(spark, d, "lineitem").select(key("m", "l_suppkey").alias("target"), key("f", "l_partkey").alias("file_path"))
    return g.import_graph(imports, st.table(spark, d, "supplier").filter("s_acctbal > 5000").select(key("m", "s_suppkey").alias("module")))


@query(
    "cycles",
    f"""WITH RECURSIVE {st.TRANSITIONS}, w AS (SELECT src AS first, [src, dst] AS path, dst AS node FROM trans WHERE src < dst
      UNION ALL SELECT first, list_append(path, dst), dst FROM w JOIN trans ON src = node WHERE dst > first AND NOT list_contains(path, dst))
    SELECT src AS cycle, 1 AS length FROM trans WHERE src = dst UNION ALL SELECT array_to_string(path, '>'), len(path)::INT FROM w JOIN trans ON src = node AND dst = first""",
)
def cycles(spark, d):
    return g.cycles(st.transitions(spark, d))


@query(
    "strong_components",
    f"""WITH RECURSIVE {CALLS}, r AS (SELECT src AS a, dst AS b FROM ce UNION SELECT a, dst FROM r JOIN ce ON src = b), n AS (SELECT src AS node FROM ce UNION SELECT dst FROM ce),
    same AS (SELECT x.a AS node, x.b AS other FROM r x JOIN r y ON y.a = x.b AND y.b = x.a UNION SELECT node, node FROM n) SELECT node, min(other) AS component FROM same GROUP BY 1""",
)
def strong_components(spark, d):
    return g.strong_components(call_edges(spark, d))


@query(
    "lcom4",
    """WITH RECURSIVE m AS (SELECT DISTINCT o_custkey AS class, o_orderkey AS method, l_suppkey AS attribute FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    adj AS (SELECT DISTINCT a.class, a.method AS x, b.method AS y FROM m a JOIN m b USING (class, attribute)), r AS (SELECT class, x, y FROM adj UNION SELECT r.class, r.x, adj.y FROM r JOIN adj ON adj.class = r.class AND adj.x = r.y),
    l AS (SELECT class, x, min(y) AS label FROM r GROUP BY ALL) SELECT class, count(DISTINCT label) AS lcom4 FROM l GROUP BY 1""",
)
def lcom4(spark, d):
    li = st.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("method"), F.col("l_suppkey").alias("attribute"))
    o = st.table(spark, d, "orders").select(F.col("o_orderkey").alias("method"), F.col("o_custkey").alias("class"))
    return g.lcom4(o.join(li, "method"))


@query(
    "sample_subgraph",
    f"""WITH {CALLS}, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ce UNION ALL SELECT dst FROM ce) GROUP BY 1)
    SELECT * FROM (SELECT id, kind, degree, 1::BIGINT AS members FROM ent JOIN deg USING (id) ORDER BY degree DESC, id LIMIT 50)
    UNION ALL SELECT 'agg:' || kind, kind, 0, count(*) FROM ent GROUP BY kind HAVING count(*) > 50""",
)
def sample_subgraph(spark, d):
    return g.sample_subgraph(entities(spark, d), call_edges(spark, d).withColumn("rel", F.lit("CALLS")))[0]


@query(
    "sample_subgraph_links",
    f"""WITH {CALLS}, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ce UNION ALL SELECT dst FROM ce) GROUP BY 1), top AS (SELECT id FROM ent JOIN deg USING (id) ORDER BY degree DESC, id LIMIT 50)
    SELECT src, dst, 'CALLS' AS rel FROM ce WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)""",
)
def sample_subgraph_links(spark, d):
    return g.sample_subgraph(entities(spark, d), call_edges(spark, d).withColumn("rel", F.lit("CALLS")))[1]


@query(
    "neighbours",
    f"""WITH {CALLS}, und AS (SELECT src, dst FROM ce UNION SELECT dst, src FROM ce) SELECT src AS start, id, kind FROM und JOIN ent ON id = dst WHERE src IN (SELECT id FROM ent)""",
)
def neighbours(spark, d):
    n = entities(spark, d)
    return g.neighbours(n, call_edges(spark, d), n.select(F.col("id").alias("start")))


def module_tables(spark, d):
    li = st.table(spark, d, "lineitem")
    files = st.table(spark, d, "part").select(F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("/"), F.col("p_partkey").cast("string")).alias("file_path"))
    imports = li.select((F.col("l_partkey") % 50).alias("src"), (F.col("l_suppkey") % 50).alias("dst"))
    sm = li.join(st.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).filter("l_quantity > 45").select(
        F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("/"), F.col("p_partkey").cast("string")).alias("file_path"), F.when(F.col("l_quantity") > 49, "error").when(F.col("l_quantity") > 47, "warning").otherwise("info").alias("severity")
    )
    return files, imports, sm


@query(
    "module_graph",
    """WITH f AS (SELECT replace(p_brand, '#', '') || '/' || p_partkey AS file_path, replace(p_brand, '#', '') AS folder, p_partkey FROM part), w AS (SELECT l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY 1)
    SELECT file_path, folder, count(*) OVER (PARTITION BY folder) >= 2 AS grouped, CASE WHEN q > 49 THEN 'error' WHEN q > 47 THEN 'warning' WHEN q > 45 THEN 'info' ELSE 'none' END AS severity FROM f LEFT JOIN w ON l_partkey = p_partkey""",
)
def module_graph(spark, d):
    return g.module_graph(*module_tables(spark, d))[0]


@query(
    "module_graph_links",
    """WITH RECURSIVE l AS (SELECT l_partkey % 50 AS src, l_suppkey % 50 AS dst, count(*) AS coupling FROM lineitem GROUP BY ALL), r AS (SELECT src AS a, dst AS b FROM l UNION SELECT a, dst FROM r JOIN l ON src = b) SELECT l.src, l.dst, l.coupling, b.src IS NOT NULL AS mutual, l.src = l.dst OR EXISTS (FROM r WHERE r.a = l.dst AND r.b = l.src) AS circular FROM l LEFT JOIN l b ON b.src = l.dst AND b.dst = l.src""",
)
def module_graph_links(spark, d):
    return g.module_graph(*module_tables(spark, d))[1]
