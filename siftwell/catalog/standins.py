"""Tables of the data model built from the given tables, once in Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.operators import chunking, lexical


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """documents as files: doc_id, file_path, lang, source, text."""
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("file_path"),
        "lang",
        "source",
        "text",
    )


FILES = """files AS (
  SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS file_path, lang, source, text
  FROM documents)"""


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """documents cut into line windows: chunk_id, file_path, doc_id, lang, start_line, end_line, content."""
    return chunking.chunk_text(files(spark, folder), mode="lines").select(
        "chunk_id", "file_path", "doc_id", "lang", "source", "chunk_type", "start_line", "end_line", "content"
    )


CHUNKS = FILES + """,
rows_of AS (
  SELECT * EXCLUDE (parts), CASE WHEN parts[-1] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS parts
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM files)),
windows AS (
  SELECT *, unnest(generate_series(0, greatest(0, ceil((len(parts) - 30) / 26.0)::INT))) AS w FROM rows_of),
cut AS (
  SELECT file_path, doc_id, lang, source, 'text' AS chunk_type, (w * 26 + 1)::INT AS start_line,
         least(w * 26 + 30, len(parts))::INT AS end_line,
         array_to_string(parts[w * 26 + 1 : w * 26 + 30], chr(10)) AS content
  FROM windows),
chunks AS (
  SELECT substr(sha256(file_path || ':text::' || start_line || ':' || end_line || ':' ||
                       substr(sha256(content), 1, 8)), 1, 16) AS chunk_id, *
  FROM cut WHERE regexp_matches(content, '\\S'))"""


def token_sql(name: str, source: str, key: str, text: str) -> str:
    """CTEs ``name(key, term, tf)``: search tokens of ``text`` in ``source``."""
    w = r"[\p{L}\p{N}_]"
    compound = rf"{w}[\p{{L}}\p{{N}}_.\-/]*{w}"
    camel = (
        "list_concat(regexp_extract_all(t, '[A-Z][a-z]+'), flatten(list_transform("
        "regexp_split_to_array(t, '[A-Z][a-z]+'), lambda f: list_concat(list_concat("
        "regexp_extract_all(f, '[A-Z]{2,}$'), regexp_extract_all(f, '[a-z]{2,}$')), "
        "regexp_extract_all(f, '([a-z]{2,})[A-Z]', 1)))))"
    )
    return f"""{name}_raw AS (
  SELECT {key}, 0 AS kind, unnest(regexp_extract_all(lower({text}), '{compound}')) AS term FROM {source}
  UNION ALL
  SELECT {key}, 1, unnest(regexp_extract_all(lower({text}), '{w}+')) FROM {source}
  UNION ALL
  SELECT {key}, 2, lower(p) FROM (
    SELECT {key}, unnest(list_concat(string_split(t, '_'), {camel})) AS p
    FROM (SELECT DISTINCT {key}, unnest(regexp_extract_all({text}, '{w}+')) AS t FROM {source})) WHERE len(p) > 1),
{name} AS MATERIALIZED (
  SELECT {key}, term, (CASE WHEN min(kind) = 0 THEN count_if(kind = 0) WHEN min(kind) = 1 THEN count_if(kind = 1) ELSE 1 END)::BIGINT AS tf
  FROM {name}_raw WHERE NOT regexp_full_match(term, '\\p{{Nd}}+') GROUP BY {key}, term)"""


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with their indexed text (content, path, type)."""
    return chunks(spark, folder).withColumn(
        "doc_text", lexical.document_text(F.col("content"), path=F.col("file_path"), kind=F.col("chunk_type"))
    )


def search_queries(spark: SparkSession, folder: str) -> DataFrame:
    """benchmark passages as the batch of queries."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


BM25 = CHUNKS + ",\nindexed AS (SELECT chunk_id, content || ' ' || file_path || ' ' || chunk_type AS doc FROM chunks),\n" + token_sql(
    "toks", "indexed", "chunk_id", "doc"
) + """,
corpus AS (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT sum(tf) FROM toks) / (SELECT count(*) FROM chunks) AS avgdl),
lens AS (SELECT chunk_id, sum(tf) AS dl FROM toks GROUP BY 1),
postings AS MATERIALIZED (SELECT term, chunk_id, dl, tf FROM toks JOIN lens USING (chunk_id)),
raw AS (
  SELECT term, count(*) AS df, ln((SELECT n FROM corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf
  FROM postings GROUP BY term),
terms AS (
  SELECT term, df, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM raw) ELSE raw_idf END AS idf FROM raw)"""

BM25_HITS = BM25 + ",\n" + token_sql("asked", "benchmark", "item_id", "text") + """,
bm_all AS (
  SELECT item_id AS query_id, chunk_id,
         round(sum(asked.tf * idf * postings.tf * 2.5 / (postings.tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM corpus)))), 6) AS score
  FROM asked JOIN terms USING (term) JOIN postings USING (term) GROUP BY ALL),
bm_rank AS MATERIALIZED (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank
  FROM bm_all WHERE score > 0)"""


def chunk_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem rows as function metrics."""
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey")).alias("file_path"),
        F.concat(F.lit("f"), F.col("l_partkey")).alias("name"),
        F.col("l_suppkey").alias("author_id"),
        F.col("l_returnflag").alias("project"),
        F.col("l_linestatus").alias("side"),
        F.when(F.col("l_returnflag") == "R", "class").when(F.col("l_returnflag") == "A", "method").otherwise("function").alias("chunk_type"),
        F.col("l_quantity").cast("int").alias("cognitive_complexity"),
        F.round(F.col("l_discount") * 200).cast("int").alias("cyclomatic_complexity"),
        F.col("l_linenumber").alias("max_nesting_depth"),
        F.round(F.col("l_tax") * 100).cast("int").alias("parameter_count"),
        F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("lines_of_code"),
        F.col("l_linenumber").alias("comment_lines"),
        F.trunc("l_shipdate", "month").alias("ts"),
    )


CM = """cm AS (
  SELECT 'o' || l_orderkey AS file_path, 'f' || l_partkey AS name, l_suppkey AS author_id, l_returnflag AS project,
         l_linestatus AS side, CASE l_returnflag WHEN 'R' THEN 'class' WHEN 'A' THEN 'method' ELSE 'function' END AS chunk_type,
         l_quantity::INT AS cognitive_complexity, round(l_discount * 200)::INT AS cyclomatic_complexity,
         l_linenumber AS max_nesting_depth, round(l_tax * 100)::INT AS parameter_count,
         floor(l_extendedprice / 1000)::INT AS lines_of_code, l_linenumber AS comment_lines,
         date_trunc('month', l_shipdate)::DATE AS ts
  FROM lineitem),
cms AS (
  SELECT *, (lines_of_code > 50 OR cognitive_complexity > 15)::INT + (max_nesting_depth > 4)::INT
            + (parameter_count > 5)::INT + (cyclomatic_complexity > 10)::INT AS smells FROM cm)"""

SMELLS = CM + """,
smells AS (
  SELECT file_path, name AS function_name, 'Long Method' AS name, 'warning' AS severity,
         greatest(lines_of_code, cognitive_complexity)::DOUBLE AS metric_value, 50.0::DOUBLE AS threshold
  FROM cm WHERE lines_of_code > 50 OR cognitive_complexity > 15
  UNION ALL SELECT file_path, name, 'Deep Nesting', 'warning', max_nesting_depth, 4 FROM cm WHERE max_nesting_depth > 4
  UNION ALL SELECT file_path, name, 'Long Parameter List', 'warning', parameter_count, 5 FROM cm WHERE parameter_count > 5
  UNION ALL SELECT file_path, name, 'Complex Method', 'warning', cyclomatic_complexity, 10 FROM cm WHERE cyclomatic_complexity > 10)"""

FILE_METRICS = CM + """,
fm AS (
  SELECT file_path, count(*) AS chunk_count, sum(cognitive_complexity)::BIGINT AS total_complexity,
         avg(cognitive_complexity) AS avg_complexity, max(cognitive_complexity) AS max_complexity,
         sum(lines_of_code)::BIGINT AS total_lines, sum(comment_lines)::BIGINT AS comment_lines,
         count_if(chunk_type = 'function')::BIGINT AS function_count, count_if(chunk_type = 'class')::BIGINT AS class_count,
         count_if(chunk_type = 'method')::BIGINT AS method_count, sum(smells)::BIGINT AS smell_count
  FROM cms GROUP BY file_path),
health AS (
  SELECT *, greatest(0.0, 1.0 - CASE WHEN avg_complexity > 30 THEN 0.5 WHEN avg_complexity > 20 THEN 0.3
                                     WHEN avg_complexity > 10 THEN 0.2 WHEN avg_complexity > 5 THEN 0.1 ELSE 0 END
                  - least(0.3, smell_count * 0.05)
                  - CASE WHEN total_lines > 0 AND (comment_lines / total_lines < 0.1 OR comment_lines / total_lines > 0.5)
                         THEN 0.1 ELSE 0 END)::DOUBLE AS health FROM fm)"""

SNAPSHOTS = CM + """,
snap0 AS (
  SELECT project, ts, count(DISTINCT file_path) AS total_files, count(*) AS total_chunks, sum(lines_of_code)::BIGINT AS total_lines,
         coalesce(avg(CASE WHEN cognitive_complexity <> 0 THEN cognitive_complexity END), 0) AS avg_complexity,
         max(cognitive_complexity) AS max_complexity, sum(smells)::BIGINT AS total_smells,
         count_if(cognitive_complexity > 20)::BIGINT AS high_complexity
  FROM cms GROUP BY project, ts),
snap AS (
  SELECT *, greatest(0, floor(100 - CASE WHEN avg_complexity > 30 THEN 50 WHEN avg_complexity > 20 THEN 30
              WHEN avg_complexity > 10 THEN 20 WHEN avg_complexity > 5 THEN 10 ELSE 0 END - least(30, total_smells * 5)))::INT AS health
  FROM snap0)"""


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    from siftwell.operators import history

    return history.trend_metrics(chunk_metrics(spark, folder), ["project", "ts"])


def commit_files(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem rows as the files of a commit: sha, author, ts, path, insertions, deletions, line."""
    li = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("sha"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("path"),
        F.col("l_quantity").cast("int").alias("insertions"),
        F.col("l_linenumber").alias("deletions"),
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.to_date("o_orderdate").alias("ts")
    )
    return orders.join(li, "sha")


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """orders as commits with files_changed, insertions, deletions and a message."""
    stats = commit_files(spark, folder).groupBy("sha").agg(
        F.count("*").alias("files_changed"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions")
    )
    key = F.col("o_orderkey").cast("string")
    message = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("Bump part"), key, F.lit(" from 1 to 2")))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("chore: update orders"))
        .otherwise(F.concat(F.lit("Change order "), key))
    )
    return (
        table(spark, folder, "orders")
        .select(
            F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.to_date("o_orderdate").alias("ts"), message.alias("message")
        )
        .join(stats, "sha", "left")
        .fillna(0, ["files_changed", "insertions", "deletions"])
    )


COMMITS = """cf AS (
  SELECT o_orderkey AS sha, o_custkey AS author, o_orderdate::DATE AS ts, 'p' || l_partkey AS path,
         l_quantity::INT AS insertions, l_linenumber AS deletions
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
commits AS (
  SELECT o_orderkey AS sha, o_custkey AS author, o_orderdate::DATE AS ts,
         CASE o_orderpriority WHEN '5-LOW' THEN 'Bump part' || o_orderkey || ' from 1 to 2'
              WHEN '4-NOT SPECIFIED' THEN 'chore: update orders' ELSE 'Change order ' || o_orderkey END AS message,
         coalesce(files_changed, 0)::BIGINT AS files_changed, coalesce(insertions, 0)::BIGINT AS insertions, coalesce(deletions, 0)::BIGINT AS deletions
  FROM orders LEFT JOIN (SELECT sha, count(*) AS files_changed, sum(insertions) AS insertions, sum(deletions) AS deletions
                         FROM cf GROUP BY sha) s ON s.sha = o_orderkey)"""


def mixed_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Query texts of many shapes: the benchmark passages and phrases built from part rows."""
    k = F.col("p_size") % 8
    n, b = F.col("p_name"), F.col("p_brand")
    cases = [
        F.concat(F.lit("auth "), n),
        F.concat(F.lit("getPart."), b),
        F.concat(F.lit("find error in "), n),
        F.lower("p_type"),
        F.concat(F.lit("delete_user "), n),
        F.concat(F.lit("where is the database config for "), n, F.lit(" "), b),
        F.concat(F.lit("API endpoint() "), b),
    ]
    text = F.concat(n, F.lit(" "), F.col("p_type"))
    for i, c in enumerate(cases):
        text = F.when(k == i, c).otherwise(text)
    made = table(spark, folder, "part").select((F.col("p_partkey") + 1000000).alias("query_id"), text.alias("text"))
    return search_queries(spark, folder).unionByName(made)


MIXED = """mixed AS (
  SELECT item_id AS query_id, text FROM benchmark
  UNION ALL SELECT p_partkey + 1000000, CASE p_size % 8 WHEN 0 THEN 'auth ' || p_name WHEN 1 THEN 'getPart.' || p_brand WHEN 2 THEN 'find error in ' || p_name
    WHEN 3 THEN lower(p_type) WHEN 4 THEN 'delete_user ' || p_name WHEN 5 THEN 'where is the database config for ' || p_name || ' ' || p_brand
    WHEN 6 THEN 'API endpoint() ' || p_brand ELSE p_name || ' ' || p_type END FROM part)"""


def sql_values(rows: list[tuple]) -> str:
    """SQL VALUES list of string / number tuples."""
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)


VECTORS = BM25_HITS + """,
bucketed AS (SELECT chunk_id, (('0x' || substr(md5(term), 1, 8))::UBIGINT % 64)::INT AS b, sum(tf)::DOUBLE AS w FROM toks GROUP BY ALL),
asked_b AS (SELECT item_id AS query_id, (('0x' || substr(md5(term), 1, 8))::UBIGINT % 64)::INT AS b, sum(tf)::DOUBLE AS w FROM asked GROUP BY ALL),
cn AS (SELECT chunk_id, sqrt(sum(w * w)) AS n FROM bucketed GROUP BY 1),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM asked_b GROUP BY 1),
vec_all AS (
  SELECT query_id, chunk_id, round(sum(a.w * c.w) / any_value(qn.n * cn.n), 6) AS cosine
  FROM asked_b a JOIN bucketed c USING (b) JOIN cn USING (chunk_id) JOIN qn USING (query_id) GROUP BY ALL),
vec_rank AS MATERIALIZED (
  SELECT query_id, chunk_id, round(1 - cosine, 6) AS distance, round(greatest(0, 1 - round(1 - cosine, 6) / 2), 7) AS similarity,
         (row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id))::INT AS rank FROM vec_all)"""


def lists_sql(source: str, key: str, text: str) -> str:
    """VECTORS for the queries (key, text) of another table than ``benchmark``."""
    return VECTORS.replace(token_sql("asked", "benchmark", "item_id", "text"), token_sql("asked", source, key, text)).replace("item_id AS query_id", f"{key} AS query_id")


def chunk_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the chunks: named by their first word, each joined to the next one of its file and a file's first to the next file's."""
    c = chunks(spark, folder)
    nodes = c.select(F.col("chunk_id").alias("id"), F.regexp_extract("content", "[A-Za-z]+", 0).alias("name"), "file_path")
    of = lambda name, doc, line: c.select(F.col("chunk_id").alias(name), doc.alias("_doc"), line.alias("_line"))
    doc, line = F.col("doc_id"), F.col("start_line")
    inside = of("src", doc, line + 26).join(of("dst", doc, line), ["_doc", "_line"])
    first = c.filter("start_line = 1")
    across = first.select(F.col("chunk_id").alias("src"), (doc + 1).alias("_doc")).join(first.select(F.col("chunk_id").alias("dst"), doc.alias("_doc")), "_doc")
    return nodes, inside.select("src", "dst").unionByName(across.select("src", "dst"))


CHUNK_GRAPH = """nodes AS (SELECT chunk_id AS id, regexp_extract(content, '[A-Za-z]+') AS name, file_path FROM chunks),
edges AS (SELECT a.chunk_id AS src, b.chunk_id AS dst FROM chunks a JOIN chunks b ON a.doc_id = b.doc_id AND b.start_line = a.start_line + 26
  UNION ALL SELECT a.chunk_id, b.chunk_id FROM chunks a JOIN chunks b ON b.doc_id = a.doc_id + 1 AND a.start_line = 1 AND b.start_line = 1)"""


def code_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """part rows as code chunks: some names shared, some private, some generic."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    name = (
        F.when(s == 1, F.regexp_replace("p_name", " ", "_")).when(s == 2, F.concat(F.lit("_hidden"), k)).when(s == 3, "main")
        .otherwise(F.concat(F.lit("fn_"), k))
    )
    return table(spark, folder, "part").select(
        F.concat(F.lit("part:"), k).alias("chunk_id"),
        name.alias("name"),
        F.when(F.col("p_type") == "ECONOMY", "class").when(F.col("p_type") == "SMALL", "method").otherwise("function").alias("chunk_type"),
        F.regexp_replace("p_brand", "#", "").alias("class_name"),
        F.concat(F.lit("src/"), F.regexp_replace("p_brand", "#", ""), F.lit("/"), F.lower("p_type"), F.lit(".py")).alias("file_path"),
    )


CODE = """code AS (
  SELECT 'part:' || p_partkey AS chunk_id, CASE p_size WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN '_hidden' || p_partkey WHEN 3 THEN 'main' ELSE 'fn_' || p_partkey END AS name,
         CASE p_type WHEN 'ECONOMY' THEN 'class' WHEN 'SMALL' THEN 'method' ELSE 'function' END AS chunk_type, replace(p_brand, '#', '') AS class_name,
         'src/' || replace(p_brand, '#', '') || '/' || lower(p_type) || '.py' AS file_path FROM part),
ent AS (SELECT chunk_id AS id, chunk_type AS kind, name, class_name, file_path FROM code
        WHERE len(name) > 2 AND name <> 'main' AND NOT (starts_with(name, '_') AND NOT starts_with(name, '__')))"""


def code_refs(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem rows as call references: plain, dotted and self calls."""
    s, n = F.col("l_suppkey").cast("string"), F.col("l_linenumber")
    fn = F.concat(F.lit("fn_"), s)
    target = F.when(n == 1, F.concat(F.lit("helper."), fn)).when(n == 2, F.concat(F.lit("self."), fn)).otherwise(fn)
    li = table(spark, folder, "lineitem").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("chunk_id"), target.alias("target")).distinct()
    return li.join(code_chunks(spark, folder).select("chunk_id", "class_name"), "chunk_id")


REFS = """refs AS (
  SELECT DISTINCT chunk_id, class_name, CASE l_linenumber WHEN 1 THEN 'helper.fn_' || l_suppkey WHEN 2 THEN 'self.fn_' || l_suppkey ELSE 'fn_' || l_suppkey END AS target
  FROM lineitem JOIN code ON chunk_id = 'part:' || l_partkey),
uniq AS (SELECT name, min(id) AS id FROM ent GROUP BY 1 HAVING count(*) = 1),
calls AS (
  SELECT r.chunk_id AS src, coalesce(m.id, f.id, s.id) AS dst FROM refs r
  LEFT JOIN (SELECT class_name, name, max(id) AS id FROM ent GROUP BY ALL) m ON starts_with(r.target, 'self.') AND m.class_name = r.class_name AND m.name = substr(r.target, 6)
  LEFT JOIN uniq f ON f.name = r.target
  LEFT JOIN uniq s ON contains(r.target, '.') AND s.name = split_part(r.target, '.', 2)
  WHERE coalesce(m.id, f.id, s.id) IS NOT NULL)"""


def tree_edges(spark: SparkSession, folder: str) -> DataFrame:
    """region → nation → supplier containment as (src parent, dst child)."""
    n = table(spark, folder, "nation").select(
        F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("dst")
    )
    s = table(spark, folder, "supplier").select(
        F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("src"), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("dst")
    )
    return n.unionByName(s)


TREE = """tree AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier)"""


def transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive event types of a user as edges (a graph with cycles)."""
    ev = table(spark, folder, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).filter("dst IS NOT NULL").distinct()


TRANSITIONS = """trans AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"""


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """documents as markdown: frontmatter, headers, references, links and a fenced block woven into the text."""
    d = F.col("doc_id").cast("string")
    head = F.concat(
        F.lit("---\ntags: "), F.col("lang"), F.lit(", "), F.col("source"), F.lit("\ncategories: [prose, '"), F.col("lang"),
        F.lit("']\nkeywords:\n- invented\n- n"), F.col("doc_id") % 7, F.lit("\n---\n# Text "), d, F.lit(" of "), F.col("source"), F.lit("\n"),
    )
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("\n## Part fn_5 more\n"))
    body = F.replace(body, F.lit(" the "), F.concat(F.lit(" `fn_"), F.col("doc_id") % 500, F.lit("` ")))
    body = F.replace(body, F.lit(" la "), F.lit(" `class` "))
    link = F.concat(F.lit(" [next](../"), F.col("lang"), F.lit("/"), (F.col("doc_id") + 20).cast("string"), F.lit(".md#top) "))
    body = F.replace(body, F.lit(" and "), link)
    tail = F.concat(F.lit("\n```python\nfn_"), d, F.lit("()\n```\n"))
    return files(spark, folder).withColumn("text", F.concat(head, body, tail))


MARKDOWN = FILES + """,
md AS (
  SELECT doc_id, file_path, lang, source,
    '---' || chr(10) || 'tags: ' || lang || ', ' || source || chr(10) || 'categories: [prose, ''' || lang || ''']' || chr(10) || 'keywords:' || chr(10) || '- invented' || chr(10) || '- n' || (doc_id % 7)
    || chr(10) || '---' || chr(10) || '# Text ' || doc_id || ' of ' || source || chr(10)
    || replace(replace(replace(replace(text, chr(10), chr(10) || '## Part fn_5 more' || chr(10)), ' the ', ' `fn_' || (doc_id % 500) || '` '), ' la ', ' `class` '),
               ' and ', ' [next](../' || lang || '/' || (doc_id + 20) || '.md#top) ')
    || chr(10) || '```python' || chr(10) || 'fn_' || doc_id || '()' || chr(10) || '```' || chr(10) AS text FROM files)"""


def policies(spark: SparkSession, folder: str) -> DataFrame:
    """documents as policies: common words replaced by privacy phrases."""
    t = F.replace(F.col("text"), F.lit("\n"), F.lit("\n## Section of data\n"))
    t = F.replace(t, F.lit(" the "), F.lit(" we never share personal data "))
    t = F.replace(t, F.lit(" la "), F.lit(" your data is encrypted with TLS "))
    t = F.replace(t, F.lit(" de "), F.lit(" users can request an export and delete your records "))
    t = F.replace(t, F.lit(" und "), F.lit(" we log access and encrypt it "))
    return files(spark, folder).select("doc_id", t.alias("text"))


POLICIES = """pol AS (SELECT doc_id, replace(replace(replace(replace(replace(text, chr(10), chr(10) || '## Section of data' || chr(10)), ' the ', ' we never share personal data '),
  ' la ', ' your data is encrypted with TLS '), ' de ', ' users can request an export and delete your records '), ' und ', ' we log access and encrypt it ') AS text FROM documents)"""
