"""Document structure, audit and predicate queries."""

from pyspark.sql import functions as F

from siftwell.catalog import standins as st
from siftwell.catalog.graph_queries import entities
from siftwell.catalog.metric_queries import PAGE_PATHS, page_paths
from siftwell.catalog.registry import query
from siftwell.functions import text as tx
from siftwell.operators import audit, chunking, documents, lexical, predicates, vector

# ------------------------------------------------------------------ text structure

LINES = f"""{st.MARKDOWN}, ls AS (SELECT doc_id, file_path, string_split(text, chr(10)) AS ls FROM md),
    ln AS (SELECT doc_id, file_path, ls, unnest(generate_series(1, len(ls))) AS line FROM ls),
    hd AS (SELECT *, len(regexp_extract(ls[line], '^(#{{1,6}})\\s+(.+)$', 1))::INT AS level, trim(regexp_extract(ls[line], '^(#{{1,6}})\\s+(.+)$', 2)) AS title FROM ln WHERE regexp_matches(ls[line], '^#{{1,6}}\\s+.')),
    nx AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS next_line FROM hd)"""


@query(
    "doc_sections",
    f"WITH {LINES} SELECT doc_id, level, title, line::INT AS line, next_line::INT AS next_line, coalesce(next_line - 1, len(ls))::INT AS end_line, array_to_string(ls[line + 1:coalesce(next_line - 1, len(ls))], chr(10)) AS content FROM nx",
)
def doc_sections(spark, d):
    return documents.doc_sections(st.markdown(spark, d).select("doc_id", "text"))


@query(
    "doc_links_blocks",
    f"""WITH {st.MARKDOWN} SELECT doc_id, 'link' AS kind, split_part(unnest(regexp_extract_all(text, '\\[([^\\]]*)\\]\\(([^)]+\\.md(?:#[^)]*)?)\\)', 2)), '#', 1) AS value FROM md
    UNION ALL SELECT DISTINCT doc_id, 'code_ref', r FROM (SELECT doc_id, trim(unnest(regexp_extract_all(replace(text, '```', chr(10)), '`([^`\\n]+)`', 1))) AS r FROM md) WHERE regexp_full_match(r, '[a-zA-Z_][a-zA-Z0-9_.]*')
    UNION ALL SELECT doc_id, 'code_block', unnest(regexp_extract_all(text, '(?s)```(\\w*)\\n(.*?)```', 1)) FROM md""",
)
def doc_links_blocks(spark, d):
    return documents.doc_links_blocks(st.markdown(spark, d).select("doc_id", "text"))


@query(
    "related_documents",
    f"""WITH {st.MARKDOWN} SELECT DISTINCT a.file_path AS src, b.file_path AS dst FROM md a JOIN md b ON b.source = a.source AND b.lang = a.lang AND b.doc_id = a.doc_id + 20 WHERE contains(a.text, '[next](')""",
)
def related_documents(spark, d):
    return documents.related_documents(st.markdown(spark, d))


@query(
    "frontmatter_tags",
    """SELECT doc_id, unnest([lang, source, 'prose', 'invented', 'n' || (doc_id % 7)]) AS tag FROM documents""",
)
def frontmatter_tags(spark, d):
    return st.markdown(spark, d).select("doc_id", F.explode(documents.frontmatter_tags(F.col("text"))).alias("tag"))


ENT_SQL = r"""SELECT doc_id, 'terms' AS kind, unnest(list_concat(list_concat(list_filter(w, lambda x: regexp_full_match(x, '[A-Z][a-z]+[A-Z][a-zA-Z]*')), list_filter(w, lambda x: regexp_full_match(x, '[A-Z]{2,}'))), list_filter(w, lambda x: regexp_full_match(x, '[a-z]+_[a-z_]+')))) AS value FROM ws
    UNION SELECT doc_id, 'keywords', unnest(list_filter(lw, lambda x: regexp_full_match(x, '[a-z]{4,}') AND NOT list_contains([STOP], x))) FROM ws
    UNION SELECT doc_id, 'verbs', unnest(list_filter(lw, lambda x: regexp_full_match(x, 'returns?|raises?|creates?|generates?|initializes?|loads?|saves?|parses?|validates?|processes?|handles?|builds?|performs?|executes?|extracts?|computes?|calculates?'))) FROM ws
    UNION SELECT doc_id, 'code_refs', unnest(regexp_extract_all(text, '`([^`]+)`', 1)) FROM ws"""


@query(
    "extract_entities",
    f"WITH {st.MARKDOWN}, ws AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS w, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS lw FROM md) "
    + ENT_SQL.replace("[STOP]", "[" + ", ".join(f"'{w}'" for w in documents.STOP_WORDS) + "]"),
)
def extract_entities(spark, d):
    e = documents.extract_entities(F.col("text"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("vs")) for k, c in e.items()])
    rows = st.markdown(spark, d).select("doc_id", F.explode(kinds).alias("k"))
    return rows.select("doc_id", F.col("k.kind").alias("kind"), F.explode("k.vs").alias("value"))


@query(
    "contextual_text",
    f"""WITH {st.CHUNKS} SELECT chunk_id, 'File: ' || lang || '/' || doc_id || '.md | Lang: ' || lang || ' | Class: ' || source || ' | Uses: a.b, ' || lang || ' | Desc: ' || trim(content) || chr(10) || '---' || chr(10) || content AS text FROM chunks""",
)
def contextual_text(spark, d):
    c = chunking.contextual_text(
        F.col("content"), F.col("file_path"), F.col("lang"), F.col("source"), F.lit(""), F.array(F.lit("a.b"), F.col("lang")), F.col("content")
    )
    return st.chunks(spark, d).select("chunk_id", c.alias("text"))


@query(
    "bracket_text",
    f"""WITH {st.CHUNKS} SELECT chunk_id, '[class ' || source || ']' || chr(10) || '[imports: ' || lang || ']' || chr(10) || '[calls: f, g]' || chr(10) || content AS text FROM chunks""",
)
def bracket_text(spark, d):
    c = chunking.bracket_text(F.col("content"), F.col("source"), F.array("lang"), F.lit(""), F.array(F.lit("f"), F.lit("g")))
    return st.chunks(spark, d).select("chunk_id", c.alias("text"))


@query(
    "chunk_paragraphs",
    f"""WITH RECURSIVE {st.FILES}, t AS (SELECT file_path, string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10)) AS ls FROM files), big AS (SELECT file_path, ls FROM t),
    ln AS (SELECT file_path, unnest(ls) AS row, generate_subscripts(ls, 1) AS line FROM big), f AS (SELECT *, line - row_number() OVER (PARTITION BY file_path ORDER BY line) AS island FROM ln WHERE regexp_matches(row, '\\S')),
    p AS (SELECT file_path, min(line)::INT AS s, max(line)::INT AS e, string_agg(row, chr(10) ORDER BY line) || chr(10) AS body FROM f GROUP BY file_path, island),
    has AS (SELECT file_path, list_max(list_transform(regexp_split_to_array(array_to_string(ls, chr(10)), '\\n[ \\t]*\\n'), lambda x: len(trim(x)))) > {chunking.MIN_PARAGRAPH} AS has FROM big),
    n AS (SELECT p.*, row_number() OVER (PARTITION BY file_path ORDER BY s) AS k FROM p JOIN has USING (file_path) WHERE has),
    m AS (SELECT file_path, k, body AS content, s, e FROM n WHERE k = 1
      UNION ALL SELECT n.file_path, n.k, CASE WHEN len(content) + len(body) < {chunking.MERGE_LIMIT} THEN content || chr(10) || body ELSE body END, CASE WHEN len(content) + len(body) < {chunking.MERGE_LIMIT} THEN m.s ELSE n.s END, n.e
      FROM m JOIN n ON n.file_path = m.file_path AND n.k = m.k + 1),
    c AS (SELECT *, lead(s) OVER (PARTITION BY file_path ORDER BY k) AS later FROM m),
    w AS (SELECT t.file_path, ls, unnest(generate_series(0, greatest(0, ceil((len(ls) - 30) / 26.0)::INT))) AS w FROM (SELECT file_path, CASE WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls FROM t) t JOIN has USING (file_path) WHERE NOT coalesce(has, false)),
    every AS (SELECT file_path, s AS start_line, e AS end_line, content FROM c WHERE later IS DISTINCT FROM s
      UNION ALL SELECT file_path, (w * 26 + 1)::INT, least(w * 26 + 30, len(ls))::INT, array_to_string(ls[w * 26 + 1:w * 26 + 30], chr(10)) FROM w)
    SELECT substr(sha256(file_path || ':text::' || start_line || ':' || end_line || ':' || substr(sha256(content), 1, 8)), 1, 16) AS chunk_id, * FROM every WHERE regexp_matches(content, '\\S')""",
)
def chunk_paragraphs(spark, d):
    md = st.files(spark, d).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n")))
    return chunking.chunk_text(md, mode="auto").select("chunk_id", "file_path", "start_line", "end_line", "content")


@query(
    "chunk_hierarchy",
    f"""WITH {st.CODE}, c AS (SELECT *, CASE WHEN name LIKE '%_hidden%' THEN 'module' ELSE chunk_type END AS t FROM code),
    cl AS (SELECT file_path, class_name, min(chunk_id) AS cid FROM c WHERE t = 'class' GROUP BY ALL), mo AS (SELECT file_path, min(chunk_id) AS mid FROM c WHERE t = 'module' GROUP BY 1)
    SELECT chunk_id, CASE WHEN t = 'module' THEN NULL ELSE coalesce(CASE WHEN t = 'method' THEN cid END, mid) END AS parent_id, CASE WHEN t = 'module' THEN 0 WHEN t = 'method' AND cid IS NOT NULL THEN 2 ELSE 1 END AS depth
    FROM c LEFT JOIN cl USING (file_path, class_name) LEFT JOIN mo USING (file_path)""",
)
def chunk_hierarchy(spark, d):
    c = st.code_chunks(spark, d)
    c = c.withColumn("chunk_type", F.when(F.contains("name", F.lit("_hidden")), "module").otherwise(F.col("chunk_type")))
    return chunking.chunk_hierarchy(c).select("chunk_id", "parent_id", "depth")


def doc_paths(spark, d):
    """documents with many kinds of paths."""
    names = ["README.md", "man/setup.md", "docs/api/ref.md", "CHANGELOG.rst", "conf.toml", "x/research/a.md", "notes/bug-fix-1.md", "b/state.md", "misc/faq.md", "misc/plain.md", "run.sh"]
    out = F.lit(names[-1])
    for i, n in enumerate(names[:-1]):
        out = F.when(F.col("doc_id") % 11 == i, n).otherwise(out)
    return st.files(spark, d).select("doc_id", F.concat(F.col("source"), F.lit("/"), out).alias("file_path"), "lang", "source", "text")


KINDS = ["readme", "setup", "api_doc", "changelog", "configuration", "research", "bugfix", "design", "faq", "other", "script"]


@query("classify_document", f"SELECT doc_id, [{', '.join(repr(k) for k in KINDS)}][(doc_id % 11 + 1)::INT] AS category FROM documents")
def classify_document(spark, d):
    return doc_paths(spark, d).select("doc_id", documents.classify_document(F.col("file_path")).alias("category"))


@query("html_sections")
def html_sections(spark, d):
    return documents.html_sections(st.table(spark, d, "pages"))


def section_rows(spark, d):
    s = documents.doc_sections(st.markdown(spark, d).select("doc_id", "file_path", "text"))
    return s.withColumn("section_id", F.concat_ws(":", F.lit("doc"), F.col("doc_id").cast("string"), F.col("line").cast("string"))).withColumn(
        "file_path", F.when(F.col("doc_id") % 3 == 0, "src/Brand2/README.md").otherwise(F.col("file_path"))
    )


@query(
    "doc_code_edges",
    LINES.join(["WITH ", ""]) + f""", {st.CODE}, sc AS (SELECT 'doc:' || doc_id || ':' || line AS section_id, title, array_to_string(ls[line + 1:coalesce(next_line - 1, len(ls))], chr(10)) AS content,
       CASE WHEN doc_id % 3 = 0 THEN 'src/Brand2/README.md' ELSE file_path END AS doc FROM nx),
    j AS (SELECT section_id, id AS entity, title, lower(content) AS body, lower(name) AS n, kind, doc, ent.file_path AS code FROM sc JOIN ent ON contains(lower(title || ' ' || content), lower(name))),
    m AS (SELECT *, (len(body) - len(replace(body, n, ''))) // len(n) AS mentions FROM j),
    s AS (SELECT section_id, entity, round(CASE WHEN contains(lower(title), n) THEN 0.4 ELSE 0 END + CASE WHEN mentions >= 2 THEN 0.2 WHEN mentions = 1 THEN 0.1 ELSE 0 END
       + CASE WHEN doc LIKE '%README.md' AND regexp_replace(code, '/[^/]*$', '') = 'src/Brand2' THEN 0.3 ELSE 0 END
       + CASE WHEN kind IN ('function', 'method') AND regexp_matches(body, 'function|method|returns|parameters|args') THEN 0.1 WHEN kind = 'class' AND regexp_matches(body, 'class|instance|object|inherits|extends') THEN 0.1 ELSE 0 END, 6)::DOUBLE AS weight FROM m)
    SELECT section_id, entity, weight FROM s WHERE weight >= 0.5""",
)
def doc_code_edges(spark, d):
    return documents.doc_code_edges(section_rows(spark, d), entities(spark, d))


@query(
    "reference_edges",
    f"""WITH {st.MARKDOWN}, {st.CODE}, u AS (SELECT name, min(id) AS id FROM ent GROUP BY 1 HAVING count(*) = 1),
    r AS (SELECT DISTINCT doc_id, trim(unnest(regexp_extract_all(replace(text, '```', chr(10)), '`([^`\\n]+)`', 1))) AS name FROM md) SELECT doc_id AS src, id AS dst FROM r JOIN u USING (name)""",
)
def reference_edges(spark, d):
    return documents.reference_edges(st.markdown(spark, d), entities(spark, d), "doc_id")


@query(
    "doc_ontology",
    LINES.join(["WITH ", ""]) + f""", s AS (SELECT doc_id, count(*) AS n FROM nx GROUP BY 1), r AS (SELECT a.doc_id, count(*) AS n FROM md a JOIN md b ON b.source = a.source AND b.lang = a.lang AND b.doc_id = a.doc_id + 20 WHERE contains(a.text, '[next](') GROUP BY 1)
    SELECT doc_id, [{', '.join(repr(k) for k in KINDS)}][(doc_id % 11 + 1)::INT] AS category, coalesce(s.n, 0) AS sections, 5::BIGINT AS tags, coalesce(r.n, 0) AS related, round(pow(0.5, (doc_id % 400) / 90.0::DOUBLE), 6) AS decay
    FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)""",
)
def doc_ontology(spark, d):
    md = st.markdown(spark, d)
    docs = doc_paths(spark, d).select("doc_id", "file_path", F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")).alias("last_modified"))
    tags = md.select("doc_id", F.explode(documents.frontmatter_tags(F.col("text"))).alias("tag"))
    ids = md.select(F.col("file_path").alias("src"), "doc_id")
    related = documents.related_documents(md).join(ids, "src")
    sections = documents.doc_sections(md.select("doc_id", "text"))
    out = documents.doc_ontology(docs, sections, tags, related, F.lit("2024-01-01").cast("date"))
    return out.select("doc_id", "category", "sections", "tags", "related", "decay")


@query(
    "topic_tree",
    """WITH t AS (SELECT DISTINCT source AS name, lang FROM documents) SELECT name || '/' || t.lang AS topic_id, t.lang AS name, name AS parent_name, count(DISTINCT doc_id) AS documents FROM t JOIN documents ON source = name AND documents.lang = t.lang GROUP BY ALL
    UNION ALL SELECT source, source, NULL, 0 FROM documents GROUP BY 1""",
)
def topic_tree(spark, d):
    f = st.files(spark, d)
    top = f.select(F.col("source").alias("topic_id"), F.col("source").alias("name"), F.lit(None).cast("string").alias("parent_id")).distinct()
    sub = f.select(F.concat_ws("/", "source", "lang").alias("topic_id"), F.col("lang").alias("name"), F.col("source").alias("parent_id")).distinct()
    return documents.topic_tree(top.unionByName(sub), f.select(F.concat_ws("/", "source", "lang").alias("topic_id"), "doc_id"))


# ------------------------------------------------------------------ audit


def sql_votes(text):
    """Struct of (n, order, category) for the category with most keywords."""
    parts = []
    for i, (name, kws) in enumerate(audit.CATEGORY_KEYWORDS.items()):
        n = " + ".join(f"contains(lower({text}), '{k.lower()}')::INT" for k in kws)
        parts.append(f"{{'n': {n}, 'o': {-i}, 'c': '{name}'}}")
    return f"list_max([{', '.join(parts)}])"


SQL_PATTERN = " OR ".join("regexp_matches(s, '(?i)" + p.replace("'", "''") + "')" for p in audit.CLAIM_PATTERNS)
VERB = "(?i)" + audit.PRIVACY_VERBS
NEG = audit.NEGATION.replace("'", "''")
CLAIMS = f"""{st.POLICIES}, sec AS (SELECT doc_id, unnest(regexp_split_to_array(text, '(?m)^#{{1,4}}\\s+.+\\s*$')) AS body, generate_subscripts(regexp_split_to_array(text, '(?m)^#{{1,4}}\\s+.+\\s*$'), 1) AS k FROM pol),
    sen AS (SELECT doc_id, k, unnest(string_split(regexp_replace(trim(body, chr(10) || ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM sec),
    hit AS (SELECT doc_id, k, trim(s) AS s, regexp_split_to_array(regexp_replace(trim(s), '(?i)\\s+and\\s+', chr(2)), chr(2)) AS h FROM sen WHERE ({SQL_PATTERN})),
    spl AS (SELECT doc_id, unnest(CASE WHEN len(h) = 2 AND regexp_matches(h[1], '{VERB}') AND regexp_matches(h[2], '{VERB}')
        AND CASE WHEN {sql_votes('h[1]')}.n > 0 THEN {sql_votes('h[1]')}.c ELSE 'security' END <> CASE WHEN {sql_votes('h[2]')}.n > 0 THEN {sql_votes('h[2]')}.c ELSE 'security' END THEN h ELSE [s] END) AS s FROM hit),
    cat AS (SELECT doc_id, s, {sql_votes('s')} AS v FROM spl),
    nrm AS (SELECT doc_id, s, CASE WHEN v.n > 0 THEN v.c ELSE 'security' END AS category, CASE WHEN regexp_matches(s, '{VERB}')
        THEN 'The application ' || CASE WHEN regexp_matches(lower(s), '{NEG}') THEN 'does not' ELSE 'does' END || ' ' || lower(trim(regexp_split_to_array(regexp_extract(s, '(?is){audit.PRIVACY_VERBS}.*'), '[.,;]')[1])) ELSE s END AS normalized FROM cat)"""


@query("policy_claims", f"WITH {CLAIMS} SELECT doc_id, lower(normalized) AS normalized, count(*)::BIGINT AS one FROM (SELECT DISTINCT doc_id, lower(normalized) AS normalized FROM nrm) GROUP BY ALL")
def policy_claims(spark, d):
    c = audit.policy_claims(st.policies(spark, d))
    return c.groupBy("doc_id", F.lower("normalized").alias("normalized")).agg(F.count("*").alias("one"))


@query("policy_claim_confidence")
def policy_claim_confidence(spark, d):
    return audit.policy_claims(st.policies(spark, d)).select("doc_id", "claim_id", "category", F.array_join("keywords", ",").alias("keywords"), "confidence", "section")


def claim_table(spark, d):
    """part rows as claims."""
    cats = ["data_sharing", "encryption", "retention", "user_rights", "third_party", "logging_pii", "consent", "security"]
    cat = F.element_at(F.array(*[F.lit(c) for c in cats]), (F.col("p_size") % 8 + 1).cast("int"))
    return st.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("claim_id"), cat.alias("category"), F.split("p_name", " ").alias("keywords"),
        F.concat(F.lit("The application does store "), "p_name").alias("normalized"),
    )


CLAIM_TABLE = """claims AS (SELECT p_partkey::VARCHAR AS claim_id, ['data_sharing', 'encryption', 'retention', 'user_rights', 'third_party', 'logging_pii', 'consent', 'security'][p_size % 8 + 1] AS category,
   string_split(p_name, ' ') AS keywords, 'The application does store ' || p_name AS normalized FROM part)"""
ENTRIES = [{"claim_id": "17"}, {"category": "consent"}, {"pattern": "store RED"}, {"category": "encryption", "expires": "2020-01-01"}]


@query("apply_ignores", f"WITH {CLAIM_TABLE} SELECT claim_id, claim_id = '17' OR category = 'consent' OR contains(normalized, 'store red') AS ignored FROM claims")
def apply_ignores(spark, d):
    return audit.apply_ignores(claim_table(spark, d), ENTRIES, "2024-01-01").select("claim_id", "ignored")


@query(
    "route_claims",
    f"""WITH {CLAIM_TABLE}, p(category, tool, query, weight) AS (VALUES {st.sql_values([(c, t, q, w) for c, ps in audit.STRATEGIES.items() for t, q, w in ps])}),
    k(category, template) AS (VALUES {st.sql_values(list(audit.KEYWORD_TEMPLATES.items()))})
    SELECT claim_id, tool, query, weight::DOUBLE AS weight FROM claims JOIN p USING (category)
    UNION ALL SELECT claim_id, 'search_hybrid', replace(template, '{{keywords}}', array_to_string(keywords, ' ')), 0.5 FROM claims JOIN k USING (category)
    UNION ALL SELECT claim_id, 'search_hybrid', normalized, 1 FROM claims WHERE category IN ('consent', 'security')
    UNION ALL SELECT claim_id, 'search_code', array_to_string(keywords, ' '), 1 FROM claims WHERE category IN ('consent', 'security')""",
)
def route_claims(spark, d):
    return audit.route_claims(claim_table(spark, d))


def sql_in(words):
    return ", ".join(f"'{w}'" for w in words)


NOISE = " OR ".join(f"regexp_matches(file_path, '{tx.glob_regex(p)}') OR regexp_matches(split_part(file_path, '/', -1), '{tx.glob_regex(p)}')" for p in audit.NOISE_PATTERNS)


@query(
    "evidence_hits",
    f"""WITH RECURSIVE {CLAIM_TABLE}, p(category, tool, query, weight) AS (VALUES {st.sql_values([(c, t, q, w) for c, ps in audit.STRATEGIES.items() for t, q, w in ps])}),
    k(category, template) AS (VALUES {st.sql_values(list(audit.KEYWORD_TEMPLATES.items()))}),
    plans AS (SELECT DISTINCT claim_id, tool, query, weight, md5(query) AS query_id FROM (SELECT claim_id, tool, query, weight::DOUBLE AS weight FROM claims JOIN p USING (category)
      UNION ALL SELECT claim_id, 'search_hybrid', replace(template, '{{keywords}}', array_to_string(keywords, ' ')), 0.5 FROM claims JOIN k USING (category)
      UNION ALL SELECT claim_id, 'search_hybrid', normalized, 1 FROM claims WHERE category IN ('consent', 'security')
      UNION ALL SELECT claim_id, 'search_code', array_to_string(keywords, ' '), 1 FROM claims WHERE category IN ('consent', 'security'))),
    qs AS (SELECT DISTINCT query_id, query FROM plans WHERE tool IN ({sql_in(audit.VECTOR_TOOLS + audit.HYBRID_TOOLS)})),
    {st.lists_sql('qs', 'query_id', 'query')}, {st.CHUNK_GRAPH},
    fj AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.chunk_id, b.chunk_id) AS chunk_id, coalesce(0.7::DOUBLE / (60 + v.rank), 0) + coalesce(0.3::DOUBLE / (60 + b.rank), 0) AS raw
      FROM (SELECT * FROM vec_rank WHERE rank <= 30) v FULL JOIN (SELECT * FROM bm_rank WHERE rank <= 30) b ON v.query_id = b.query_id AND v.chunk_id = b.chunk_id),
    fs AS (SELECT query_id, chunk_id, round(raw / max(raw) OVER (PARTITION BY query_id), 8) AS score FROM fj),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fs),
    gw AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: len(w) > 3)) AS word FROM plans WHERE tool IN ({sql_in(audit.GRAPH_TOOLS)})),
    gone AS (SELECT query_id, file_path, arg_min(name, id) AS callee FROM gw JOIN nodes ON contains(lower(name), word) GROUP BY ALL),
    paths AS (SELECT b.name AS callee, list_sort(list_distinct(list(a.name || ' -> ' || b.name))) AS call_path FROM (SELECT DISTINCT src, dst FROM edges) JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY 1),
    ev AS (SELECT claim_id, tool, query, weight, file_path, start_line, end_line, similarity AS score, NULL::VARCHAR[] AS call_path FROM plans JOIN vec_rank USING (query_id) JOIN chunks USING (chunk_id) WHERE rank <= 10 AND tool IN ({sql_in(audit.VECTOR_TOOLS)})
      UNION ALL SELECT claim_id, tool, query, weight, file_path, start_line, end_line, score, NULL FROM plans JOIN fused USING (query_id) JOIN chunks USING (chunk_id) WHERE rank <= 10 AND tool IN ({sql_in(audit.HYBRID_TOOLS)})
      UNION ALL SELECT claim_id, tool, query, weight, file_path, 0, 0, 0.7, call_path FROM plans JOIN gone USING (query_id) LEFT JOIN paths USING (callee) WHERE tool IN ({sql_in(audit.GRAPH_TOOLS)})),
    clean AS (SELECT * FROM ev WHERE NOT ({NOISE})),
    best AS (SELECT claim_id, file_path, start_line, end_line, max(score) AS score FROM clean GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY claim_id, file_path ORDER BY score DESC, start_line, end_line) AS n, count(*) OVER (PARTITION BY claim_id, file_path) AS size FROM best WHERE start_line > 0),
    g AS (SELECT claim_id, file_path, 0::BIGINT AS n, []::STRUCT(a INT, b INT, s DOUBLE)[] AS kept, any_value(size) AS size FROM o GROUP BY ALL
      UNION ALL SELECT g.claim_id, g.file_path, o.n, CASE WHEN len(list_filter(kept, lambda x: x.a <= end_line AND start_line <= x.b)) > 0 THEN kept ELSE list_append(kept, {{'a': start_line, 'b': end_line, 's': score}}) END, g.size
      FROM g JOIN o ON o.claim_id = g.claim_id AND o.file_path = g.file_path AND o.n = g.n + 1),
    kept AS (SELECT claim_id, file_path, x.a AS start_line, x.b AS end_line, x.s AS score FROM (SELECT claim_id, file_path, unnest(kept) AS x FROM g WHERE n = size) UNION ALL SELECT * FROM best WHERE start_line = 0)
    SELECT claim_id, file_path, start_line, end_line, kept.score, min((tool, query, weight, array_to_string(call_path, ',')))[1] AS tool, min((tool, query, weight, array_to_string(call_path, ',')))[2] AS query,
      min((tool, query, weight, array_to_string(call_path, ',')))[3] AS weight, min((tool, query, weight, array_to_string(call_path, ',')))[4] AS call_path
    FROM kept JOIN clean USING (claim_id, file_path, start_line, end_line, score) GROUP BY ALL""",
)
def evidence_hits(spark, d):
    nodes, edges = st.chunk_graph(spark, d)
    corpus = st.corpus(spark, d)
    vectors = vector.hash_vectors(corpus, "chunk_id", "doc_text")
    found = audit.evidence_hits(claim_table(spark, d), lexical.bm25_index(corpus), st.chunks(spark, d), vectors=vectors, nodes=nodes, edges=edges)
    return found.withColumn("call_path", F.array_join("call_path", ","))


# ------------------------------------------------------------------ predicates


@query("where_filters", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber IN (1, 3, 5) AND l_quantity > 30")
def where_filters(spark, d):
    f = {"l_returnflag": "R", "l_linenumber": [1, 3, 5], "l_tax": None}
    return predicates.where_filters(st.table(spark, d, "lineitem"), f, "l_quantity > 30").select("l_orderkey", "l_partkey", "l_linenumber")


@query("query_filters", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber IN (2, 4) AND (l_quantity >= 45 OR (l_discount < 0.02 AND l_linestatus = 'O'))")
def query_filters(spark, d):
    f = {"l_returnflag": "!N", "l_linenumber": [2, 4], "$or": [{"l_quantity": {"$gte": 45}}, {"$and": [{"l_discount": {"$lt": 0.02}}, {"l_linestatus": "O"}]}]}
    return predicates.query_filters(st.table(spark, d, "lineitem"), f).select("l_orderkey", "l_partkey")


TEST_PATHS = """tp AS (SELECT doc_id, lang || CASE doc_id % 8 WHEN 0 THEN '/tests/a.py' WHEN 1 THEN '/test_x.py' WHEN 2 THEN '/x_test.go' WHEN 3 THEN '/a.spec.ts' WHEN 4 THEN '/conftest.py' WHEN 5 THEN '/latest.py' WHEN 6 THEN '/contest/a.py' ELSE '/plain.py' END AS file_path,
   CASE WHEN doc_id % 24 = 7 THEN 'test_it' ELSE source END AS name FROM documents)"""


def test_paths(spark, d):
    ends = ["/tests/a.py", "/test_x.py", "/x_test.go", "/a.spec.ts", "/conftest.py", "/latest.py", "/contest/a.py"]
    end = F.lit("/plain.py")
    for i, e in enumerate(ends):
        end = F.when(F.col("doc_id") % 8 == i, e).otherwise(end)
    return st.table(spark, d, "documents").select("doc_id", F.concat("lang", end).alias("file_path"), F.when(F.col("doc_id") % 24 == 7, "test_it").otherwise(F.col("source")).alias("name"))


@query("filter_tests_only", f"WITH {TEST_PATHS} SELECT * FROM tp WHERE doc_id % 8 < 5 OR name = 'test_it'")
def filter_tests_only(spark, d):
    return predicates.filter_tests_only(test_paths(spark, d), name="name")


@query("filter_path_glob", f"WITH {PAGE_PATHS} SELECT page_id, file_path FROM pp WHERE file_path GLOB '*.html' AND file_path GLOB 'm*'")
def filter_path_glob(spark, d):
    return predicates.filter_path_glob(predicates.filter_path_glob(page_paths(spark, d), "*.html"), "m*.html").select("page_id", "file_path")


@query(
    "file_filter",
    f"WITH {PAGE_PATHS} SELECT page_id, file_path FROM pp WHERE regexp_matches(file_path, '^m[.][^/]*/fr/') OR NOT (list_has_any(string_split(file_path, '/'), ['es', 'de']) OR len(list_filter(string_split(file_path, '/'), lambda x: starts_with(x, 'blog.'))) > 0 OR regexp_matches(file_path, '^[^/]*[.]org/'))",
)
def file_filter(spark, d):
    return predicates.file_filter(page_paths(spark, d), ["es", "de", "blog.*"], ["m.*/fr/**"], ["*.org/**"]).select("page_id", "file_path")


@query(
    "filter_quality",
    """WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity END AS c, l_linenumber AS s, CASE WHEN l_tax < 0.02 THEN NULL WHEN l_quantity <= 10 THEN 'A' WHEN l_quantity <= 25 THEN 'B' ELSE 'F' END AS g FROM lineitem)
    SELECT l_orderkey, l_linenumber FROM m WHERE (c IS NULL OR c <= 30) AND (g IS NULL OR g IN ('A', 'B', 'C')) AND s * 10 >= 20""",
)
def filter_quality(spark, d):
    q = F.col("l_quantity")
    m = st.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", q).alias("cognitive_complexity"), F.lit(0).alias("smell_count"),
        F.when(F.col("l_tax") < 0.02, None).when(q <= 10, "A").when(q <= 25, "B").otherwise("F").alias("complexity_grade"), (F.col("l_linenumber") * 10).alias("quality_score"),
    )
    return predicates.filter_quality(m, 30, True, "A-C", 20).select("l_orderkey", "l_linenumber")


