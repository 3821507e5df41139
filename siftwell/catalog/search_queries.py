"""Query analysis, vector search, fusion and re-ranking queries."""

import numpy as np
from pyspark.sql import functions as F

from siftwell.catalog import standins as st
from siftwell.catalog.registry import query
from siftwell.functions import queries as qx
from siftwell.operators import aggregates as ag
from siftwell.operators import fusion, lexical, vector
from siftwell.operators import graph as g
from siftwell.plans import search as sp
from siftwell.runtime import scratch_path

WS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')"
HAS = "list_has_any(" + WS + ", [{}])"


def any_contains(col, needles):
    return "(" + " OR ".join(f"contains({col}, '{n}')" for n in needles) + ")"


def quoted(ws):
    return ", ".join(f"'{w}'" for w in ws)


@query(
    "adaptive_threshold",
    f"""WITH {st.MIXED}, q AS (SELECT *, len({WS}) AS n FROM mixed)
    SELECT query_id, CASE WHEN n = 1 OR {any_contains('lower(text)', qx.TECHNICAL_TERMS)} THEN 0.01 WHEN n <= 3 THEN 0.1 WHEN n > 6 THEN 0.3
      WHEN regexp_matches(text, '{qx.CAPITALISED}') OR contains(text, '_') THEN 0.05
      WHEN {any_contains('text', ['()', '.', '->', '=>', '::'])} THEN 0.25 ELSE 0.2 END::DOUBLE AS threshold FROM q""",
)
def adaptive_threshold(spark, d):
    return st.mixed_queries(spark, d).select("query_id", F.round(qx.adaptive_threshold(F.col("text")), 6).alias("threshold"))


@query(
    "preprocess_query",
    f"""WITH {st.MIXED}, x(word, exp) AS (VALUES {st.sql_values(list(qx.EXPANSIONS.items()))}),
    w AS (SELECT query_id, unnest({WS}) AS word, generate_subscripts({WS}, 1) AS pos FROM mixed),
    g AS (SELECT query_id, pos, 0 AS sub, word FROM w UNION ALL SELECT query_id, pos, i, string_split(exp, ' ')[i] FROM w JOIN x USING (word), LATERAL (SELECT unnest(generate_series(1, len(string_split(exp, ' ')))) AS i)),
    u AS (SELECT query_id, word, min(pos * 100 + sub) AS o FROM g GROUP BY ALL)
    SELECT query_id, string_agg(word, ' ' ORDER BY o) AS processed FROM u GROUP BY 1""",
)
def preprocess_query(spark, d):
    return st.mixed_queries(spark, d).select("query_id", qx.preprocess_query(F.col("text")).alias("processed"))


SYN_ROWS = [(k, s) for k, g in qx.SYNONYMS.items() for s in g]


@query(
    "expand_query",
    f"""WITH {st.MIXED}, syn(k, s) AS (VALUES {st.sql_values(SYN_ROWS)}), keys AS (SELECT DISTINCT k FROM syn),
    ord(k, o) AS (VALUES {st.sql_values([(k, i) for i, k in enumerate(qx.SYNONYMS)])}),
    rev AS (SELECT s, arg_max(k, o) AS k FROM syn JOIN ord USING (k) WHERE s NOT IN (SELECT k FROM keys) GROUP BY s),
    sub(token, rep) AS (SELECT k, s FROM syn UNION ALL SELECT s, k FROM rev),
    t AS (SELECT query_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ts FROM mixed),
    p AS (SELECT query_id, ts, unnest(generate_series(1, len(ts))) AS pos FROM t)
    SELECT query_id, text AS variant FROM mixed
    UNION SELECT query_id, array_to_string(list_concat(list_concat(ts[1:pos - 1], [rep]), ts[pos + 1:]), ' ') FROM p JOIN sub ON lower(ts[pos]) = token""",
)
def expand_query(spark, d):
    return st.mixed_queries(spark, d).select("query_id", F.explode(qx.expand_query(F.col("text"))).alias("variant"))


@query(
    "classify_query",
    f"""WITH {st.MIXED}, c AS (SELECT *, len({WS}) AS n,
      regexp_matches(text, '{qx.OPERATORS}') OR regexp_matches(text, '{qx.CAMEL}') OR regexp_matches(text, '{qx.SNAKE}') AS code FROM mixed)
    SELECT query_id, {' OR '.join(f"regexp_matches(text, '{p}')" for p in (qx.DOTTED, qx.CAMEL, qx.SCOPED, qx.HYPHENATED))} OR {HAS.format(quoted(qx.PACKAGE_WORDS))} AS identifier,
      NOT code AND n > 0 AND ({HAS.format(quoted(qx.INTENT_WORDS))} OR n >= 4) AS natural,
      CASE {' '.join(f"WHEN {any_contains('lower(text)', ns)} THEN '{name}'" for name, ns in qx.QUERY_TYPES)} ELSE 'general' END AS query_type,
      CASE WHEN n = 1 OR n > 10 THEN 'low' ELSE 'high' END AS confidence FROM c""",
)
def classify_query(spark, d):
    t = F.col("text")
    return st.mixed_queries(spark, d).select(
        "query_id", qx.is_identifier_query(t).alias("identifier"), qx.is_nl_query(t).alias("natural"), qx.query_type(t).alias("query_type"), qx.confidence(t).alias("confidence")
    )


@query("suggest_queries")
def suggest_queries(spark, d):
    return fusion.suggest_queries(text_hits(spark, d), st.mixed_queries(spark, d))


def emb(spark, d):
    return st.table(spark, d, "embeddings")


PAIRS = """pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, c.label AS label, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS cosine
      FROM embeddings q, embeddings c)"""
RANKED = """SELECT query_id, vec_id, round(1 - cosine, 6) AS distance, round(greatest(0, 1 - round(1 - cosine, 6) / 2), 7)::DOUBLE AS similarity, rank
    FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id))::INT AS rank FROM pairs{where})"""
E_COLS = dict(id_col="vec_id", vec_col="embedding", query_id="vec_id", query_vec="embedding")


@query("knn_exact", f"WITH {PAIRS} {RANKED.format(where='')} WHERE rank <= 10")
def knn_exact(spark, d):
    return vector.knn_exact(emb(spark, d), emb(spark, d), 10, **E_COLS)


@query("knn_exact_blocks", f"WITH {PAIRS} {RANKED.format(where='')} WHERE rank <= 10")
def knn_exact_blocks(spark, d):
    return vector.block_top_k(emb(spark, d), emb(spark, d), 10, block_rows=200, **E_COLS)


@query("knn_by_file", f"WITH {PAIRS} {RANKED.format(where=' WHERE label = 3')} WHERE rank <= 5")
def knn_by_file(spark, d):
    return vector.knn_by_file(emb(spark, d), emb(spark, d), "label", 3, 5, **E_COLS)


@query("similarity_threshold", f"WITH {PAIRS} SELECT * FROM ({RANKED.format(where='')} WHERE rank <= 20) WHERE similarity >= 0.7")
def similarity_threshold(spark, d):
    return vector.similarity_threshold(vector.knn_exact(emb(spark, d), emb(spark, d), 20, **E_COLS), 0.7)


@query(
    "semantic_links",
    f"""WITH {PAIRS} SELECT query_id AS source, vec_id AS target, similarity, rank FROM ({RANKED.format(where=' WHERE query_id <> vec_id')}) WHERE rank <= 5 AND similarity >= 0.3""",
)
def semantic_links(spark, d):
    return vector.semantic_links(emb(spark, d), id_col="vec_id", vec_col="embedding")


@query("get_vectors", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def get_vectors(spark, d):
    ids = st.table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return vector.get_vectors(emb(spark, d), ids, "vec_id").select("vec_id", "label")


@query("dimension_check", "SELECT len(embedding)::INT AS dimension, count(*) AS vectors, len(embedding) = 64 AS matches FROM embeddings GROUP BY ALL")
def dimension_check(spark, d):
    return vector.dimension_check(emb(spark, d), 64, "embedding")


def given_centres(spark, d):
    """The first vector of every label as the centre of its cell."""
    first = emb(spark, d).groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return emb(spark, d).join(first.select("vec_id"), "vec_id").select(F.col("label").cast("int").alias("cell"), F.transform("embedding", lambda x: x.cast("double")).alias("centroid"))


CELLS = f"""centres AS (SELECT label AS cell, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n = 1),
    {PAIRS}, near AS (SELECT query_id AS vec_id, arg_max(c.cell, (cosine, -c.cell)) AS cell FROM pairs p JOIN centres c ON c.vec_id = p.vec_id GROUP BY 1)"""


@query("ann_index", f"WITH {CELLS} SELECT vec_id, cell::INT AS cell FROM near")
def ann_index(spark, d):
    return vector.ann_assign(emb(spark, d), given_centres(spark, d), "vec_id", "embedding").select("vec_id", "cell")


@query(
    "ann_codes",
    f"""WITH {CELLS}, u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / n) AS u FROM (SELECT *, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)),
    l AS (SELECT near.vec_id, near.cell, list_transform(range(1, len(u.u) + 1), lambda i: u.u[i] - c.embedding[i]::DOUBLE) AS rest FROM near JOIN u USING (vec_id) JOIN centres USING (cell) JOIN embeddings c ON c.vec_id = centres.vec_id),
    s AS (SELECT cell, max(list_max(list_transform(rest, lambda x: abs(x)))) / 127 AS scale, count(*) AS vectors FROM l GROUP BY 1)
    SELECT cell::INT AS cell, vectors, round(scale, 6) AS scale FROM s""",
)
def ann_codes(spark, d):
    index = vector.quantised(vector.ann_assign(emb(spark, d), given_centres(spark, d), "vec_id", "embedding"), given_centres(spark, d), "vec_id", "embedding")
    return index.codes.groupBy("cell").agg(F.count("*").alias("vectors")).join(index.cells, "cell").select("cell", "vectors", F.round("scale", 6).alias("scale"))


@query(
    "ann_search",
    f"""WITH {CELLS}, probes AS (SELECT query_id, cell FROM (SELECT p.query_id, c.cell, row_number() OVER (PARTITION BY p.query_id ORDER BY cosine DESC, c.cell) AS n FROM pairs p JOIN centres c ON c.vec_id = p.vec_id) WHERE n <= 4),
    r AS (SELECT query_id, p.vec_id, cosine, (row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, p.vec_id))::INT AS rank FROM pairs p JOIN near n ON n.vec_id = p.vec_id JOIN probes USING (query_id, cell))
    SELECT query_id, vec_id, round(1 - cosine, 6) AS distance, round(greatest(0, 1 - round(1 - cosine, 6) / 2), 7)::DOUBLE AS similarity, rank FROM r WHERE rank <= 10""",
)
def ann_search(spark, d):
    path = scratch_path(spark, "quantised")
    centres = given_centres(spark, d)
    vector.quantised(vector.ann_assign(emb(spark, d), centres, "vec_id", "embedding"), centres, "vec_id", "embedding").write(path)
    index = vector.QuantisedIndex.read(spark, path, "vec_id", "embedding")
    return vector.quantised_search(index, emb(spark, d), 10, 4, 8, "vec_id", "embedding")


@query("ann_search_all_cells", f"WITH {PAIRS} {RANKED.format(where='')} WHERE rank <= 10")
def ann_search_all_cells(spark, d):
    assigned, centres = vector.ann_index(emb(spark, d), cells=8, id_col="vec_id", vec_col="embedding")
    return vector.ann_search(assigned, centres, emb(spark, d), 10, 8, block_rows=40, **E_COLS)


def letter_frequencies(texts):
    """Small demonstration embedder: letter counts."""
    return np.array([[t.lower().count(c) for c in "abcdefghijklmnop"] for t in texts], dtype=np.float32)


@query(
    "embed_chunks",
    f"WITH {st.CHUNKS} SELECT chunk_id, 16 AS dimension, len(regexp_replace(lower(content), '[^a-p]', '', 'g'))::DOUBLE AS total FROM chunks",
)
def embed_chunks(spark, d):
    out = vector.embed_chunks(st.chunks(spark, d), letter_frequencies, 16)
    return out.select("chunk_id", F.size("vector").alias("dimension"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("register_embedder", f"WITH {st.CHUNKS} SELECT chunk_id, 16 AS dimension FROM chunks")
def register_embedder(spark, d):
    from siftwell.functions import extensions as ext

    ext.register_embedder("letters", letter_frequencies, 16)
    out = ext.embed_with("letters", st.chunks(spark, d))
    return out.select("chunk_id", F.size("vector").alias("dimension"))


@query(
    "hash_vectors",
    f"WITH {st.VECTORS} SELECT chunk_id, b, round(w / n, 6) AS weight FROM bucketed JOIN cn USING (chunk_id)",
)
def hash_vectors(spark, d):
    v = vector.hash_vectors(st.corpus(spark, d), "chunk_id", "doc_text")
    return v.select("chunk_id", F.posexplode("vector").alias("b", "weight")).filter("weight > 0").withColumn("weight", F.round("weight", 6))


@query(
    "embedding_cache",
    f"""WITH {st.CHUNKS}, k AS (SELECT *, substr(sha256(content), 1, 16) AS cache_key FROM chunks),
    cache AS (SELECT DISTINCT cache_key FROM k WHERE lang = 'en')
    SELECT lang, count_if(cache.cache_key IS NOT NULL)::BIGINT AS hits, count_if(cache.cache_key IS NULL)::BIGINT AS misses FROM k LEFT JOIN cache USING (cache_key) GROUP BY lang""",
)
def embedding_cache(spark, d):
    ch = st.chunks(spark, d)
    cache = ch.filter("lang = 'en'").select(vector.content_key(F.col("content")).alias("cache_key")).distinct().withColumn("vector", F.array(F.lit(0.0)))
    hits, _ = vector.split_by_cache(ch, cache)
    n = hits.groupBy("lang").agg(F.count("*").alias("hits"))
    total = ch.groupBy("lang").agg(F.count("*").alias("n"))
    return total.join(n, "lang", "left").select("lang", F.coalesce("hits", F.lit(0)).alias("hits"), (F.col("n") - F.coalesce("hits", F.lit(0))).alias("misses"))


def both_lists(spark, d, k=50):
    """(vector hits, BM25 hits) of the benchmark queries over the chunks."""
    c, q = st.corpus(spark, d), st.search_queries(spark, d)
    v = vector.knn_exact(vector.hash_vectors(c, "chunk_id", "doc_text"), vector.hash_vectors(q, "query_id", "text"), k)
    return v, lexical.bm25_search(lexical.bm25_index(c), q, k)


HYBRID = st.VECTORS + """,
rr AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.chunk_id, b.chunk_id) AS chunk_id, coalesce(0.7 / (60 + v.rank), 0) + coalesce(0.3 / (60 + b.rank), 0) AS raw
  FROM (SELECT * FROM vec_rank WHERE rank <= 50) v FULL JOIN (SELECT * FROM bm_rank WHERE rank <= 50) b ON v.query_id = b.query_id AND v.chunk_id = b.chunk_id),
rf AS (SELECT query_id, chunk_id, round(raw / max(raw) OVER (PARTITION BY query_id), 8)::DOUBLE AS score FROM rr),
hy AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM rf)"""


@query("hybrid_rrf", f"WITH {HYBRID} SELECT query_id, chunk_id, score, rank FROM hy")
def hybrid_rrf(spark, d):
    v, b = both_lists(spark, d)
    return fusion.hybrid_rrf(v.select("query_id", "chunk_id", "rank"), b.select("query_id", "chunk_id", "rank"), 0.7)


@query(
    "hybrid_rrf_typed",
    f"""WITH {st.VECTORS}, rr AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.chunk_id, b.chunk_id) AS chunk_id,
       coalesce(0.2 / (60 + v.rank), 0) + coalesce(0.8 / (60 + b.rank), 0) AS raw
      FROM (SELECT * FROM vec_rank WHERE rank <= 50) v FULL JOIN (SELECT * FROM bm_rank WHERE rank <= 50) b ON v.query_id = b.query_id AND v.chunk_id = b.chunk_id),
    bt AS (SELECT rr.query_id, rr.chunk_id, raw * CASE WHEN (len(string_split(text, ' ')) > 30) = (lang IN ('en', 'fr')) THEN 1.15 ELSE 0.9 END AS raw FROM rr JOIN chunks USING (chunk_id) JOIN benchmark ON item_id = rr.query_id),
    rf AS (SELECT query_id, chunk_id, round(raw / max(raw) OVER (PARTITION BY query_id), 8)::DOUBLE AS score FROM bt)
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM rf""",
)
def hybrid_rrf_typed(spark, d):
    v, b = both_lists(spark, d)
    kinds = st.chunks(spark, d).select("chunk_id", F.when(F.col("lang").isin("en", "fr"), "text").otherwise("function").alias("kind"))
    nl = st.search_queries(spark, d).select("query_id", (F.size(F.split("text", " ")) > 30).alias("nl"))
    keep = v.select("query_id", "chunk_id").unionByName(b.select("query_id", "chunk_id")).distinct()
    facts = keep.join(kinds, "chunk_id").join(nl, "query_id")
    vv = v.select("query_id", "chunk_id", "rank").join(facts, ["query_id", "chunk_id"], "right").select("query_id", "chunk_id", "rank", "kind", "nl")
    return fusion.hybrid_rrf(vv, b.select("query_id", "chunk_id", "rank"), 0.2, F.col("kind"), F.col("nl"))


@query(
    "best_per_chunk",
    f"WITH {st.VECTORS} SELECT query_id, chunk_id, max(score) AS score FROM (SELECT query_id, chunk_id, similarity AS score FROM vec_rank WHERE rank <= 50 UNION ALL SELECT query_id, chunk_id, round(least(1, score / 10), 7) FROM bm_rank WHERE rank <= 50) GROUP BY ALL",
)
def best_per_chunk(spark, d):
    v, b = both_lists(spark, d)
    hits = v.select("query_id", "chunk_id", F.col("similarity").alias("score")).unionByName(b.select("query_id", "chunk_id", F.col("similarity").alias("score")))
    return lexical.best_per_chunk(hits)


STOP = ", ".join(f"'{w}'" for w in sp.STOP_TERMS)


@query(
    "rrf_three_way",
    f"""WITH {st.VECTORS}, {st.CHUNK_GRAPH}, und AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    tw AS (SELECT item_id AS query_id, {WS} AS all_ws FROM benchmark),
    pos AS (SELECT query_id, list_filter(all_ws, lambda w: len(w) >= 3 AND w NOT IN ({STOP})) AS ts FROM tw),
    qterms AS (SELECT query_id, term, min(nth) AS nth FROM (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS nth FROM pos) GROUP BY ALL),
    exact AS (SELECT term, min(id) AS id FROM (SELECT DISTINCT term FROM qterms) JOIN nodes ON name = term GROUP BY 1),
    part AS (SELECT term, min(id) AS id FROM (SELECT DISTINCT term FROM qterms WHERE term NOT IN (SELECT term FROM exact) AND term NOT IN ({quoted(g.GENERIC_LOOKUPS)})) JOIN nodes ON contains(lower(name), term) GROUP BY 1),
    named AS (SELECT * FROM exact UNION ALL SELECT * FROM part),
    seen AS (SELECT query_id, n.file_path, min((nth, n.id)) AS first_at FROM qterms JOIN named USING (term) JOIN und ON und.src = named.id AND und.dst <> named.id JOIN nodes n ON n.id = und.dst GROUP BY ALL),
    graph AS (SELECT query_id, file_path, row_number() OVER (PARTITION BY query_id ORDER BY first_at, file_path) AS rank FROM seen),
    l AS (SELECT query_id, file_path, start_line, content, rank, 'semantic' AS s FROM vec_rank JOIN chunks USING (chunk_id) WHERE rank <= 30
      UNION ALL SELECT query_id, file_path, start_line, content, rank, 'text' FROM bm_rank JOIN chunks USING (chunk_id) WHERE rank <= 30
      UNION ALL SELECT query_id, file_path, 0, '', rank, 'graph' FROM graph WHERE rank <= 30),
    f AS (SELECT query_id, file_path, start_line, any_value(content) AS content, array_to_string(list_sort(list_distinct(list(s))), ',') AS strategies, round(sum(1 / (60 + rank)), 6) AS score FROM l GROUP BY ALL),
    r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path, start_line))::INT AS rank FROM f WHERE score >= 0.01)
    SELECT * FROM r WHERE rank <= 10""",
)
def rrf_three_way(spark, d):
    nodes, edges = st.chunk_graph(spark, d)
    corpus = st.corpus(spark, d)
    vectors = vector.hash_vectors(corpus, "chunk_id", "doc_text")
    tables = sp.SearchTables(st.chunks(spark, d), lexical.bm25_index(corpus), vectors, nodes=nodes, edges=edges)
    return sp.three_way_search(tables, st.search_queries(spark, d)).select("query_id", "file_path", "start_line", "content", "strategies", "score", "rank")


def text_hits(spark, d, k=20):
    """BM25 hits with chunk columns and names."""
    b = lexical.bm25_search(lexical.bm25_index(st.corpus(spark, d)), st.search_queries(spark, d), k)
    c = st.chunks(spark, d).select(
        "chunk_id", "file_path", "content", "lang", "start_line", "end_line", "chunk_type", F.lit("python").alias("language"),
        F.regexp_extract("content", "[A-Za-z]+", 0).alias("function_name"), F.col("source").alias("class_name"),
    )
    q = st.search_queries(spark, d).select("query_id", F.col("text").alias("query_text"))
    return b.select("query_id", "chunk_id", F.col("similarity").alias("score"), "rank").join(c, "chunk_id").join(q, "query_id")


HITS = st.BM25_HITS + """,
hits AS (SELECT r.query_id, r.chunk_id, round(least(1.0, r.score / 10), 7) AS score, file_path, content, lang, start_line, end_line, chunk_type,
   regexp_extract(content, '[A-Za-z]+') AS function_name, source AS class_name, b.text AS query_text
   FROM bm_rank r JOIN chunks USING (chunk_id) JOIN benchmark b ON b.item_id = r.query_id WHERE rank <= 20)"""


@query(
    "rank_features",
    f"""WITH {HITS}, f AS (SELECT *, lower(query_text) AS q, list_distinct(list_filter(regexp_split_to_array(lower(query_text), '\\s+'), lambda w: w <> '')) AS qw,
       lower(string_split(file_path, '/')[-1]) AS fname, lower(function_name) AS fn, lower(class_name) AS cn FROM hits),
    g AS (SELECT *, len(list_filter(qw, lambda w: contains(lower(content), w))) AS found FROM f),
    s AS (SELECT query_id, chunk_id, round(greatest(0, least(1, score
        + CASE WHEN fn <> '' THEN CASE WHEN contains(fn, q) THEN 0.15 ELSE 0 END + 0.05 * len(list_filter(qw, lambda w: contains(fn, w))) ELSE 0 END
        + CASE WHEN contains(cn, q) THEN 0.15 ELSE 0 END + 0.05 * len(list_filter(qw, lambda w: contains(cn, w)))
        + CASE WHEN contains(fname, q) THEN 0.08 ELSE 0 END + 0.03 * len(list_filter(qw, lambda w: contains(fname, w)))
        + CASE WHEN found > 0 THEN found / len(qw) * 0.1 ELSE 0 END + 0.02)), 6)::DOUBLE AS score FROM g)
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM s""",
)
def rank_features(spark, d):
    return fusion.rank_features(text_hits(spark, d)).select("query_id", "chunk_id", "score", "rank")


BP = "CASE p_size % 6 WHEN 0 THEN 'main' WHEN 1 THEN '__init__' WHEN 2 THEN 'index' WHEN 3 THEN 'build' WHEN 4 THEN split_part(p_name, ' ', 1) ELSE 'to_s' END"
BL = "CASE p_partkey % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'dart' ELSE 'ruby' END"


@query(
    "boilerplate_penalty",
    f"""WITH b(l, n) AS (VALUES {st.sql_values([(k, n) for k, v in fusion.BOILERPLATE_NAMES.items() for n in v])}),
    h AS (SELECT p_partkey AS query_id, CASE WHEN p_size % 5 = 0 THEN 'the main index' ELSE p_name END AS query_text, {BP} AS function_name, {BL} AS language FROM part)
    SELECT query_id, function_name, language, CASE WHEN n IS NOT NULL AND NOT contains(lower(query_text), lower(function_name)) THEN -0.15 ELSE 0.0 END::DOUBLE AS boilerplate
    FROM h LEFT JOIN b ON lower(language) = l AND function_name = n""",
)
def boilerplate_penalty(spark, d):
    part = st.table(spark, d, "part")
    k, m = F.col("p_size") % 6, F.col("p_partkey") % 4
    name = F.when(k == 0, "main").when(k == 1, "__init__").when(k == 2, "index").when(k == 3, "build").when(k == 4, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise("to_s")
    lang = F.when(m == 0, "Python").when(m == 1, "typescript").when(m == 2, "dart").otherwise("ruby")
    hits = part.select(
        F.col("p_partkey").alias("query_id"), F.when(F.col("p_size") % 5 == 0, "the main index").otherwise(F.col("p_name")).alias("query_text"),
        name.alias("function_name"), lang.alias("language"),
    )
    return fusion.boilerplate_penalty(hits).drop("query_text")


@query(
    "quality_rerank",
    """WITH h AS (SELECT l_orderkey AS query_id, l_partkey * 10 + l_linenumber AS chunk_id, l_discount * 10 AS score, CASE WHEN l_quantity <= 10 THEN 'A' WHEN l_quantity <= 20 THEN 'B' WHEN l_quantity <= 30 THEN 'C' WHEN l_quantity <= 40 THEN 'D' END AS g,
      l_linenumber - 1 AS smells FROM lineitem),
    s AS (SELECT query_id, chunk_id, round(CASE WHEN g IS NULL THEN score ELSE 0.7 * score + 0.3 * greatest(0, least(100, CASE g WHEN 'A' THEN 100 WHEN 'B' THEN 80 WHEN 'C' THEN 60 ELSE 40 END - smells * 10 + CASE WHEN smells = 0 THEN 20 ELSE 0 END)) / 100 END, 6) AS score FROM h)
    SELECT query_id, chunk_id, score FROM s""",
)
def quality_rerank(spark, d):
    q = F.col("l_quantity")
    h = st.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), (F.col("l_discount") * 10).alias("score"),
        F.when(q <= 10, "A").when(q <= 20, "B").when(q <= 30, "C").when(q <= 40, "D").alias("complexity_grade"), (F.col("l_linenumber") - 1).alias("smell_count"),
        F.lit(None).cast("int").alias("quality_score"),
    )
    return fusion.quality_rerank(h).select("query_id", "chunk_id", "score")


@query(
    "kg_boost",
    f"""WITH {HITS}, {st.CHUNK_GRAPH}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    n AS (SELECT h.query_id, h.chunk_id, count(*) AS related FROM hits h JOIN both_ways w ON h.chunk_id = w.src JOIN nodes ON nodes.id = w.dst
      WHERE len(list_filter(regexp_split_to_array(lower(h.query_text), '\\s+'), lambda x: x <> '' AND contains(lower(nodes.name), x))) > 0 GROUP BY ALL)
    SELECT h.query_id, h.chunk_id, coalesce(related, 0) AS related, round(least(1.0, score + 0.02 * coalesce(related, 0)), 6)::DOUBLE AS score FROM hits h LEFT JOIN n USING (query_id, chunk_id)""",
)
def kg_boost(spark, d):
    nodes, edges = st.chunk_graph(spark, d)
    out = fusion.kg_boost(text_hits(spark, d).select("query_id", "chunk_id", "score"), edges, nodes, st.search_queries(spark, d))
    return out.select("query_id", "chunk_id", "related", "score")


@query(
    "context_boost",
    f"""WITH {HITS}, ctx AS (SELECT file_path, lower(text) AS t FROM files), names AS (SELECT DISTINCT lower(function_name) AS n FROM hits),
    seen AS (SELECT n FROM names WHERE EXISTS (SELECT 1 FROM ctx WHERE contains(t, n)))
    SELECT query_id, chunk_id, round(least(1.0, score + CASE WHEN file_path IN (SELECT file_path FROM ctx) THEN 0.1 ELSE 0 END
      + CASE WHEN lower(function_name) IN (SELECT n FROM seen) AND function_name <> '' THEN 0.05 ELSE 0 END
      + CASE WHEN EXISTS (SELECT 1 FROM ctx WHERE contains(t, lower(class_name))) THEN 0.05 ELSE 0 END), 6)::DOUBLE AS score FROM hits""",
)
def context_boost(spark, d):
    ctx = st.files(spark, d).select("file_path", "text")
    return fusion.context_boost(text_hits(spark, d), ctx).select("query_id", "chunk_id", "score")


@query(
    "context_lines",
    f"""WITH {HITS}, l AS (SELECT file_path, string_split(text, chr(10)) AS ls FROM files)
    SELECT query_id, chunk_id, array_to_string(list_transform(ls[greatest(1, start_line - 3):start_line - 1], lambda x: rtrim(x)), '|') AS before,
      array_to_string(list_transform(ls[end_line + 1:end_line + 3], lambda x: rtrim(x)), '|') AS after FROM hits JOIN l USING (file_path)""",
)
def context_lines(spark, d):
    out = fusion.context_lines(text_hits(spark, d), st.files(spark, d))
    return out.select("query_id", "chunk_id", F.array_join("context_before", "|").alias("before"), F.array_join("context_after", "|").alias("after"))


@query(
    "result_quality",
    f"""WITH {HITS}, b AS (SELECT query_id, round(avg(score), 3) AS average_score, count_if(score >= 0.8)::BIGINT AS high_quality, count_if(score >= 0.6 AND score < 0.8)::BIGINT AS medium_quality,
      count_if(score < 0.6)::BIGINT AS low_quality, round(count(DISTINCT file_path) / count(*), 3) AS diversity FROM hits GROUP BY 1),
    qw AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM benchmark),
    hw AS (SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(content), '\\s+')) AS w FROM hits),
    c AS (SELECT qw.query_id, round(count(hw.w) / count(*), 3) AS coverage FROM qw LEFT JOIN hw USING (query_id, w) GROUP BY 1)
    SELECT * FROM b JOIN c USING (query_id)""",
)
def result_quality(spark, d):
    return ag.result_quality(text_hits(spark, d), st.search_queries(spark, d))


@query(
    "pair_rerank",
    f"""WITH {HITS}, w AS (SELECT query_id, chunk_id, list_distinct(list_filter(regexp_split_to_array(lower(query_text), '\\s+'), lambda x: x <> '')) AS q,
      regexp_split_to_array(lower(content), '\\s+') AS c FROM hits),
    s AS (SELECT query_id, chunk_id, round(1 / (1 + exp(-(6.0::DOUBLE * len(list_intersect(q, c)) / len(q) - 3))), 6) AS score FROM w),
    r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 15""",
)
def pair_rerank(spark, d):
    return vector.pair_rerank(text_hits(spark, d), 5).select("query_id", "chunk_id", "score", "rank")


@query(
    "code_vector_enrich",
    f"""WITH {PAIRS}, r AS ({RANKED.format(where='')} WHERE rank <= 20), s AS (SELECT query_id, vec_id, similarity FROM ({RANKED.format(where='')}) WHERE rank <= 40)
    SELECT r.query_id, r.vec_id, round(CASE WHEN s.similarity >= 0.65 THEN least(1.0, r.similarity + 0.15) ELSE r.similarity END, 7)::DOUBLE AS score FROM r LEFT JOIN s USING (query_id, vec_id)""",
)
def code_vector_enrich(spark, d):
    main = vector.knn_exact(emb(spark, d), emb(spark, d), 20, **E_COLS)
    second = vector.knn_exact(emb(spark, d), emb(spark, d), 40, **E_COLS)
    return vector.code_vector_enrich(main, second, 0.65, id_col="vec_id").select("query_id", "vec_id", "score")


@query("mmr")
def mmr(spark, d):
    hits = vector.knn_exact(emb(spark, d), emb(spark, d), 30, **E_COLS)
    cand = hits.join(emb(spark, d).select("vec_id", F.col("embedding").alias("vector")), "vec_id")
    return vector.mmr(cand, 0.5, 10, score="similarity", id_col="vec_id")
