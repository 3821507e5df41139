"""The full search over a table of queries, composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions import extensions
from siftwell.functions import queries as qx
from siftwell.functions import text as tx
from siftwell.operators import fusion, graph, joins, lexical, predicates, vector
from siftwell.runtime import cut_lineage, fixed_table, number_in_group


@dataclass(frozen=True)
class SearchTables:
    """Everything a search reads. ``nodes`` / ``edges`` and ``files`` are optional.

    chunks: chunk_id, file_path, content, chunk_type, language, function_name, class_name, start_line, end_line.
    ``embedder`` makes query vectors like those in ``vectors``: a registered name, or None for hashed tokens. ``code_vectors`` (chunk_id, vector) is a
    second space of the same dimension, whose near hits lift those of the first.
    """

    chunks: DataFrame
    index: lexical.Bm25Index
    vectors: DataFrame
    dimension: int = 64
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    files: DataFrame | None = None
    embedder: str | None = None
    code_vectors: DataFrame | None = None

    def query_vectors(self, variants: DataFrame) -> DataFrame:
        """(variant_id, vector) of the query variants, of the stored vectors' dimension."""
        if self.embedder is None:
            return vector.hash_vectors(variants, "variant_id", "variant", self.dimension)
        made = extensions.EMBEDDERS[self.embedder].dimension
        if made != self.dimension:
            raise ValueError(f"{self.embedder} makes vectors of {made} numbers, the table holds {self.dimension}")
        return extensions.embed_with(self.embedder, variants.select("variant_id", "variant"), "queries", "variant").select("variant_id", "vector")


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 10
    mode: str = "hybrid"
    alpha: float = 0.7
    threshold: float | None = None
    expand: bool = True
    rerank: bool = True
    rerank_top_n: int = 50
    mmr: bool = True
    diversity: float = 0.5
    tests_only: bool = False
    context: bool = False
    filters: dict | None = None
    scorer: vector.Scorer | None = None
    path_glob: str | None = None
    quality: dict | None = None
    quality_rerank: bool = False
    enrich: bool = True
    enrich_threshold: float = 0.65


def prepared_queries(queries: DataFrame, opts: SearchOptions) -> DataFrame:
    """Queries with threshold, vector weight, language flag and processed text; one row per variant."""
    text = F.col("text")
    threshold = F.lit(opts.threshold) if opts.threshold is not None else qx.adaptive_threshold(text)
    lexical_first = (F.lit(opts.alpha) == 0.7) & qx.is_identifier_query(text)
    base = queries.filter(F.trim("text") != "").select(
        "query_id", "text", threshold.alias("threshold"), F.when(lexical_first, 0.2).otherwise(opts.alpha).alias("alpha"),
        qx.preprocess_query(text).alias("processed"),
    )
    texts = qx.expand_query(F.col("processed")) if opts.expand else F.array("processed")
    out = base.select("*", F.posexplode(texts).alias("_v", "variant"))
    return out.withColumn("variant_id", F.concat_ws("#", F.col("query_id").cast("string"), F.col("_v").cast("string"))).withColumn(
        "natural", qx.is_nl_query(F.col("variant"))
    ).drop("_v")


def search(tables: SearchTables, queries: DataFrame, opts: SearchOptions | None = None, files: DataFrame | None = None) -> DataFrame:
    """Ranked hits of every query: query_id, chunk_id, score, rank and the chunk columns.

    Options also take a path glob and quality limits (``predicates.filter_quality``) before the search, a second vector space that lifts near hits, and a re-rank by
    the chunks' quality columns at the end. ``files`` (file_path) narrows the search to some files. Filters are applied before retrieval in every mode. All queries and variants
    are one job: vectors are scanned once, and postings meet only asked terms.
    """
    opts = opts or SearchOptions()
    chunks = predicates.where_filters(tables.chunks, opts.filters or {})
    if opts.tests_only:
        chunks = predicates.filter_tests_only(chunks, name="function_name")
    if opts.path_glob:
        chunks = predicates.filter_path_glob(chunks, opts.path_glob)
    if opts.quality:
        chunks = predicates.filter_quality(chunks, **opts.quality)
    if files is not None:
        chunks = chunks.join(files.select("file_path").distinct(), "file_path", "left_semi")
    narrowed = bool(opts.filters or opts.path_glob or opts.quality) or opts.tests_only or files is not None
    allowed = chunks.select("chunk_id")
    variants = cut_lineage(prepared_queries(queries, opts))
    depth = opts.rerank_top_n if opts.rerank else opts.limit
    keys = variants.select("variant_id", "query_id", "threshold", "alpha", "natural")

    vec_hits = text_hits = None
    if opts.mode in ("hybrid", "vector"):
        space = tables.vectors.join(allowed, "chunk_id", "left_semi") if narrowed else tables.vectors
        asked = tables.query_vectors(variants)
        near = vector.knn_exact(space, asked, depth, query_id="variant_id")
        if tables.code_vectors is not None and opts.enrich:
            second = tables.code_vectors.join(allowed, "chunk_id", "left_semi") if narrowed else tables.code_vectors
            code = vector.knn_exact(second, asked, 2 * depth, query_id="variant_id")
            lifted = vector.code_vector_enrich(near, code, opts.enrich_threshold)
            near = lexical.assign_rank(lifted.select("query_id", "chunk_id", "score"), depth).withColumnRenamed("score", "similarity")
        near = near.withColumnRenamed("query_id", "variant_id")
        vec_hits = near.join(keys, "variant_id").filter(F.col("similarity") >= F.col("threshold"))
    if opts.mode in ("hybrid", "bm25"):
        top = lexical.bm25_search(tables.index, variants, depth, "variant", "variant_id", allowed if narrowed else None)
        text_hits = top.withColumnRenamed("query_id", "variant_id").withColumn("similarity", F.least(F.lit(1.0), F.col("score") / 10))

    if opts.mode == "hybrid":
        v = vec_hits.select(F.col("variant_id").alias("query_id"), "chunk_id", "rank")
        b = text_hits.select(F.col("variant_id").alias("query_id"), "chunk_id", "rank")
        ids = v.select("query_id", "chunk_id").unionByName(b.select("query_id", "chunk_id")).distinct()
        facts = ids.join(keys.select(F.col("variant_id").alias("query_id"), "alpha", "natural"), "query_id").join(chunks.select("chunk_id", "chunk_type"), "chunk_id")
        v = facts.join(v, ["query_id", "chunk_id"], "left")
        fused = fusion.hybrid_rrf(v, b, F.col("alpha"), F.col("chunk_type"), F.col("natural")).withColumnRenamed("query_id", "variant_id")
        raw = fused.join(keys.select("variant_id", "query_id"), "variant_id").select("query_id", "chunk_id", "score")
    elif opts.mode == "vector":
        raw = vec_hits.select("query_id", "chunk_id", F.col("similarity").alias("score"))
    else:
        raw = text_hits.join(keys.select("variant_id", "query_id"), "variant_id").select("query_id", "chunk_id", F.col("similarity").alias("score"))

    best = lexical.assign_rank(lexical.best_per_chunk(raw), depth)
    texts = queries.select("query_id", F.col("text").alias("query_text"))
    hits = cut_lineage(best.join(chunks, "chunk_id").join(texts, "query_id"))
    if opts.rerank and opts.mode != "bm25":
        hits = vector.pair_rerank(hits, opts.limit, opts.scorer)
    hits = lexical.assign_rank(hits.drop("rank"), opts.limit * 3)
    if opts.mmr and opts.mode != "bm25":
        chosen = vector.mmr(hits.select("query_id", "chunk_id", "score", "rank").join(tables.vectors, "chunk_id"), opts.diversity, opts.limit)
        hits = hits.join(chosen.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    else:
        hits = hits.filter(F.col("rank") <= opts.limit)
    hits = hits.drop("rank")
    if tables.nodes is not None and tables.edges is not None:
        hits = fusion.kg_boost(hits, tables.edges, tables.nodes, queries).drop("related")
    if tables.files is not None:
        hits = joins.stale_result_filter(hits, tables.files)
        if opts.context:
            hits = fusion.context_lines(hits, tables.files)
    ranked = fusion.rank_features(hits)
    if opts.quality_rerank:
        ranked = fusion.quality_rerank(ranked.drop("rank"))
    return ranked


# Words that name nothing, and the least fused score that counts.
STOP_TERMS = ["a", "an", "the", "is", "in", "at", "of", "on", "to", "and", "or", "for", "with", "by", "from", "as", "be", "this", "that", "it", "its", "are", "was", "were"]
LEAST_FUSED = 0.01


def graph_hits(queries: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int | None = None, max_terms: int | None = None) -> DataFrame:
    """(query_id, file_path, rank): files of what the entities named in a query are directly related to.

    Terms of three letters or more name an entity exactly or as part of its name. A file stands at its first term, then the related id; all
    files and terms count, or the first ``limit`` and ``max_terms``.
    """
    words = F.array_distinct(F.filter(tx.words(F.col("text")), lambda w: (F.length(w) >= 3) & ~w.isin(STOP_TERMS)))
    terms = queries.select("query_id", F.posexplode(words).alias("_nth", "query_name"))
    if max_terms is not None:
        terms = terms.filter(F.col("_nth") < max_terms)
    terms = cut_lineage(terms)
    named = cut_lineage(graph.find_entity(nodes, terms.select("query_name").distinct()))
    related = graph.find_related(edges, named.select(F.col("id").alias("start")).distinct(), 1)
    files = nodes.select(F.col("id").alias("node"), "file_path").filter(F.coalesce("file_path", F.lit("")) != "")
    seen = terms.join(named, "query_name").join(related.withColumnRenamed("start", "id"), "id").join(files, "node")
    first = seen.groupBy("query_id", "file_path").agg(F.min(F.struct("_nth", "node")).alias("_at"))
    ranked = number_in_group(first.select("query_id", "file_path", "_at._nth", "_at.node"), ["query_id"], ["_nth", "node", "file_path"], "rank")
    ranked = ranked.select("query_id", "file_path", F.col("rank").cast("int").alias("rank"))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def three_way_search(tables: SearchTables, queries: DataFrame, limit: int = 10, strategies: Sequence[str] = ("semantic", "text", "graph"), least: float = LEAST_FUSED) -> DataFrame:
    """(query_id, file_path, start_line, content, strategies, score, rank): vector, text and graph lists of a batch of queries, fused by place.

    Each list is three times as deep as the result; fused scores below ``least`` leave. A graph hit stands for a
    file as a whole (line 0, no content). The lists of all queries are one job each.
    """
    asked = queries.select("query_id", "text").filter(F.trim("text") != "")
    place = tables.chunks.select("chunk_id", "file_path", "start_line", "content")
    lists = {}
    if "semantic" in strategies:
        own = tables.query_vectors(asked.select(F.col("query_id").alias("variant_id"), F.col("text").alias("variant")))
        lists["semantic"] = vector.knn_exact(tables.vectors, own, 3 * limit, query_id="variant_id").select("query_id", "chunk_id", "rank").join(place, "chunk_id")
    if "text" in strategies:
        lists["text"] = lexical.bm25_search(tables.index, asked, 3 * limit).select("query_id", "chunk_id", "rank").join(place, "chunk_id")
    if "graph" in strategies and tables.nodes is not None and tables.edges is not None:
        found = graph_hits(asked, tables.nodes, tables.edges, 3 * limit)
        lists["graph"] = found.select("query_id", "file_path", F.lit(0).cast(place.schema["start_line"].dataType).alias("start_line"), F.lit("").alias("content"), "rank")
    if not lists:
        raise ValueError(f"no list to fuse for {list(strategies)}")
    fused = fusion.rrf_three_way(lists).filter(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "file_path", "start_line")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def search_similar(tables: SearchTables, chunk_ids: DataFrame, opts: SearchOptions | None = None) -> DataFrame:
    """Search with stored chunks as queries; a chunk is not its own result and takes no other's place."""
    opts = opts or SearchOptions()
    wider = replace(opts, limit=opts.limit + 1, rerank_top_n=opts.rerank_top_n + 1)
    queries = tables.chunks.join(chunk_ids.select("chunk_id"), "chunk_id", "left_semi").select(F.col("chunk_id").alias("query_id"), F.col("content").alias("text"))
    others = search(tables, queries, wider).filter(F.col("query_id") != F.col("chunk_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))
    return others.withColumn("rank", place).filter(F.col("rank") <= opts.limit).select(*others.columns)


def search_by_context(tables: SearchTables, requests: DataFrame, opts: SearchOptions | None = None) -> DataFrame:
    """Search with a description and a list of focus areas per request."""
    queries = requests.select("query_id", F.concat_ws(" ", "description", F.array_join("focus_areas", " ")).alias("text"))
    return search(tables, queries, opts)


# Canned queries of review kinds.
REVIEW_QUERIES = {
    "security": [
        "authentication login password credential", "sql query database execute", "user input validation sanitize",
        "file upload path traversal", "encryption hash token secret key", "permission authorization access control",
    ],
    "architecture": [
        "class definition inheritance", "import module dependency", "configuration settings", "error handling exception",
        "interface abstract base class",
    ],
    "performance": [
        "database query loop iteration", "cache memory buffer pool", "async await concurrent parallel",
        "file read write io operation", "sort search algorithm complexity",
    ],
    "quality": [
        "duplicate code repeated logic", "long method function lines", "magic number hardcoded value", "dead code unreachable",
        "complex boolean condition", "error handling exception",
    ],
    "testing": [
        "test function method coverage", "edge case boundary null empty", "mock fixture setup teardown",
        "assert expect verify test", "integration test e2e", "pytest unittest spec test",
    ],
    "documentation": [
        "docstring documentation comment", "TODO FIXME HACK", "parameter return type annotation", "example usage demo",
        "module package description", "api endpoint documentation",
    ],
}


def canned_reviews(spark: SparkSession, kinds: list[str] | None = None) -> DataFrame:
    """(review_id, text) rows of the canned queries."""
    rows = [(k, q) for k in (kinds or REVIEW_QUERIES) for q in REVIEW_QUERIES[k]]
    return fixed_table(spark, rows, "review_id string, text string")


def review_gather(tables: SearchTables, reviews: DataFrame, changed: DataFrame | None = None, limit: int = 30) -> DataFrame:
    """(review_id, chunk_id, score): best score per chunk over the queries of a review, optionally in changed files only.

    ``reviews`` holds review_id and text, one row per canned query.
    """
    queries = reviews.withColumn("query_id", F.concat_ws("/", "review_id", F.md5(F.col("text").cast("binary"))))
    hits = search(tables, queries.select("query_id", "text"), SearchOptions(limit=limit, rerank=False, mmr=False), changed)
    best = hits.join(queries.select("query_id", "review_id"), "query_id").groupBy("review_id", "chunk_id").agg(F.max("score").alias("score"))
    ranked = lexical.assign_rank(best, limit, query_id="review_id")
    return ranked
