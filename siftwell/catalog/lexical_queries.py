"""Lexical search queries."""

from pyspark.sql import functions as F

from siftwell.catalog import standins as st
from siftwell.catalog.registry import query
from siftwell.functions import text as tx
from siftwell.operators import chunking, lexical
from siftwell.plans import index
from siftwell.runtime import scratch_path
from siftwell.sources import tables


@query("scan_chunks", f"WITH {st.FILES} SELECT doc_id, file_path, lang FROM files WHERE lang = 'fr'")
def scan_chunks(spark, d):
    path = scratch_path(spark, "stored")
    st.files(spark, d).withColumn("language", F.col("lang")).write.partitionBy("language").parquet(path)
    return tables.scan_chunks(spark, path, language="fr").select("doc_id", "file_path", "lang")


@query("tokenize", f"WITH {st.token_sql('toks', 'documents', 'doc_id', 'text')} SELECT doc_id, term, tf FROM toks")
def tokenize(spark, d):
    return tx.token_counts(st.files(spark, d), "doc_id", "text")


@query("chunk_text", f"WITH {st.CHUNKS} SELECT chunk_id, file_path, start_line, end_line, content FROM chunks")
def chunk_text(spark, d):
    return st.chunks(spark, d).select("chunk_id", "file_path", "start_line", "end_line", "content")


@query("chunk_id", f"WITH {st.CHUNKS} SELECT chunk_id, count(*) AS copies FROM chunks GROUP BY chunk_id")
def chunk_id(spark, d):
    return st.chunks(spark, d).groupBy("chunk_id").agg(F.count("*").alias("copies"))


@query(
    "bm25_index",
    f"""WITH {st.BM25}
    SELECT term, df, round(idf, 6) AS idf, sum(tf)::BIGINT AS tf
    FROM terms JOIN postings USING (term) GROUP BY ALL""",
)
def bm25_index(spark, d):
    ix = lexical.bm25_index(st.corpus(spark, d))
    totals = ix.postings.groupBy("term").agg(F.sum("tf").alias("tf"))
    return ix.terms.join(totals, "term").select("term", "df", F.round("idf", 6).alias("idf"), "tf")


@query(
    "bm25_search",
    f"""WITH {st.BM25_HITS}
    SELECT query_id, chunk_id, score, rank, round(least(1.0, score / 10), 7) AS similarity
    FROM bm_rank WHERE rank <= 10""",
)
def bm25_search(spark, d):
    return lexical.bm25_search(lexical.bm25_index(st.corpus(spark, d)), st.search_queries(spark, d), 10)


@query(
    "assign_rank",
    f"WITH {st.BM25_HITS} SELECT query_id, chunk_id, rank FROM bm_rank",
)
def assign_rank(spark, d):
    hits = lexical.bm25_scores(lexical.bm25_index(st.corpus(spark, d)), st.search_queries(spark, d))
    return lexical.assign_rank(hits).select("query_id", "chunk_id", "rank")


def first_version(spark, d):
    """documents as they were before: every fifth otherwise, every seventh not there yet, and some that are gone now."""
    f = st.files(spark, d)
    old = f.filter("doc_id % 7 <> 3").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("older words\n"), F.reverse("text"))).otherwise(F.col("text")))
    return old.unionByName(f.filter("doc_id % 11 = 4").withColumn("file_path", F.concat(F.lit("gone/"), "file_path")))


def updated_index(spark, d):
    """A stored index of the first version, brought to the documents as they are."""
    cut = lambda f: chunking.chunk_text(f.select("file_path", "doc_id", "lang", "source", "text"), mode="lines")
    document = lexical.document_text(F.col("content"), path=F.col("file_path"), kind=F.col("chunk_type"))
    ix = index.StoredIndex(spark, scratch_path(spark, "index"), cut, document, buckets=8)
    for files in (first_version(spark, d), st.files(spark, d)):
        ix.update(files.withColumn("file_hash", index.file_hash(F.col("text"))))
    return ix


@query("stored_index_terms", f"WITH {st.BM25}, c AS (SELECT term, sum(tf)::BIGINT AS cf FROM postings GROUP BY 1) SELECT term, df, cf FROM terms JOIN c USING (term)")
def stored_index_terms(spark, d):
    return updated_index(spark, d).read("terms").select("term", "df", "cf")


@query(
    "stored_index_search",
    f"""WITH {st.BM25_HITS}
    SELECT query_id, chunk_id, score, rank, round(least(1.0, score / 10), 7) AS similarity
    FROM bm_rank WHERE rank <= 10""",
)
def stored_index_search(spark, d):
    return lexical.bm25_search(updated_index(spark, d).lexical_index(), st.search_queries(spark, d), 10)
