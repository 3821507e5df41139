"""BM25 index and search over tables of chunks and tables of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from siftwell.functions import text as tx
from siftwell.operators.packing import pack_columns, unpack_columns
from siftwell.runtime import cut_lineage

# Chunks of a bucket of the block layout, asked (query, term) rows that travel to every task, and buckets from which a first pass sets the bar.
BUCKET_CHUNKS = 4096
MAX_ASKED_ROWS = 2_000_000
SEED_BUCKETS = 64
# Hits of a query that are ranked at a time, hits that are packed at a time, and steps of the score's logarithm by which they are dealt.
RANKED_ROWS, PACKED_HITS, SCORE_STEPS = 500_000, 1_000_000, 128

# Okapi constants.
K1 = 1.5
B = 0.75
NEGATIVE_IDF_SHARE = 0.25


@dataclass(frozen=True)
class Bm25Index:
    """postings(term, chunk_id, tf, dl) and terms(term, df, idf, norm).

    ``idf`` already holds the replacement for negative values; ``avgdl`` rides
    on the term rows so that scoring needs no further pass over the corpus.
    """

    postings: DataFrame
    terms: DataFrame

    def write(self, path: str, partitions: int | None = None) -> None:
        """Postings clustered by term, so a query batch reads few row groups."""
        postings = self.postings.repartitionByRange(partitions, "term", "chunk_id") if partitions else (
            self.postings.repartitionByRange("term", "chunk_id")
        )
        postings.sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def read(spark: SparkSession, path: str) -> "Bm25Index":
        return Bm25Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"))


def document_text(content: Column, name: Column | None = None, path: Column | None = None, kind: Column | None = None) -> Column:
    """Indexed text: content, the name twice, the path and the chunk type; empty parts left out."""
    parts = [content] + ([name, name] if name is not None else []) + [p for p in (path, kind) if p is not None]
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def bm25_index(docs: DataFrame, doc_id: str = "chunk_id", text: str = "doc_text", materialize: bool = True) -> Bm25Index:
    """Postings and term statistics.

    One token pass and one shuffle of the texts by chunk: terms are counted and
    summed to document lengths text by text. Term
    statistics aggregate the postings with partial sums, so a term held by a
    third of all chunks stays one partial row per task. ``materialize`` writes
    the postings once (checkpoint), as they are read by several later steps.
    """
    base = docs.select(F.col(doc_id).alias("chunk_id"), F.col(text).alias("doc_text"))
    postings = chunk_postings(base)
    if materialize:
        postings = cut_lineage(postings)
    counts = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return Bm25Index(postings, term_facts(counts, base.agg(F.count("*")).scalar(), materialize))


def chunk_postings(docs: DataFrame) -> DataFrame:
    """(chunk_id, term, tf, dl) of (chunk_id, doc_text); dl is the number of all tokens of the chunk."""
    return tx.token_rows(docs, "chunk_id", "doc_text")


def term_facts(counts: DataFrame, n: Column | int, materialize: bool = True) -> DataFrame:
    """(term, df, idf, avgdl) from counts(term, df, cf) over ``n`` chunks; a negative idf becomes a share of the mean."""
    raw = counts.withColumn("n", n if isinstance(n, Column) else F.lit(n))
    raw = raw.withColumn("raw_idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    if materialize:
        raw = cut_lineage(raw)
    facts = raw.agg(
        F.struct((F.avg("raw_idf") * NEGATIVE_IDF_SHARE).alias("floor"), (F.sum("cf") / F.max("n")).alias("avgdl"))
    ).scalar()
    return raw.withColumn("_facts", facts).select(
        "term",
        "df",
        F.when(F.col("raw_idf") < 0, F.col("_facts.floor")).otherwise(F.col("raw_idf")).alias("idf"),
        F.col("_facts.avgdl").alias("avgdl"),
    )


def query_terms(queries: DataFrame, text: str = "text", query_id: str = "query_id") -> DataFrame:
    """(query_id, term, qtf): a token asked twice counts twice."""
    return tx.token_counts(queries, query_id, text).select(
        F.col(query_id).alias("query_id"), "term", F.col("tf").alias("qtf")
    )


def bm25_scores(index: Bm25Index, queries: DataFrame, text: str = "text", query_id: str = "query_id") -> DataFrame:
    """All positive (query_id, chunk_id, score). Only postings of asked terms take part.

    They move once, to the bucket of their chunk, and the scores of all queries are added up there. A batch that
    asks too many terms to travel is joined with the postings instead.
    """
    asked = query_terms(queries, text, query_id).join(index.terms, "term")
    hits = _bucket_scores(index, asked)
    if hits is None:
        norm = 1 - B + B * F.col("dl") / F.col("avgdl")
        part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
        summed = index.postings.join(asked, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))
        return summed.filter(F.col("score") > 0)
    return hits


def _bucket_scores(index: "Bm25Index", asked: DataFrame, k: int | None = None) -> DataFrame | None:
    """(query_id, chunk_id, score) of every positive score for the asked (query_id, term, qtf, idf), or None if they are too many to travel.

    With ``k`` only those stay that can be among a query's best k: k of a bucket at most.
    """
    head = asked.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")).limit(MAX_ASKED_ROWS + 1).toArrow()
    if head.num_rows > MAX_ASKED_ROWS:
        return None
    query_type = dict(asked.dtypes)["query_id"]
    spark = index.postings.sparkSession
    sent = spark.sparkContext.broadcast(head.sort_by([("query_id", "ascending"), ("term", "ascending")]))
    terms = spark.createDataFrame([(t,) for t in head.column("term").unique().to_pylist()], "term string")
    placed, buckets = _placed(Bm25Index(index.postings.join(F.broadcast(terms), "term", "left_semi"), index.terms), BUCKET_CHUNKS)
    id_type = dict(index.postings.dtypes)["chunk_id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Asked(sent.value)
        bar = np.zeros(len(own.queries))
        for _, rows in _by_bucket(batches):
            ids = rows.column("chunk_id").combine_chunks().dictionary_encode()
            by_id = pc.sort_indices(ids.dictionary)
            found = ids.dictionary.take(by_id)
            place = np.empty(len(found), np.int64)
            place[by_id.to_numpy()] = np.arange(len(found))
            term = pc.index_in(rows.column("term").combine_chunks(), own.terms).to_numpy()
            slot, weights = place[ids.indices.to_numpy()], rows.column("weight").to_numpy()
            order = np.lexsort((slot, term))
            edges = np.flatnonzero(np.diff(term[order], prepend=-1))
            slot, weights = slot[order], weights[order]
            lists = [(slot[a:b], weights[a:b]) for a, b in zip(edges, [*edges[1:], len(order)], strict=True)]
            n = len(found)
            if k is None:
                bar[:] = 0
            query, at, value, _ = score_bucket(own, term[order][edges], np.maximum.reduceat(weights, edges), lists, n, n + 1 if k is None else k, bar)
            yield pa.RecordBatch.from_arrays([own.queries.take(pa.array(query)), found.take(pa.array(at)), pa.array(value, pa.float64())], ["query_id", "chunk_id", "score"])

    laid = placed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return laid.mapInArrow(score, f"query_id {query_type}, chunk_id {id_type}, score double")


@dataclass(frozen=True)
class Bm25Blocks:
    """Postings by bucket of chunks, with score bounds: lists(bucket, term, top, slots, weights, ids).

    A row holds one term's postings within one bucket: the places of the chunks in
    it, their weights, and ``top``, the highest of them. The row without a term holds
    the bucket's chunk ids in order, so ``slots`` count them. terms(term, idf) is that of the index.
    """

    lists: DataFrame
    terms: DataFrame
    buckets: int

    def write(self, path: str) -> None:
        """Lists sorted by term within files of whole buckets, so that a batch of queries reads few row groups."""
        self.lists.repartition("bucket").sortWithinPartitions("term", "bucket").write.mode("overwrite").parquet(f"{path}/lists")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def read(spark: SparkSession, path: str) -> "Bm25Blocks":
        lists = spark.read.parquet(f"{path}/lists")
        return Bm25Blocks(lists, spark.read.parquet(f"{path}/terms"), lists.filter("term IS NULL").count())


def _placed(index: Bm25Index, chunks_per_bucket: int) -> tuple[DataFrame, int]:
    """(bucket, chunk_id, term, weight) of the postings, and the number of buckets; a weight is the posting's part of a score without idf."""
    chunks = index.postings.agg(F.count_distinct("chunk_id")).first()[0]
    buckets = max(1, -(-chunks // chunks_per_bucket))
    avgdl = index.terms.agg(F.max("avgdl")).scalar()
    norm = 1 - B + B * F.col("dl") / F.col("_avgdl")
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    placed = index.postings.withColumn("_avgdl", avgdl).select(
        F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int").alias("bucket"), "chunk_id", "term", weight.alias("weight")
    )
    return placed, buckets


def bm25_blocks(index: Bm25Index, chunks_per_bucket: int = BUCKET_CHUNKS, materialize: bool = True) -> Bm25Blocks:
    """The block layout of an index: one shuffle of its postings, by bucket of the chunk id's hash.

    There are as many tasks as buckets, so that a task sorts about one bucket however large the index is.
    """
    placed, buckets = _placed(index, chunks_per_bucket)
    id_type = dict(index.postings.dtypes)["chunk_id"]
    schema = f"bucket int, term string, top double, slots array<int>, weights array<double>, ids array<{id_type}>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            found = rows.column("chunk_id").combine_chunks().dictionary_encode()
            terms = rows.column("term").combine_chunks().dictionary_encode()
            by_id = pc.sort_indices(found.dictionary)
            ids, place = found.dictionary.take(by_id), np.empty(len(by_id), np.int32)
            place[by_id.to_numpy()] = np.arange(len(by_id), dtype=np.int32)
            slot, term = place[found.indices.to_numpy()], terms.indices.to_numpy()
            order = np.lexsort((slot, term))
            edges = np.flatnonzero(np.diff(term[order], prepend=-1)).tolist()
            weights = rows.column("weight").to_numpy()[order]
            offsets = pa.array([*edges, len(order)], pa.int32())
            n = len(edges)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, bucket), pa.int32()), terms.dictionary.take(pa.array(term[order][edges], pa.int32())),
                    pa.array(np.maximum.reduceat(weights, edges)), pa.ListArray.from_arrays(offsets, pa.array(slot[order], pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(weights)), pa.nulls(n, pa.list_(ids.type)),
                ],
                names,
            )
            own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            none = [pa.nulls(1, t) for t in (pa.string(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *none, own], names)

    names = [c.split(" ")[0] for c in schema.split(", ")]
    lists = placed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(pack, schema)
    return Bm25Blocks(cut_lineage(lists) if materialize else lists, index.terms, buckets)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(bucket, rows) of a stream sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        buckets = batch.column("bucket").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                if held and held[0].column("bucket")[0].as_py() != buckets[a]:
                    yield held[0].column("bucket")[0].as_py(), pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column("bucket")[0].as_py(), pa.Table.from_batches(held)


class _Asked:
    """A batch of queries as arrays: for each term the queries that ask it and with what weight."""

    def __init__(self, rows: pa.Table) -> None:
        queries = rows.column("query_id").combine_chunks().dictionary_encode()
        terms = rows.column("term").combine_chunks().dictionary_encode()
        self.queries, self.terms = queries.dictionary, terms.dictionary
        order = np.argsort(terms.indices.to_numpy(), kind="stable")
        self.query, self.weight = queries.indices.to_numpy()[order], rows.column("weight").to_numpy()[order]
        self.starts = np.searchsorted(terms.indices.to_numpy()[order], np.arange(len(self.terms) + 1))


def score_bucket(asked: _Asked, term: np.ndarray, top: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, slot, score) of the best ``k`` of one bucket for each query, and how many queries were scored.

    ``term`` numbers the bucket's ``lists`` in ``asked``. A query whose terms' highest
    weights add up to less than its ``bar``, the score of its k-th best hit so far, is passed over. ``bar`` is raised.
    """
    sizes = asked.starts[term + 1] - asked.starts[term]
    at = np.arange(sizes.sum()) + np.repeat(asked.starts[term] - np.cumsum(sizes) + sizes, sizes)
    which, query, weight = np.repeat(np.arange(len(term)), sizes), asked.query[at], asked.weight[at]
    bound = np.bincount(query, np.maximum(weight * top[which], 0), len(bar)) if len(query) else np.zeros(len(bar))
    wanted = (bound > 0) & (bound + 1e-5 >= bar)
    keep = wanted[query]
    order = np.argsort(query[keep], kind="stable")
    which, query, weight = which[keep][order], query[keep][order], weight[keep][order]
    edges = np.flatnonzero(np.diff(query, prepend=-1)).tolist()
    out: list[tuple] = []
    for a, b in zip(edges, [*edges[1:], len(query)], strict=True):
        slots = np.concatenate([lists[i][0] for i in which[a:b]])
        parts = np.concatenate([lists[i][1] * w for i, w in zip(which[a:b], weight[a:b], strict=True)])
        scores = np.round(np.bincount(slots, parts, size), 6)
        q = query[a]
        hits = np.flatnonzero((scores > 0) & (scores >= bar[q]))
        if len(hits) > k:
            hits = hits[scores[hits] >= np.partition(scores[hits], len(hits) - k)[len(hits) - k]]
        best = hits[np.lexsort((hits, -scores[hits]))][:k]
        if len(best) == k:
            bar[q] = max(bar[q], scores[best[-1]])
        out.append((np.full(len(best), q), best, scores[best]))
    found = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return found[0], found[1], found[2], len(edges)


def _block_hits(lists: DataFrame, asked: object, bars: object, k: int, query_type: str, buckets: int) -> DataFrame:
    """The best ``k`` of every one of ``buckets`` for each query, as far as they can reach its bar; a task has about two of them."""
    id_type = lists.schema["ids"].dataType.elementType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bar = _Asked(asked.value), bars.value.copy()
        number = {t: i for i, t in enumerate(own.terms.to_pylist())}
        for _, rows in _by_bucket(batches):
            rows = rows.combine_chunks()
            known = rows.filter(rows.column("term").is_valid())
            ids = rows.filter(rows.column("term").is_null()).column("ids")
            if not len(ids) or not len(known):
                continue
            ids = ids[0].values
            term = np.array([number[t] for t in known.column("term").to_pylist()], np.int64)
            slots, weights = (known.column(c).combine_chunks() for c in ("slots", "weights"))
            lists_ = [(s.values.to_numpy(), w.values.to_numpy()) for s, w in zip(slots, weights, strict=True)]
            query, slot, value, _ = score_bucket(own, term, known.column("top").to_numpy(), lists_, len(ids), k, bar)
            yield pa.RecordBatch.from_arrays([own.queries.take(pa.array(query)), ids.take(pa.array(slot)), pa.array(value, pa.float64())], ["query_id", "chunk_id", "score"])

    laid = lists.repartition(max(1, -(-buckets // 2)), "bucket").sortWithinPartitions("bucket")
    return laid.mapInArrow(score, f"query_id {query_type}, chunk_id {id_type}, score double")


def block_search(blocks: Bm25Blocks, queries: DataFrame, k: int = 10, text: str = "text", query_id: str = "query_id") -> DataFrame | None:
    """Exact top ``k`` (query_id, chunk_id, score, rank) by the block layout, or None if the batch asks too many terms to travel.

    Only the lists of asked terms move, to their bucket; scores are added up there and only k hits a query and bucket
    leave. A query passes over a bucket whose bound stays below its k-th best score so far. With many buckets, those of the highest
    bound of each query are scored first, on their own, and set the bar for all tasks.
    """
    spark = queries.sparkSession
    asked = query_terms(queries, text, query_id).join(blocks.terms.select("term", "idf"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    head = asked.limit(MAX_ASKED_ROWS + 1).toArrow()
    if head.num_rows > MAX_ASKED_ROWS:
        return None
    sent = spark.sparkContext.broadcast(head)
    query_type = dict(asked.dtypes)["query_id"]
    known = _Asked(head) if head.num_rows else None
    queries_ = known.queries.to_pylist() if known else []
    bar = np.zeros(len(queries_))
    terms = spark.createDataFrame([(t,) for t in known.terms.to_pylist()] if known else [], "term string")
    lists = blocks.lists.join(F.broadcast(terms), "term", "left_semi").unionByName(blocks.lists.filter("term IS NULL"))
    if blocks.buckets > SEED_BUCKETS and known:
        weights = spark.createDataFrame(head.to_pandas(), asked.schema)
        bounds = blocks.lists.select("bucket", "term", "top").join(F.broadcast(weights), "term").groupBy("query_id", "bucket").agg(F.sum(F.greatest(F.col("weight") * F.col("top"), F.lit(0.0))).alias("bound"))
        best = bounds.groupBy("query_id").agg(F.max_by("bucket", F.struct("bound", "bucket")).alias("bucket")).select("bucket").distinct()
        first = _block_hits(lists.join(F.broadcast(best), "bucket", "left_semi"), sent, spark.sparkContext.broadcast(bar.copy()), k, query_type, blocks.buckets)
        kth = assign_rank(first, k).filter(F.col("rank") == k).select("query_id", "score").collect()
        number = {q: i for i, q in enumerate(queries_)}
        for row in kth:
            bar[number[row.query_id]] = row.score
    return assign_rank(_block_hits(lists, sent, spark.sparkContext.broadcast(bar), k, query_type, blocks.buckets), k)


def bm25_search(index: Bm25Index | Bm25Blocks, queries: DataFrame, k: int = 10, text: str = "text", query_id: str = "query_id", allowed: DataFrame | None = None) -> DataFrame:
    """Top ``k`` chunks per query: query_id, chunk_id, score, rank, similarity = min(1, score / 10).

    Of an index only the postings of asked terms move, once; pass ``Bm25Blocks`` to search a layout that is stored. ``allowed`` (chunk_id) narrows the
    postings of an index before anything is scored.
    """
    if isinstance(index, Bm25Blocks):
        if allowed is not None:
            raise ValueError("a narrowed search needs the index itself")
        ranked = block_search(index, queries, k, text, query_id)
        if ranked is None:
            raise ValueError("the batch asks too many terms for a stored layout: pass the index")
    else:
        if allowed is not None:
            index = Bm25Index(index.postings.join(allowed.select("chunk_id"), "chunk_id", "left_semi"), index.terms)
        hits = _bucket_scores(index, query_terms(queries, text, query_id).join(index.terms, "term"), k)
        ranked = assign_rank(bm25_scores(index, queries, text, query_id) if hits is None else hits, k)
    return ranked.withColumn("similarity", F.round(F.least(F.lit(1.0), F.col("score") / 10), 7))


def assign_rank(hits: DataFrame, k: int | None = None, score: str = "score", id_col: str = "chunk_id", query_id: str = "query_id") -> DataFrame:
    """Rank 1..n per query by falling score, ties by id.

    With ``k`` only the first k stay (a group limit below the shuffle). Without
    it every hit is ranked, and a query that hits a third of all chunks is
    cut into ranges of scores instead of numbered in one task.
    """
    if k is None:
        return _all_ranked(hits, score, id_col, query_id)
    w = Window.partitionBy(query_id).orderBy(F.col(score).desc(), F.col(id_col))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _all_ranked(hits: DataFrame, score: str, id_col: str, query_id: str) -> DataFrame:
    """``hits`` with the rank of each of them.

    A count by steps of the score cuts a query into parts of about RANKED_ROWS. Hits are packed by part and written, so that the
    number of hits ahead of a part is exact; only packed hits are shuffled, and each part is sorted by itself. ``hits`` is computed twice.
    """
    value = F.col(score).cast("double")
    step = F.when(value.isNull(), F.lit(2**62)).when(F.isnan(value), F.lit(-(2**62))).otherwise(F.floor(F.signum(value) * F.log1p(F.abs(value)) * SCORE_STEPS).cast("long"))
    columns = [*hits.columns, "_step"]
    stepped = hits.withColumn("_step", step)
    sizes = cut_lineage(stepped.groupBy(F.col(query_id).alias("_q"), "_step").agg(F.count("*").alias("_n")))
    above = Window.partitionBy("_q").orderBy(F.col("_step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = cut_lineage(sizes.select("_q", F.col("_step").alias("_s"), F.floor(F.coalesce(F.sum("_n").over(above), F.lit(0)) / RANKED_ROWS).alias("_part")))
    dealt = stepped.join(parts, F.col(query_id).eqNullSafe(F.col("_q")) & (F.col("_step") == F.col("_s"))).select(*columns, "_part")
    asked = hits.select(F.col(query_id).alias("_q")).schema[0]
    schema = to_arrow_schema(stepped.schema)

    def packed_rows(held: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(held).combine_chunks()
        query = table.column(query_id).combine_chunks().dictionary_encode(null_encoding="encode")
        code, part = query.indices.to_numpy(), table.column("_part").to_numpy()
        order = np.lexsort((part, code))
        edges = np.flatnonzero((np.diff(code[order], prepend=-1) != 0) | (np.diff(part[order], prepend=-1) != 0))
        data = []
        rows = table.select(columns)
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            own = rows.take(pa.array(order[a:b]))
            own = own.sort_by([("_step", "descending"), (score, "descending")]).combine_chunks()
            data.append(pack_columns(own.to_batches()[0]))
        first = order[edges]
        return pa.RecordBatch.from_arrays(
            [query.dictionary.take(pa.array(code[first])), pa.array(part[first]), pa.array(np.diff([*edges, len(order)])), pa.array(data, pa.binary())], ["_q", "_part", "_n", "_rows"]
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                size += batch.num_rows
            if size >= PACKED_HITS:
                yield packed_rows(held)
                held, size = [], 0
        if size:
            yield packed_rows(held)

    packed = cut_lineage(dealt.mapInArrow(pack, StructType([asked, StructField("_part", LongType()), StructField("_n", LongType()), StructField("_rows", BinaryType())])))
    counts = packed.groupBy("_q", "_part").agg(F.sum("_n").alias("_n"))
    ahead = Window.partitionBy("_q").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut_lineage(counts.select(F.col("_q").alias("_of"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")))
    placed = packed.select("_q", "_part", "_rows").join(ahead, F.col("_q").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_p"))).select("_q", "_part", "_ahead", "_rows")

    def ranked(held: list[bytes], ahead: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([unpack_columns(rows, schema) for rows in held])
        table = table.take(pc.sort_indices(table, [("_step", "descending"), (score, "descending"), (id_col, "ascending")])).drop_columns("_step")
        table = table.append_column("rank", pa.array(np.arange(ahead + 1, ahead + 1 + len(table), dtype=np.int32)))
        yield from table.to_batches(max_chunksize=100_000)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at = None
        for batch in batches:
            for query, part, before, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is not None and at[:2] != (query, part):
                    yield from ranked(held, at[2])
                    held = []
                at = (query, part, before)
                held.append(rows)
        if held:
            yield from ranked(held, at[2])

    out = StructType([*hits.schema.fields, StructField("rank", IntegerType())])
    return placed.repartition("_q", "_part").sortWithinPartitions("_q", "_part").mapInArrow(number, out)


def best_per_chunk(hits: DataFrame, id_col: str = "chunk_id", score: str = "score", query_id: str = "query_id") -> DataFrame:
    """Highest score of each chunk over all variants of a query."""
    return hits.groupBy(query_id, id_col).agg(F.max(score).alias(score))
