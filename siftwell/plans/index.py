"""A stored index kept up to date: changed files become chunks, vectors and postings, and searches read what is stored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import joins, lexical
from siftwell.plans.search import SearchTables
from siftwell.runtime import cut_lineage, drop_written
from siftwell.sources import tables

Cut = Callable[[DataFrame], DataFrame]
Embed = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class StoredIndex:
    """Keyed tables below ``root``: files by path, chunks by path, vectors and postings by chunk, term counts by term.

    ``cut`` turns files into chunks (chunk_id, file_path, content, …), ``document`` gives a chunk's indexed text, ``embed`` turns
    (chunk_id, doc_text) into (chunk_id, vector); without it no vectors are kept.
    """

    spark: SparkSession
    root: str
    cut: Cut
    document: Column
    embed: Embed | None = None
    buckets: int = tables.BUCKETS

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self) -> bool:
        return tables.has_table(self.spark, self._path("files"))

    def read(self, name: str) -> DataFrame:
        return tables.read_keyed(self.spark, self._path(name))

    def _put(self, rows: DataFrame, name: str, key: str, gone: DataFrame | None, first: bool) -> None:
        if first:
            tables.write_keyed(rows, self._path(name), key, self.buckets)
        else:
            tables.upsert_keyed(rows, self._path(name), key, gone)

    def update(self, files: DataFrame) -> DataFrame:
        """Bring the index to ``files`` (file_path, file_hash and what ``cut`` reads); returns (file_path, change) of the files that changed.

        Only changed files are cut, only chunks without a vector embedded, and only postings of chunks that came or went are read and counted. A
        term's counts become the stored ones less those of the postings that go plus those of the ones that come; all that is
        to be stored is put together before the first table is touched. The files table comes last; if the driver dies in between, ``rebuild``.
        """
        first = not self.exists()
        indexed = files.select("file_path", "file_hash").limit(0) if first else self.read("files")
        changes = cut_lineage(joins.changed_files(files, indexed).filter("change <> 'same'"))
        touched = changes.select("file_path")
        due = changes.filter("change IN ('new', 'changed')").select("file_path")
        fresh = cut_lineage(self.cut(files.join(due, "file_path", "left_semi")))
        texts = fresh.select("chunk_id", self.document.alias("doc_text")).dropDuplicates(["chunk_id"])
        come = cut_lineage(lexical.chunk_postings(texts))
        if first:
            self._put(fresh, "chunks", "file_path", None, True)
            self._put(come, "postings", "chunk_id", None, True)
            self._put(_counts(come), "terms", "term", None, True)
            if self.embed:
                self._put(self.embed(texts), "vectors", "chunk_id", None, True)
            self._put(files.select("file_path", "file_hash"), "files", "file_path", None, True)
            return changes
        before = cut_lineage(self.read("chunks").join(touched, "file_path", "left_semi").select("chunk_id"))
        gone = cut_lineage(before.select("chunk_id").join(fresh.select("chunk_id"), "chunk_id", "left_anti").distinct())
        went = self.read("postings").join(before, "chunk_id", "left_semi")
        moved = _counts(come).select("term", "df", "cf").unionByName(_counts(went).select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf")))
        moved = moved.groupBy("term").agg(F.sum("df").alias("_df"), F.sum("cf").alias("_cf")).filter("_df <> 0 OR _cf <> 0")
        terms = cut_lineage(
            moved.join(self.read("terms"), "term", "left").select(
                "term", (F.coalesce("df", F.lit(0)) + F.col("_df")).alias("df"), (F.coalesce("cf", F.lit(0)) + F.col("_cf")).alias("cf")
            )
        )
        vectors = None
        if self.embed:
            missing = joins.unembedded_chunks(texts, self.read("vectors"))
            vectors = cut_lineage(self.embed(texts.join(missing, "chunk_id", "left_semi")))
        self._put(terms.filter("df > 0"), "terms", "term", terms.filter("df <= 0"), False)
        self._put(come, "postings", "chunk_id", gone, False)
        if vectors is not None:
            self._put(vectors, "vectors", "chunk_id", gone, False)
        self._put(fresh, "chunks", "file_path", touched, False)
        self._put(files.select("file_path", "file_hash").join(due, "file_path", "left_semi"), "files", "file_path", touched, False)
        drop_written(fresh, come, before, gone, terms, *([vectors] if vectors is not None else []))
        return changes

    def rebuild(self, files: DataFrame) -> None:
        """Make the tables anew from all ``files``."""
        fresh = cut_lineage(self.cut(files))
        texts = fresh.select("chunk_id", self.document.alias("doc_text")).dropDuplicates(["chunk_id"])
        come = cut_lineage(lexical.chunk_postings(texts))
        for rows, name, key in (
            (fresh, "chunks", "file_path"), (come, "postings", "chunk_id"), (_counts(come), "terms", "term"),
            *([(self.embed(texts), "vectors", "chunk_id")] if self.embed else []), (files.select("file_path", "file_hash"), "files", "file_path"),
        ):
            tables.write_keyed(rows, self._path(name), key, self.buckets)
        drop_written(fresh, come)

    def lexical_index(self) -> lexical.Bm25Index:
        """The stored postings with the term facts of now: idf depends on the number of all chunks, so it is made when read."""
        chunks = self.read("chunks").select("chunk_id").distinct()
        return lexical.Bm25Index(self.read("postings"), lexical.term_facts(self.read("terms"), chunks.count()))

    def search_tables(self, **more: object) -> SearchTables:
        """What ``plans.search.search`` reads, from storage."""
        chunks = self.read("chunks")
        vectors = self.read("vectors") if self.embed else self.read("postings").select("chunk_id", F.lit(None).cast("array<double>").alias("vector")).limit(0)
        return SearchTables(chunks, self.lexical_index(), vectors, **more)


def _counts(postings: DataFrame) -> DataFrame:
    """(term, df, cf): how many chunks hold a term, and how often."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def file_hash(text: Column) -> Column:
    """Hash of a file's text, by which it counts as changed."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)
