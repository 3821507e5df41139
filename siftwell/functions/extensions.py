"""Plug-in surface: user embedders, parsers and row metrics by name."""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as tx
from siftwell.operators import vector


@dataclass(frozen=True)
class EmbedderEntry:
    documents: vector.Embedder
    queries: vector.Embedder
    dimension: int


EMBEDDERS: dict[str, EmbedderEntry] = {}
PARSERS: dict[str, Callable[[str, str], list[dict]]] = {}
METRICS: dict[str, tuple[Callable, str]] = {}


def register_embedder(name: str, embed_documents: vector.Embedder, dimension: int, embed_query: vector.Embedder | None = None) -> None:
    EMBEDDERS[name] = EmbedderEntry(embed_documents, embed_query or embed_documents, dimension)


def embed_with(name: str, df: DataFrame, side: str = "documents", text: str = "content") -> DataFrame:
    e = EMBEDDERS[name]
    return vector.embed_chunks(df, e.documents if side == "documents" else e.queries, e.dimension, text)


def register_parser(suffix: str, parser: Callable[[str, str], list[dict]]) -> None:
    """``parser(text, path)`` gives dicts with content, start_line, end_line, chunk_type, name."""
    PARSERS[suffix.lower()] = parser


PARSED = "chunk_id string, file_path string, chunk_type string, name string, start_line int, end_line int, content string"
PARSER_ROWS = "chunk_type string, name string, start_line int, end_line int, content string"


def parser_function(spark: SparkSession, name: str = "parse_file"):
    """The registered parsers as one table function (text, path), also callable in SQL: ``FROM files, LATERAL parse_file(text, file_path)``.

    It carries the parsers registered by now; a path whose suffix has none, or a null text, gives no rows.
    """
    parsers = dict(PARSERS)

    class ParseFile:
        def eval(self, text: str, path: str):
            parser = parsers.get("." + path.rsplit(".", 1)[-1].lower()) if path else None
            for c in parser(text, path) if parser and text is not None else ():
                yield c["chunk_type"], c.get("name") or "", int(c["start_line"]), int(c["end_line"]), c["content"]

    made = F.udtf(ParseFile, returnType=PARSER_ROWS)
    spark.udtf.register(name, made)
    return made


def parse_files(files: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """Chunks of every file whose suffix has a parser: the files joined laterally with ``parser_function``.

    Files without one are left out here; cut those with ``chunk_text``.
    """
    parse = parser_function(files.sparkSession)
    src = files.select(F.col(path).alias("file_path"), F.col(text).alias("text")).filter(tx.suffix(F.col("file_path")).isin(list(PARSERS)))
    rows = src.lateralJoin(parse(F.col("text").outer(), F.col("file_path").outer()))
    cols = [F.col(c) for c in ("file_path", "chunk_type", "name", "start_line", "end_line", "content")]
    return rows.withColumn("chunk_id", tx.chunk_id(*cols)).select("chunk_id", "file_path", "chunk_type", "name", "start_line", "end_line", "content")


@dataclass(frozen=True)
class AggregateEntry:
    """A metric with state: ``add`` takes rows of one group in, ``merge`` joins two states, ``finish`` makes the value of ``result_type``."""

    start: Callable[[], object]
    add: Callable[[object, pd.DataFrame], object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], object]
    result_type: str


AGGREGATES: dict[str, AggregateEntry] = {}
# Groups whose states a task holds before it passes them on.
HELD_GROUPS = 10_000


def register_aggregate(name: str, start: Callable, add: Callable, merge: Callable, finish: Callable, result_type: str) -> None:
    AGGREGATES[name] = AggregateEntry(start, add, merge, finish, result_type)


def grouped_metrics(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row for each group of ``keys`` with the registered aggregate metrics ``names``.

    Tasks take the rows they read into states first, so a group of any size is shuffled as one state a task at most; the states of a group are
    merged and finished together.
    """
    entries = {n: AGGREGATES[n] for n in names}
    typed = [f"{c} {t}" for c, t in df.select(*keys).dtypes]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, dict] = {}

        def passed() -> pd.DataFrame:
            rows = [(*k, *(pickle.dumps(s[n]) for n in names)) for k, s in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*keys, *names])

        for pdf in batches:
            for key, rows in pdf.groupby(keys, dropna=False, sort=False):
                states = held.setdefault(key, {n: e.start() for n, e in entries.items()})
                for n, e in entries.items():
                    states[n] = e.add(states[n], rows)
            if len(held) > HELD_GROUPS:
                yield passed()
        if held:
            yield passed()

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        values = [e.finish(functools.reduce(e.merge, map(pickle.loads, pdf[n]))) for n, e in entries.items()]
        return pd.DataFrame([(*pdf.iloc[0][keys], *values)], columns=[*keys, *names])

    states = df.mapInPandas(partial, ", ".join([*typed, *(f"{n} binary" for n in names)]))
    return states.groupBy(*keys).applyInPandas(final, ", ".join([*typed, *(f"{n} {e.result_type}" for n, e in entries.items())]))


def register_metric(name: str, fn: Callable[[pd.Series], pd.Series], result_type: str) -> None:
    METRICS[name] = (fn, result_type)


def metric(name: str, column: str):
    """Column of a registered row metric."""
    fn, result_type = METRICS[name]

    @F.pandas_udf(result_type)
    def run(s: pd.Series) -> pd.Series:
        return fn(s)

    return run(F.col(column)).alias(name)
