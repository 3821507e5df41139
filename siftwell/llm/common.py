"""Helpers of the corpus operators: texts in Arrow batches and connected components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from siftwell.runtime import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows handed to Python code at a time hold about so many bytes of text (a longer text comes alone).
SLICE_BYTES = 8 << 20
#: Rows of an Arrow batch of texts; Spark's own default would hold ten thousand texts of any length at once, on both sides.
BATCH_ROWS = 512
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words between ASCII blanks, about ``size`` bytes at a time, so that a very long text never becomes one list."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            found = _BLANK.search(data, end)
            end = found.start() if found else len(data)
        yield data[start:end].split()
        start = end


def small_batches(df: DataFrame) -> None:
    """Have the session hand texts to Python in batches of BATCH_ROWS rows, or fewer if it does already."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        conf.set(_BATCH_CONF, str(BATCH_ROWS))


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist() if batch.nbytes > SLICE_BYTES else []
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def map_texts(df: DataFrame, column: str, keep: Sequence[str], added: str, fn: Callable[[list[bytes | None]], Sequence[list]]) -> DataFrame:
    """Columns ``keep`` of ``df`` and the ``added`` ones (a DDL string), which ``fn`` makes from UTF-8 texts.

    ``fn`` gets a list of texts and returns one list per added column. A kept
    column named like an added one is replaced. Texts are read once per task and
    go nowhere else unless ``column`` is kept.
    """
    small_batches(df)
    new = _parse_datatype_string(added)
    kept = [c for c in keep if c not in new.names]
    source = df.select(*{c: None for c in [*kept, column]})
    schema = StructType([source.schema[c] for c in kept] + list(new))
    types = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, column):
                texts = batch.column(column).cast(pa.large_binary()).to_pylist()
                made = [pa.array(values, field.type) for values, field in zip(fn(texts), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, [*kept, *new.names])

    return source.mapInArrow(run, schema)


def set_aside(docs: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but ``names`` renamed, and what to select to have them back, so that an operator's columns can't clash."""
    aside = {c: f"_kept_{i}" for i, c in enumerate(docs.columns) if c not in names}
    return docs.withColumnsRenamed(aside), [F.col(aside.get(c, c)).alias(c) for c in docs.columns]


def bounded_sample(df: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows of ``df`` (all if it has no more), copies as often as any others. ``df``: a scan or a written table, so that the draw repeats."""
    total = df.count()
    return df if total <= rows else df.sample(fraction=rows / total, seed=seed)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``: root is the smallest node that it reaches.

    Alternating stars: neighbours are re-attached to the smallest one around, from
    above and from below, until nothing changes. The number of edges never grows
    with the square of a group, each round is written once, and rounds grow with the
    logarithm of a component's length. Loops and nulls are ignored; no edges give no rows.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
    current = cut_lineage(pairs.where("v > u").distinct())
    state = _signature(current)
    while state[0]:
        both = current.select(F.col("v").alias("n"), F.col("u").alias("m")).unionAll(current.select(F.col("u").alias("n"), F.col("v").alias("m")))
        lowest = both.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("low"))
        above = both.where("m > n").join(lowest, "n").select(F.col("m").alias("v"), F.col("low").alias("u")).distinct()
        least = above.groupBy("v").agg(F.min("u").alias("low"))
        below = above.join(least, "v").where("u > low").select(F.col("u").alias("v"), F.col("low").alias("u"))
        current = cut_lineage(below.unionAll(least.select("v", F.col("low").alias("u"))).distinct())
        now = _signature(current)
        if now == state:
            break
        state = now
    return current.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(
        current.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )
