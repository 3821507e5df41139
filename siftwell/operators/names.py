"""Many names looked up in many texts in one pass over the texts: by an automaton over the names, or by hashes where they are too many to travel."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from siftwell.runtime import cut_lineage

# Bytes of names that travel to every task as an automaton; of more names only a filter of hashes travels.
SLICE_BYTES = 16 << 20
# Bits of the filter of name starts, least and most of that of whole names (sixteen a name in between), and bytes of text that are looked at together.
START_BITS, LEAST_BITS, MOST_BITS, WINDOW = 22, 16, 28, 1 << 20
# Bytes of a name that its hash covers, and bytes of a start.
HASHED, START = 256, 4
# Rows whose strings are counted together.
SCANNED_ROWS = 1000
# Bytes that a name takes besides its text.
NAME_OVERHEAD = 64

def _automaton(names: tuple[list[str], list[str]]) -> ahocorasick.Automaton:
    """The automaton of a slice of names, each with its size and the needles that are written so."""
    found = ahocorasick.Automaton()
    by_text: dict[str, list[str]] = {}
    for needle, low in zip(*names, strict=True):
        by_text.setdefault(low, []).append(needle)
    for low, needles in by_text.items():
        found.add_word(low, (len(low), needles))
    if by_text:
        found.make_automaton()
    return found


def _counts(automaton: ahocorasick.Automaton, text: str | None) -> dict[tuple, int]:
    """How often each name stands in a text, not counting one that overlaps the one counted before."""
    out: dict[tuple, int] = {}
    free: dict[int, int] = {}
    for end, (size, needles) in automaton.iter(text) if text and len(automaton) else ():
        key = id(needles)
        if end - size + 1 >= free.get(key, 0):
            free[key] = end + 1
            names = tuple(needles)
            out[names] = out.get(names, 0) + 1
    return out


_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            made = np.full(n, base, np.uint64)
            made[0] = 1
            _POWERS[key] = np.cumprod(made)
    return _POWERS["up"], _POWERS["down"]


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def _slots(sums: np.ndarray, at: np.ndarray, size: np.ndarray | int, bits: int) -> np.ndarray:
    """Places in a filter of ``bits`` of the strings that begin ``at`` places of the summed bytes."""
    value = (sums[at + size] - sums[at]) * _POWERS["down"][at]
    value ^= value >> np.uint64(32)
    return ((value * np.uint64(_MIX)) >> np.uint64(64 - bits)).astype(np.int64)


def _starts(data: np.ndarray) -> np.ndarray:
    """The first bytes at each place as a number; beyond the end are zeros."""
    padded = np.concatenate([data, np.zeros(START, np.uint8)]).astype(np.uint32)
    out = padded[: len(data)].copy()
    for i in range(1, START):
        out |= padded[i : len(data) + i] << np.uint32(8 * i)
    return out


def _start_slots(starts: np.ndarray, size: int) -> np.ndarray:
    """Places in the filter of starts: of names of ``size`` bytes as a whole if they are shorter than a start."""
    kept = starts if size >= START else starts & np.uint32((1 << 8 * size) - 1)
    return ((kept * np.uint32(2654435761) + np.uint32(min(size, START) * 0x9E3779B9 & 0xFFFFFFFF)) >> np.uint32(32 - START_BITS)).astype(np.int64)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, edges) of a string column."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def _set_bits(low: pa.Array, bits: int) -> Iterator[tuple[str, np.ndarray]]:
    """The places of names in the two filters."""
    data, edges = _bytes_of(low)
    sizes = np.diff(edges)
    starts = _starts(data)[edges[:-1]]
    for size in range(1, START + 1):
        yield "start", _start_slots(starts[(sizes == size) if size < START else (sizes >= START)], size)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + WINDOW, "right")) - 1)
        kept = np.minimum(sizes[first:last], HASHED)
        sums = _sums(data[edges[first] : edges[first] + WINDOW + HASHED])
        yield "name", _slots(sums, edges[first:last] - edges[first], kept, bits)
        first = last


def _filters(low: DataFrame, total: int) -> tuple[list[int], int, np.ndarray, np.ndarray]:
    """(sizes of the names in bytes, bits, filter of starts, filter of names); a task gives out the words of the filters that it sets."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * total).bit_length()))
    sizes = sorted(r[0] for r in low.select(F.octet_length("low")).distinct().collect())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, places in _set_bits(batch.column(0), bits) if batch.num_rows else ():
                places = np.unique(places)
                if len(places):
                    word, mask = places >> 5, np.int64(1) << (places & 31)
                    first = np.flatnonzero(np.diff(word, prepend=-1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(first)), pa.array(word[first]), pa.array(np.bitwise_or.reduceat(mask, first))], ["kind", "word", "mask"]
                    )

    made = low.mapInArrow(words, "kind string, word long, mask long").groupBy("kind", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = []
    for kind, n in (("start", START_BITS), ("name", bits)):
        own = made.filter(pc.equal(made.column("kind"), kind))
        table = np.zeros((1 << n) >> 5, np.uint32)
        table[own.column("word").to_numpy()] = own.column("mask").to_numpy().astype(np.uint32)
        out.append(table)
    return sizes, bits, out[0], out[1]


def _held(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (table[places >> 5] >> (places & 31).astype(np.uint32)) & np.uint32(1) != 0


def _likely(column: pa.Array, filters: tuple[list[int], int, np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """(row, place in the column's bytes, string) of every place of a text where a string stands that the filters hold; by row and place."""
    sizes, bits, of_start, of_name = filters
    data, edges = _bytes_of(column)
    whole = np.append((data & 0xC0) != 0x80, True)  # a character begins here
    for begin in range(0, len(data), WINDOW):
        part = data[begin : begin + WINDOW + HASHED]
        starts = _starts(part)[: min(WINDOW, len(data) - begin)]
        sums = _sums(part)
        found = []
        long = np.flatnonzero(_held(of_start, _start_slots(starts, START))) if sizes[-1] >= START else None
        for size in sizes:
            at = long if size >= START else np.flatnonzero(_held(of_start, _start_slots(starts, size)))
            row = np.searchsorted(edges, begin + at, "right") - 1
            inside = (begin + at + size <= edges[row + 1]) & whole[begin + at]
            at, row = at[inside], row[inside]
            ends = whole[begin + at + size]
            at, row = at[ends], row[ends]
            if len(at):
                kept = _held(of_name, _slots(sums, at, min(size, HASHED), bits))
                found.append((row[kept], begin + at[kept], np.full(int(kept.sum()), size)))
        if found:
            row, at, size = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((at, row))
            for r, a, n in zip(row[order].tolist(), at[order].tolist(), size[order].tolist(), strict=True):
                yield r, a, data[a : a + n].tobytes()


def _hashed_counts(source: DataFrame, texts: int, first: int, asked: DataFrame, total: int, schema: StructType) -> DataFrame:
    """What ``name_counts`` gives, by one pass over the texts that gives out every string the filters hold, and a join of those with the names."""
    low = asked.select("low").distinct()
    shared = source.sparkSession.sparkContext.broadcast(_filters(low, total))
    likely = StructType([*schema.fields[:first], StructField("low", StringType()), StructField("counts", ArrayType(IntegerType()))])
    types = to_arrow_schema(likely)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SCANNED_ROWS):
                batch = whole.slice(start, SCANNED_ROWS)
                counts: dict[tuple[int, bytes], list[int]] = {}
                for t in range(texts):
                    free: dict[tuple[int, bytes], int] = {}
                    for row, at, string in _likely(batch.column(first + t), shared.value):
                        key = (row, string)
                        if at >= free.get(key, 0):
                            free[key] = at + len(string)
                            counts.setdefault(key, [0] * texts)[t] += 1
                at = pa.array([r for r, _ in counts], pa.int32())
                taken = [batch.column(i).take(at) for i in range(first)]
                strings = pa.array([x for _, x in counts], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*taken, strings, pa.array(list(counts.values()), types.field("counts").type)], likely.names)

    return source.mapInArrow(scan, likely).join(asked, "low").select(*schema.names)


def name_counts(rows: DataFrame, texts: Sequence[str], keep: Sequence[str], needles: DataFrame, needle: str = "needle", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Columns ``keep`` of ``rows``, ``needle`` and ``counts``: one row for each row and name that one of its ``texts`` contains, case-blind.

    ``counts`` holds the number of places per text column. Texts are read once, where they are, and
    never shuffled. Names of up to ``slice_bytes`` go to the tasks; of more, only a filter of hashes of bounded size does, and the strings that it
    holds are joined with the names. Null and empty names are
    in no text, a null text holds no name, names that differ in case only are both given.
    """
    spark = rows.sparkSession
    asked = cut_lineage(needles.select(F.col(needle).alias("needle"), F.lower(needle).alias("low")).filter(F.length("low") > 0).distinct())
    count, total = asked.agg(F.count("*"), F.sum(F.octet_length("low") + F.octet_length("needle") + NAME_OVERHEAD)).first()
    source = rows.select(*keep, *(F.lower(c).alias(f"_t{i}") for i, c in enumerate(texts)))
    schema = StructType([*rows.select(*keep).schema.fields, asked.schema["needle"], StructField("counts", ArrayType(IntegerType()))])
    types = to_arrow_schema(schema)
    first = len(keep)
    if (total or 0) > slice_bytes:
        return _hashed_counts(source, len(texts), first, asked, count, schema)
    names = asked.select("needle", "low").toArrow()
    shared = spark.sparkContext.broadcast((names.column("needle").to_pylist(), names.column("low").to_pylist()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value)
        for batch in batches:
            at, found, counts = [], [], []
            for i, own in enumerate(zip(*(batch.column(first + t).to_pylist() for t in range(len(texts))), strict=True)):
                by_text = [_counts(automaton, t) for t in own]
                for key in dict.fromkeys(k for c in by_text for k in c):
                    places = [c.get(key, 0) for c in by_text]
                    for name in key:
                        at.append(i)
                        found.append(name)
                        counts.append(places)
            taken = [batch.column(i).take(pa.array(at, pa.int32())) for i in range(first)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(found, types.field("needle").type), pa.array(counts, types.field("counts").type)], schema.names)

    return source.mapInArrow(scan, schema)


def substring_pairs(texts: DataFrame, needles: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(text_id, needle) where the ``text`` contains the needle, case-blind."""
    return name_counts(texts, ["text"], ["text_id"], needles, slice_bytes=slice_bytes).select("text_id", "needle")
