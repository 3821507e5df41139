"""Benchmark decontamination: hashed windows of test items looked up in whole training texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import map_texts, set_aside, word_blocks
from siftwell.runtime import cut_lineage

#: Consecutive words that make a window; an item of fewer words is one window.
WINDOW = 10
#: Benchmark text whose windows are broadcast at a time; a larger benchmark is taken in so many slices.
SLICE_BYTES = 16 << 20

#: Bytes as they are compared: A-Z as a-z, digits, letters and all non-ASCII bytes as they are, the rest as blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_MIX = 0x9E3779B97F4A7C15
FOUND = "n_words long, n_hit long, items array<string>, spans array<array<long>>"


@dataclass
class Windows:
    """Windows of equal length: sorted hashes, and where each stands in the items' words."""

    length: int
    hashes: np.ndarray
    starts: np.ndarray
    items: np.ndarray


@dataclass
class Index:
    """Word numbers, the items' words as one row of numbers, and the windows by length."""

    numbers: dict[bytes, int]
    stream: np.ndarray
    names: list[str]
    windows: list[Windows]


def words_of(data: bytes | None) -> Iterator[list[bytes]]:
    """Blocks of the words of a UTF-8 text."""
    return word_blocks((data or b"").translate(_FOLD))


def _hashes(numbers: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for i in range(length):
        out = (out + numbers[starts + i].astype(np.uint64)) * np.uint64(_MIX)
        out ^= out >> np.uint64(29)
    return out


def build_index(items: list[tuple[str, bytes | None]], window: int = WINDOW) -> Index:
    """Index of (item, text) rows; items without words have no windows."""
    numbers: dict[bytes, int] = {}
    stream: list[int] = []
    found: dict[int, list[tuple[int, int]]] = {}
    names: dict[str, int] = {}
    for name, text in items:
        own = [numbers.setdefault(w, len(numbers) + 1) for block in words_of(text) for w in block]
        if own:
            item, length = names.setdefault(name, len(names)), min(window, len(own))
            found.setdefault(length, []).extend((len(stream) + i, item) for i in range(len(own) - length + 1))
            stream += own
    row, windows = np.array(stream, np.int32), []
    for length, places in sorted(found.items()):
        starts, owner = np.array(places, np.int64).T
        hashes = _hashes(row, starts, length)
        order = np.argsort(hashes, kind="stable")
        windows.append(Windows(length, hashes[order], starts[order], owner[order].astype(np.int32)))
    return Index(numbers, row, list(names), windows)


def _matches(index: Index, w: Windows, numbers: np.ndarray) -> tuple[list[int], set[int]]:
    """Starts of the windows of ``numbers`` that occur in the index word for word, and the items that have them."""
    known = np.concatenate([[0], np.cumsum(numbers > 0)])
    starts = np.flatnonzero(known[w.length :] - known[: -w.length] == w.length) if len(numbers) >= w.length else []
    if not len(starts):
        return [], set()
    hashes = _hashes(numbers, starts, w.length)
    low, high = np.searchsorted(w.hashes, hashes, "left"), np.searchsorted(w.hashes, hashes, "right")
    hit, items = [], set()
    for i in np.flatnonzero(low < high):
        same = (index.stream[w.starts[low[i] : high[i], None] + np.arange(w.length)] == numbers[starts[i] : starts[i] + w.length]).all(axis=1)
        if same.any():
            hit.append(int(starts[i]))
            items.update(w.items[low[i] : high[i]][same].tolist())
    return hit, items


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Overlapping or touching [start, end) pairs put together, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def find(index: Index, text: bytes | None) -> tuple[int, int, list[str], list[list[int]]]:
    """Words, hit words, items with occurring windows (sorted) and hit [start, end) word places of a text."""
    longest = max((w.length for w in index.windows), default=1)
    total, items, spans, tail = 0, set(), [], np.zeros(0, np.int64)
    for block in words_of(text):
        numbers = np.concatenate([tail, np.fromiter(map(index.numbers.get, block, repeat(0)), np.int64, len(block))])
        offset = total - len(tail)
        for w in index.windows:
            starts, which = _matches(index, w, numbers)
            items |= which
            spans += [[offset + s, offset + s + w.length] for s in starts]
        total += len(block)
        tail = numbers[len(numbers) - min(len(numbers), longest - 1) :]
    spans = merged(spans)
    return total, sum(b - a for a, b in spans), sorted(index.names[i] for i in items), spans


def _slices(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """The benchmark's rows, so many at a time that their texts hold about ``limit`` bytes."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // limit) or 1
    for i in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == i)
        yield [(r["item"], None if r["text"] is None else r["text"].encode()) for r in part.toLocalIterator()]


def _scan(docs: DataFrame, keep: list[str], items: list[tuple[str, bytes | None]], window: int, text: str) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(build_index(items, window))
    return map_texts(docs, text, keep, FOUND, lambda texts: tuple(zip(*(find(index.value, t) for t in texts), strict=True)) or ([], [], [], []))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = SLICE_BYTES, text: str = "text", item: str = "item_id", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, n_hit, items (sorted, as strings) and spans (hit word places).

    A word is hit if it lies in any occurrence of a benchmark window; windows found by
    hash are compared word for word. The benchmark travels in slices of at most ``limit``
    bytes of text (or one item): one slice is one pass over the texts without a shuffle;
    more slices are as many passes, each fetched when its pass begins, whose few findings meet by the text's digest.
    Null texts and texts without words are not hit, null or wordless items hit nothing, a null item id
    is the empty string, rows that share an item id are one item, repeated rows are repeated,
    an empty benchmark hits nothing, and columns named like the added ones are replaced.
    """
    columns = [c for c in (keep if keep is not None else docs.columns)]
    slices = _slices(benchmark, item, text, limit)
    first, second = next(slices), next(slices, None)
    if second is None:
        return _scan(docs, columns, first, window, text)
    key = docs.withColumn("_key", F.sha2(F.coalesce(text, F.lit("")), 256))
    parts = [cut_lineage(_scan(key, ["_key"], part, window, text).where("n_hit > 0").dropDuplicates(["_key"])) for part in chain((first, second), slices)]
    found = reduce(DataFrame.unionAll, parts).groupBy("_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s[1]).alias("end"), (acc["total"] + F.greatest(F.lit(0), s[1] - F.greatest(acc["end"], s[0]))).alias("total")),
        lambda acc: acc["total"],
    )
    counted = _scan(key, [*columns, "_key"], [], window, text).drop("n_hit", "items", "spans")
    out = counted.join(found.withColumn("n_hit", covered), "_key", "left")
    return out.select(
        *[c for c in columns if c in counted.columns and c != "n_words"], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<array<long>>")).alias("spans"),
    )


def without_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """``text`` without its hit words and what stands between them."""
    if not text or not spans:
        return text
    words, out, at = [m.span() for m in _WORD.finditer(text)], [], 0
    for start, end in merged([list(s) for s in spans]):
        out.append(text[at : words[start][0]])
        at = words[end - 1][1]
    return "".join([*out, text[at:]])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, unit: str = "document", **options) -> DataFrame:
    """``docs`` without contaminated documents, or with ``unit="span"`` all documents without their hit spans."""
    if unit not in ("document", "span"):
        raise ValueError("unit is document or span")
    text = options.get("text", "text")
    rows, back = set_aside(docs, [text])
    found = contamination(rows, benchmark, **options)
    if unit == "document":
        return found.where("n_hit = 0").select(*back)
    cut = F.udf(without_spans, "string")
    return found.withColumn(text, F.when(F.col("n_hit") > 0, cut(F.col(text), F.col("spans"))).otherwise(F.col(text))).select(*back)
