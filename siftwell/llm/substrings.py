"""Substring deduplication: hashed lines or paragraphs, cut by their content where they are long, of which the earliest stays."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from siftwell.llm.common import _slices, small_batches
from siftwell.runtime import cut_lineage, drop_written

#: Words that a line or paragraph, or shorter ones in a row, need to be compared; from twice as many on it is cut.
LEAST_WORDS = 20
#: A long unit is cut before a word whose hash is the least among so many words on either side, so that cuts depend on nearby words only.
REACH = 5
#: Words that a piece of a cut unit needs to go by itself; a shorter one goes with a neighbour that goes. Of 51 shared words in longer texts 99.3 of 100 hold such a piece whole, wherever they start.
LEAST_PIECE = 8
#: Documents that share a digest from which it counts as hot: its rows are found by a broadcast list instead of a shuffle.
HOT = 10_000
#: What ends a unit.
BREAKS = {"paragraph": re.compile(rb"\n[ \t\r]*\n\s*"), "line": re.compile(rb"\n")}
#: A-Z as a-z; everything but letters, digits and non-ASCII bytes as a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _cuts(words: list[bytes], groups: list[tuple[int, int]]) -> list[int]:
    """Places before which long units [a, b) of words are cut: words whose hash, with that of the word before, is the least within REACH words of the unit."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    hashes = np.concatenate([own[:1] & np.uint64(0), own[:-1]]) * np.uint64(0x9E3779B97F4A7C15)
    hashes[[a for a, _ in groups]] = 0
    hashes ^= own
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    wide = np.full(sum(b - a for a, b in groups) + REACH * (len(groups) + 1), np.iinfo(np.uint64).max, np.uint64)
    places = np.full(len(wide), -1)
    at = REACH
    for a, b in groups:
        wide[at : at + b - a] = hashes[a:b]
        places[at + REACH + 1 : at + b - a - REACH] = np.arange(a + REACH + 1, b - REACH)
        at += b - a + REACH
    least, have = {1: wide}, 1
    while have <= REACH:
        least[2 * have] = np.minimum(least[have][:-have], least[have][have:])
        have *= 2

    def window(n: int) -> np.ndarray:
        size = 1 << n.bit_length() - 1
        return np.minimum(least[size][: len(wide) - n + 1], least[size][n - size :])

    middle = slice(REACH, len(wide) - REACH)
    cut = (wide[middle] == window(2 * REACH + 1)) & (wide[middle] < window(REACH)[: len(wide) - 2 * REACH])
    found = places[middle][cut]
    return found[found >= 0].tolist()


def compared(data: bytes, unit: str = "line", least_words: int = LEAST_WORDS) -> tuple[list[tuple[bytes | None, int, int]], np.ndarray, np.ndarray, list[int]]:
    """((digest, first word, end word) of each unit of a UTF-8 text in order, [start, end) byte places of its words, word numbers at which lines or paragraphs end).

    Lines of ``least_words`` words or more are units, shorter ones in a row are one together, without digest if they still are too short; a unit of more than
    twice as many words is cut by content. Digests are 128 bits of the normalised words.
    """
    folded = data.translate(_FOLD)
    edges = np.flatnonzero(np.diff(np.frombuffer(b" " + folded + b" ", np.uint8) != 32))
    first, last = edges[::2], edges[1::2]
    words = folded.split()
    if not words:
        return [], first, last, [0] * (1 + len(BREAKS[unit].findall(data)))
    borders = np.searchsorted(first, [m.start() for m in BREAKS[unit].finditer(data)] + [len(data)]).tolist()
    groups, run = [], 0
    start = 0
    for end in borders:
        if end - start >= least_words:
            if run < start:
                groups.append((run, start))
            groups.append((start, end))
            run = end
        start = end
    if run < len(words):
        groups.append((run, len(words)))
    long = [(a, b) for a, b in groups if b - a > 2 * least_words]
    cuts = _cuts(words, long) if long else []
    starts = sorted([*(a for a, _ in groups), *cuts])
    enough = {a for a, b in groups if b - a < least_words}
    out = [(None if a in enough else xxhash.xxh3_128_digest(b" ".join(words[a:b])), a, b) for a, b in zip(starts, [*starts[1:], len(words)], strict=True)]
    return out, first, last, borders


def placed(a: int, b: int, first: np.ndarray, last: np.ndarray, borders: list[int]) -> list[list[int]]:
    """[start, end) byte places of words a to b, one for each line or paragraph that they take part of."""
    inside = borders[bisect_right(borders, a) : bisect_left(borders, b)]
    parts = [a, *dict.fromkeys(inside), b] if inside else [a, b]
    return [[int(first[i]), int(last[j - 1])] for i, j in zip(parts, parts[1:], strict=False)]


def whole_digest(data: bytes) -> bytes | None:
    """Digest of all words of a text, apart from those of its units; None without words."""
    words = data.translate(_FOLD).split()
    return xxhash.xxh3_128_digest(b"\0" + b" ".join(words)) if words else None


def units(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS) -> DataFrame:
    """(rank, key, digest): every distinct unit digest of each document, that of the whole text among them.

    ``rank`` and ``key`` are columns of ``docs``: the order in which documents count, and what tells them apart. Copies
    (one key) within a batch are read once.
    """
    source = docs.select("rank", "key", "text")
    schema = StructType([StructField("rank", source.schema["rank"].dataType), *_parse_datatype_string("key binary, digest binary")])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "text"):
                rows, digests, seen = [], [], set()
                keys = batch.column("key").to_pylist()
                for row, data in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                    if keys[row] in seen or not data:
                        continue
                    seen.add(keys[row])
                    own = {d for d, _, _ in compared(data, unit, least_words)[0]} | {whole_digest(data)}
                    own.discard(None)
                    rows += [row] * len(own)
                    digests += own
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("rank").take(at), batch.column("key").take(at), pa.array(digests, pa.binary())], schema.names)

    return source.mapInArrow(split, schema)


def _order() -> Column:
    return F.struct(F.col("rank").isNull().alias("none"), "rank", "key")


def later_units(found: DataFrame) -> DataFrame:
    """(key, repeated): for each document the digests that an earlier one has.

    Digests are counted with partial sums. Those of more than HOT documents, or of a hundred-thousandth of all rows if that is more, are at
    most 100,000 and go to the tasks; the rest meet their documents in a shuffle in which no digest has more rows than that.
    """
    rows = found.count()
    hot = max(HOT, rows // 100_000)
    shared = cut_lineage(
        found.groupBy("digest").agg(F.min(_order()).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.key").alias("first_key"), "n")
    )
    often = F.broadcast(shared.where(F.col("n") > hot).select("digest", "first_key"))
    seldom = shared.where(F.col("n") <= hot).select("digest", "first_key")
    meet = lambda df, other: df.join(other, "digest").where("key != first_key").select("key", "digest")
    both = meet(found, often).unionAll(meet(found.join(often, "digest", "left_anti"), seldom))
    return both.groupBy("key").agg(F.collect_set("digest").alias("repeated"))


def _characters(data: bytes, spans: list[list[int]]) -> list[list[int]]:
    """Byte places as places in code points."""
    if not spans:
        return []
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return before[np.array(spans)].tolist()


def cleaned(data: bytes, gone: list[list[int]]) -> bytes:
    """The text without the removed places; what separates the rest stays."""
    out, at = [], 0
    for start, end in gone:
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]])


def removed(data: bytes, repeated: set[bytes], unit: str = "line", least_words: int = LEAST_WORDS) -> tuple[list[list[int]], list[list[int]], int, int]:
    """(removed places, kept places, units, units removed) of a text; ``repeated`` are the digests that an earlier document has.

    A unit that the text itself has before goes as well, and of a copy of a whole earlier text everything does. A piece below LEAST_PIECE words
    that is found again goes only next to one that goes.
    """
    seen: set[bytes | None] = set()
    copy = bool(repeated) and whole_digest(data) in repeated
    found, first, last, borders = compared(data, unit, least_words)
    again, out = [], []
    for d, a, b in found:
        again.append(copy or (d is not None and (d in repeated or d in seen)))
        out.append(copy or (again[-1] and b - a >= min(LEAST_PIECE, least_words)))
        seen.add(d)
    for order in (range(1, len(found)), range(len(found) - 2, -1, -1)):
        for i in order:
            out[i] = out[i] or (again[i] and out[i - order.step])
    gone, kept = ([p for o, (_, a, b) in zip(out, found, strict=True) if o == goes for p in placed(a, b, first, last, borders)] for goes in (True, False))
    return gone, kept, len(found), sum(out)


def deduplicate(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_units, n_removed, removed, kept) for every row of ``docs``.

    Units (``line`` or ``paragraph``) of ``least_words`` words or more are normalised and hashed, shorter ones in a row as one unit, longer ones
    in pieces cut where nearby words say so, and so is the whole text; of equal ones the earliest
    stays, by doc_id (null last), then by the text's hash, then by place. A passage of some 50 words that two texts share holds whole
    pieces wherever it starts, which go; words at its ends that belong to a piece with others stay, as does a short line that many texts share. ``text`` is what is left, ``removed`` and
    ``kept`` hold [start, end) of the units in code points of the original, split where a unit spans lines. Rows that
    agree in id and text are one document and get the same result. A null text stays null and
    has no units; a very long text is one row all through; broken UTF-8 is kept as replacement characters; other columns, also those named like the
    result's, are left out; an empty table gives no rows.

    Each text is split twice: once to write its digests, once to cut it.
    """
    small_batches(docs)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    key = F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.octet_length("text").cast("string"), "text").cast("binary")))
    keyed = named.withColumn("key", key)
    found = cut_lineage(units(keyed.select(F.col("doc_id").alias("rank"), "key", "text"), unit, least_words))
    later = cut_lineage(later_units(found))
    drop_written(found)
    joined = keyed.join(later, "key", "left").select("doc_id", "text", "repeated")
    schema = StructType([StructField("doc_id", named.schema["doc_id"].dataType), *_parse_datatype_string("text string, n_units long, n_removed long, removed array<array<long>>, kept array<array<long>>")])
    spans = pa.list_(pa.list_(pa.int64()))
    types = (pa.string(), pa.int64(), pa.int64(), spans, spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "text"):
                out = []
                for raw, repeated in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("repeated").to_pylist(), strict=True):
                    if raw is None:
                        out.append((None, 0, 0, [], []))
                        continue
                    gone, kept, n, n_gone = removed(raw, set(repeated or ()), unit, least_words)
                    out.append((cleaned(raw, gone).decode(errors="replace"), n, n_gone, _characters(raw, gone), _characters(raw, kept)))
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], schema.names)

    return joined.mapInArrow(cut, schema)
