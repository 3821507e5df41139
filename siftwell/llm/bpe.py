"""Byte-level BPE through a table of distinct words: split, encode each word once, join ids back by position, decode by pieces."""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from siftwell.llm.common import _slices, small_batches
from siftwell.runtime import cut_lineage, drop_written

#: The word pattern of byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A block's words end with about so many distinct ones or bytes of text.
BLOCK_WORDS, BLOCK_BYTES = 400_000, 64 << 20
#: Words whose ids are packed by block at a time.
HELD_WORDS = 1 << 17
#: Texts over this many characters are split in parts, each cut between a letter and what can't continue its word.
PART_CHARS = 1 << 20
_SAFE_CUT = re.compile(r"[A-Za-z一-龥](?=[ \n\t,.;:!?()、。，])")
#: Bits of a word's number within its block, and of a block's within its task.
_PLACE_BITS, _BLOCK_BITS = 30, 12
#: Buckets of words for each shuffle partition: a block's words of one bucket travel in one compressed row.
_BUCKETS = 4


class Splitter:
    """Words of texts, with the ``added`` tokens of a vocabulary as words of their own."""

    def __init__(self, added: Sequence[str]) -> None:
        longest = sorted(map(re.escape, added), key=len, reverse=True)
        self.special = re.compile("|".join(longest)) if longest else None
        self.split_library = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.split_fast = regex.compile(PATTERN).findall
        self.asked: dict[str, bool] = {}

    def _alike(self, char: str) -> bool:
        """Whether the fast splitter takes a character as the library does (their tables of Unicode differ); each is asked for once."""
        if char not in self.asked:
            probe = f"a{char}a1{char}1{char}{char}a {char}"
            self.asked[char] = [probe[i:j] for _, (i, j) in self.split_library(probe)] == self.split_fast(probe)
        return self.asked[char]

    def _ordinary(self, text: str) -> Iterator[list[str]]:
        start = 0
        while start < len(text):
            found = _SAFE_CUT.search(text, start + PART_CHARS) if len(text) - start > PART_CHARS else None
            end = found.end() if found else len(text)
            part = text[start:end]
            if part.isascii() or all(map(self._alike, set(part))):
                yield self.split_fast(part)
            else:
                yield [part[i:j] for _, (i, j) in self.split_library(part)]
            start = end

    def split(self, text: str) -> Iterator[list[str]]:
        """The words of a text, part by part."""
        start = 0
        for found in self.special.finditer(text) if self.special else ():
            yield from self._ordinary(text[start : found.start()])
            yield [found.group()]
            start = found.end()
        yield from self._ordinary(text[start:])


class Vocabulary:
    """Merges and pieces of a tokenizer file, taken from the tokenizers library."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        before = said.get("pre_tokenizer") or {}
        if said.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or said["model"]["type"] != "BPE":
            raise ValueError(f"{path} is no plain byte-level BPE")
        special = said.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError(f"{path} has added tokens that take in what is around them")
        self.added = {t["content"]: t["id"] for t in special}
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = (b for b in range(0x100) if b not in kept)
        self.letters = {b: chr(b) for b in kept} | {b: chr(0x100 + n) for n, b in enumerate(rest)}

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word."""
        if word in self.added:
            return [self.added[word]]
        mapped = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(mapped)]

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """(starts, bytes): the bytes of id i are bytes[starts[i] : starts[i + 1]]; an id that no piece has is empty."""
        to_byte = {c: b for b, c in self.letters.items()}
        by_id = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        found = []
        for i in range(max(by_id, default=-1) + 1):
            piece = by_id.get(i, "")
            found.append(bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode())
        return np.cumsum([0, *map(len, found)]), np.frombuffer(b"".join(found), np.uint8)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per process."""
    return Vocabulary(path)


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _packed(numbers: np.ndarray) -> bytes:
    """Non-negative numbers below 2 ** 35, 7 bits a byte, low ones first."""
    width = max(1, -(-int(numbers.max()).bit_length() // 7)) if len(numbers) else 1
    size = np.ones(len(numbers), np.int8)
    for i in range(1, width):
        size += numbers >= 1 << 7 * i
    out = np.empty((len(numbers), width), np.uint8)
    for i in range(width):
        out[:, i] = (numbers >> 7 * i & 127) | ((size > i + 1).view(np.uint8) << 7)
    return out[np.arange(width, dtype=np.int8) < size[:, None]].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return np.add.reduceat((raw & 127) << 7 * (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)), starts) if len(ends) else ends


def _gathered(numbers: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The ragged rows ``numbers`` of a table, one after another."""
    sizes = starts[numbers + 1] - starts[numbers]
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[numbers] - ends + sizes, sizes)]


def word_blocks(docs: DataFrame, path: str, text: str, keep: Sequence[str], block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, bucket, packed): the texts as numbers into their block's words.

    A block is a stretch of a task's texts. A row without ``bucket`` holds columns ``keep`` of some rows with their word
    numbers; the other rows hold the block's distinct words with their numbers, by hash bucket. All are compressed.
    """
    small_batches(docs)
    source = docs.select(*{c: None for c in [*keep, text]})
    added = list(vocabulary(path).added)
    buckets = _BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Splitter(added)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        block, taken, index = TaskContext.get().partitionId() << _BLOCK_BITS, 0, _Numbers()

        def words_of(data: bytes | None) -> bytes:
            return b"".join(_packed(np.fromiter(map(index.__getitem__, words), np.int64, len(words))) for words in known.split((data or b"").decode("utf-8", "replace")))

        def row(bucket: int | None, packed: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())], ["block", "bucket", "packed"])

        def closed() -> Iterator[pa.RecordBatch]:
            by_bucket: dict[int, list[str]] = {}
            for word in index:
                by_bucket.setdefault(xxhash.xxh32_intdigest(word) % buckets, []).append(word)
            for bucket, words in by_bucket.items():
                words.sort()
                numbers = _packed(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
                yield row(bucket, squeeze(_ipc(pa.RecordBatch.from_arrays([pa.array(words), pa.array([numbers] + [None] * (len(words) - 1), pa.binary())], ["word", "numbers"]))))

        for whole in batches:
            for batch in _slices(whole, text):
                texts = batch.column(text).cast(pa.large_binary()).to_pylist()
                numbers = pa.array(list(map(words_of, texts)), pa.large_binary())
                yield row(None, squeeze(_ipc(pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), numbers], [*(f"k{i}" for i in range(len(keep))), "numbers"]))))
                taken += sum(len(t) for t in texts if t)
                if len(index) > block_words or taken > BLOCK_BYTES:
                    yield from closed()
                    block, taken, index = block + 1, 0, _Numbers()
                    if block >> _BLOCK_BITS != TaskContext.get().partitionId():
                        raise ValueError("a task reads too much text: use more partitions")
        yield from closed()

    return source.mapInArrow(run, "block long, bucket int, packed binary")


def _ipc(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def block_words(blocks: DataFrame) -> DataFrame:
    """(word, place) of the words in ``word_blocks``, dealt by bucket and sorted by word: ``place`` is the block and, below ``_PLACE_BITS``, the word's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                words = pa.ipc.open_stream(loose(packed)).read_next_batch()
                numbers = _unpacked(words.column("numbers")[0].as_py())
                yield pa.RecordBatch.from_arrays([words.column("word"), pa.array((block << _PLACE_BITS) + numbers)], ["word", "place"])

    rows = blocks.where("bucket is not null").select("bucket", "block", "packed").repartition("bucket")
    return rows.mapInArrow(run, "word string, place long").sortWithinPartitions("word")


def word_ids(words: DataFrame, path: str) -> DataFrame:
    """(block, packed): numbers and ids of words that come dealt and sorted by word, so that each distinct word is encoded once, when it is first met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, ids = vocabulary(path), None, b""
        squeeze = zstandard.ZstdCompressor(level=3).compress
        held: list[pa.RecordBatch] = []
        count = 0

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            place = rows.column("place").to_numpy()
            order = np.argsort(place, kind="stable")
            place = place[order]
            block = place >> _PLACE_BITS
            found = rows.column("ids").combine_chunks().take(pa.array(order))
            edges = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(block)]
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                own = found.slice(a, b - a)
                sizes = pc.binary_length(own).to_numpy() // 4
                numbers = np.diff(place[a:b] & ((1 << _PLACE_BITS) - 1), prepend=0)
                values = np.frombuffer(b"".join(own.to_pylist()), np.int32).astype(np.int64)
                parts = [_packed(numbers), _packed(sizes.astype(np.int64)), _packed(values)]
                out.append(squeeze(b"".join([*(len(p).to_bytes(4, "little") for p in parts), *parts])))
            return pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]]), pa.array(out, pa.binary())], ["block", "packed"])

        for batch in batches:
            out = []
            for word in batch.column("word").to_pylist():
                if word != last:
                    last, ids = word, array("i", known.word_ids(word)).tobytes()
                out.append(ids)
            held.append(pa.RecordBatch.from_arrays([batch.column("place"), pa.array(out, pa.binary())], ["place", "ids"]))
            count += len(batch)
            if count >= HELD_WORDS:
                yield packed()
                held, count = [], 0
        if held:
            yield packed()

    return words.mapInArrow(run, "block long, packed binary")


def _parts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, sizes, values) that ``word_ids`` packed."""
    ends = np.cumsum([12, *(int.from_bytes(data[i : i + 4], "little") for i in (0, 4, 8))])
    numbers, sizes, values = (_unpacked(data[a:b]) for a, b in zip(ends, ends[1:], strict=False))
    return np.cumsum(numbers), sizes, values


def block_tables(found: DataFrame) -> DataFrame:
    """(block, ids): per block the number of ids of each of its words, in order, and the ids, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        held, parts = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            if held is not None:
                numbers, sizes, values = (np.concatenate(x) for x in zip(*parts, strict=True))
                starts = np.cumsum(sizes) - sizes
                order = np.argsort(numbers, kind="stable")
                ends = np.cumsum(sizes[order])
                at = np.arange(len(values)) + np.repeat(starts[order] - ends + sizes[order], sizes[order])
                lengths = _packed(sizes[order])
                made = squeeze(b"".join([len(lengths).to_bytes(4, "little"), lengths, _packed(values[at])]))
                yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([made], pa.binary())], ["block", "ids"])

        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if block != held:
                    yield from closed()
                    held, parts = block, []
                parts.append(_parts(loose(packed)))
        yield from closed()

    return found.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, ids binary")


def _table(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ids) of a block's words from what ``block_tables`` packed."""
    end = 4 + int.from_bytes(data[:4], "little")
    return np.concatenate([[0], np.cumsum(_unpacked(data[4:end]))]), _unpacked(data[end:])


def encode(docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",), out: str = "ids", block_words_: int = BLOCK_WORDS) -> DataFrame:
    """Columns ``keep`` of every row of ``docs`` and ``out``, the ids (array<int>) of its whole text, as the library gives them.

    Texts are split once into numbers of words, block by block, and written. Each distinct word of all blocks is then encoded once; its ids go
    back to the blocks that hold it, and each text's numbers become ids in its order. No word occurrence is shuffled, only distinct words of
    a block and the compressed numbers. A null or empty text has no ids, broken UTF-8 is read with replacement characters, a kept
    column named like ``out`` is replaced, repeated rows are repeated, an empty table gives no rows.
    ``path``: a byte-level vocabulary file that every machine has; ``block_words_``: distinct words after which a block ends.
    """
    kept = [c for c in dict.fromkeys(keep) if c != out]
    blocks = cut_lineage(word_blocks(docs, path, text, kept, block_words_).withColumn("words", F.col("bucket").isNotNull()), ["words"])
    words = blocks.where("words")
    ids = cut_lineage(word_ids(block_words(words), path))
    drop_written(blocks, part="words=true")
    tables = cut_lineage(block_tables(ids))
    drop_written(ids)
    payloads = blocks.where("not words").select("block", "packed")
    schema = StructType([*(docs.schema[c] for c in kept), StructField(out, ArrayType(IntegerType(), False), False)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor().decompress
        held, starts, values = None, np.zeros(1, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for block, packed, ids in zip(*(batch.column(c) for c in ("block", "packed", "ids")), strict=True):
                if block.as_py() != held:
                    held = block.as_py()
                    starts, values = _table(loose(ids.as_py())) if ids.is_valid else (np.zeros(1, np.int64), np.zeros(0, np.int64))
                rows = pa.ipc.open_stream(loose(packed.as_py())).read_next_batch()
                found = [_gathered(_unpacked(n), starts, values) for n in rows.column("numbers").to_pylist()]
                cuts = np.cumsum([0, *map(len, found)])
                flat = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], lists], names)

    return payloads.join(tables, "block", "left").mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``, the text that its ``ids`` (array<int>) stand for.

    Ids are joined with the pieces by id: the pieces, one row per id of the vocabulary file and so bounded by it, are broadcast, and
    the join is a gather in Arrow batches, so that ids need not leave their row. Special tokens are kept, an id that has no piece gives nothing, broken UTF-8
    gives replacement characters, null ids give the empty text. A column named like ``out`` is replaced.
    """
    small_batches(rows)
    source = rows.drop(out)
    schema = StructType([*source.schema.fields, *StructType().add(out, "string").fields])
    pieces = rows.sparkSession.sparkContext.broadcast(vocabulary(path).pieces())
    names = schema.names
    position = source.columns.index(ids)
    type_ = to_arrow_schema(schema).field(out).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, data = pieces.value
        for batch in batches:
            texts = []
            for one in batch.column(position):
                own = one.values.to_numpy(zero_copy_only=False).astype(np.int64) if one.is_valid else np.zeros(0, np.int64)
                own = own[(own >= 0) & (own < len(starts) - 1)]
                parts = (_gathered(own[i : i + (1 << 18)], starts, data).tobytes() for i in range(0, len(own), 1 << 18))
                texts.append(b"".join(parts).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type_)], names)

    return source.mapInArrow(run, schema)
