"""Fill-in-the-middle: texts re-ordered around sentinels, assembled and restored by secondary sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from siftwell.llm.common import BATCH_ROWS, SLICE_BYTES, _slices, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Segments in output order, with the sentinel before each.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Place of each segment in the text, and of the row that closes a document's pieces.
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_CLOSE = 3
_PLACE_BITS = 40
#: Code points of a piece.
UNIT = 4096
_FACTS = "n long, form string, prefix_chars long, middle_chars long"
_PIECES = f"key binary, position long, copies int, piece binary, {_FACTS}"


def plan(doc_id: object, text: str, plain_from: int = 90, spm_below: int = 20) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) of a text, drawn from the SHA-256 of ``1:`` and the decimal id (a null id: nothing)."""
    drawn = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= plain_from or any(s in text for s in PLACE):
        return "plain", 0, 0
    cuts = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return "spm" if h4 % 100 < spm_below else "psm", *cuts


def output_pieces(text: str, form: str, first: int, second: int, unit: int = UNIT) -> Iterator[tuple[int, str]]:
    """(position, piece) of a text's output, ``unit`` code points of the text at a time; a segment's sentinel leads its first piece."""
    spans = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, len(text))}
    segments = [(s, *spans[s]) for s in ORDERS[form]] if form in ORDERS else [("", 0, len(text))]
    at = 0
    for sentinel, start, end in segments:
        for i in range(start, max(end, start + 1), unit):
            piece = (sentinel if i == start else "") + text[i : min(i + unit, end)]
            yield at, piece
            at += len(piece)


class Restorer:
    """Takes an output apart: ``feed`` gives (segment's place in the text, bytes) as the sentinels of ``form`` go by, piece borders anywhere."""

    def __init__(self, form: str) -> None:
        self.left = [s.encode() for s in ORDERS.get(form, ())]
        self.place, self.held = 0, b""

    def feed(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        data = self.held + piece
        while self.left and (at := data.find(self.left[0])) >= 0:
            if at:
                yield self.place, data[:at]
            sentinel = self.left.pop(0)
            self.place, data = PLACE[sentinel.decode()], data[at + len(sentinel) :]
        keep = len(data) - (len(self.left[0]) - 1 if self.left else 0)
        self.held = data[max(keep, 0) :]
        if keep > 0:
            yield self.place, data[:keep]

    def close(self) -> Iterator[tuple[int, bytes]]:
        if self.held:
            yield self.place, self.held


def restore(output: str | None, form: str) -> str:
    """The text of an ``output`` in ``form``."""
    parts: list[list[bytes]] = [[], [], []]
    taken = Restorer(form)
    for found in (taken.feed((output or "").encode("utf-8", "surrogateescape")), taken.close()):
        for place, data in found:
            parts[place].append(data)
    return b"".join(b"".join(p) for p in parts).decode("utf-8", "surrogateescape")


def _arrow(schema: StructType, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema), strict=True)], schema.names)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: int = UNIT) -> DataFrame:
    """(doc_id, key, position, copies, piece, n, form, prefix_chars, middle_chars): outputs of whole texts in pieces.

    ``key`` is a digest of id and text, so that a task that runs again names its rows alike;
    rows of a batch that agree in both give one set of pieces with their number as ``copies``, and such sets of
    several batches are equal. A document's id and facts stand on its first piece only. A null text is the empty
    one, an empty text is one empty piece; bytes that are no UTF-8 count as a unit each and are kept.
    """
    small_batches(docs)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(doc_id).cast("string").alias("name"))
    schema = StructType([StructField("doc_id", source.schema["doc_id"].dataType), *_parse_datatype_string(_PIECES)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "text"):
                ids, names = batch.column("doc_id").to_pylist(), batch.column("name").to_pylist()
                texts = batch.column("text").cast(pa.large_binary()).to_pylist()
                same: dict[bytes, list[int]] = {}
                for i, (name, data) in enumerate(zip(names, texts, strict=True)):
                    key = hashlib.sha256(b"-" if name is None else f"{len(name.encode())}:{name}".encode())
                    key.update(data or b"")
                    same.setdefault(key.digest()[:16], []).append(i)
                out, size = [], 0
                for key, copies in same.items():
                    i = copies[0]
                    own = (texts[i] or b"").decode("utf-8", "surrogateescape")
                    form, first, second = plan(names[i], own)
                    facts = (len(own), form, *((None, None) if form == "plain" else (first, second - first)))
                    for at, piece in output_pieces(own, form, first, second, unit):
                        data = piece.encode("utf-8", "surrogateescape")
                        out.append((ids[i] if not at else None, key, at, len(copies), data, *(facts if not at else (None,) * 4)))
                        size += len(data)
                        if size > 4 << 20:
                            yield _arrow(schema, out)
                            out, size = [], 0
                if out:
                    yield _arrow(schema, out)

    return source.mapInArrow(cut, schema)


def assembled(cut: DataFrame) -> DataFrame:
    """``pieces`` dealt by document and in output order within it: the DataFrame form of repartitionAndSortWithinPartitions."""
    return cut.repartition("key").sortWithinPartitions("key", "position")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """(first of its document, row) of an ``assembled`` stream; equal rows' further sets of pieces come without ``piece``."""
    key = at = None
    for batch in batches:
        for row in batch.to_pylist():
            again = row["key"] == key and row["position"] == at
            if again:
                row["piece"] = None
            yield row["key"] != key, row
            key, at = row["key"], row["position"]


class _Digest:
    """Streams one document's output: its digest, and its pieces by place in the text."""

    def __init__(self, row: dict) -> None:
        self.head, self.copies, self.sha, self.seen = row, 0, hashlib.sha256(), 0
        self.taken = Restorer(row["form"])

    def placed(self, found: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
        for segment, data in found:
            yield (None, self.head["key"], (segment << _PLACE_BITS) + self.seen, data, *(None,) * 6)
            self.seen += 1

    def add(self, row: dict) -> Iterator[tuple]:
        if row["position"] == 0:
            self.copies += row["copies"]
        if row["piece"] is not None:
            self.sha.update(row["piece"])
            yield from self.placed(self.taken.feed(row["piece"]))

    def close(self) -> Iterator[tuple]:
        yield from self.placed(self.taken.close())
        facts = (self.head[c] for c in ("n", "form", "prefix_chars", "middle_chars"))
        yield (self.head["doc_id"], self.head["key"], _CLOSE << _PLACE_BITS, None, self.copies, *facts, self.sha.hexdigest())


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: int = UNIT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row of ``docs``.

    Pieces are shuffled once, by document. In output order they stream into the
    digest of the output, and through ``Restorer``, which sees only output and form; what it gives is sorted
    anew by place in the text, within the partition, and streams into the digest of the restored text. No text is held
    whole behind the shuffle. Repeated rows are repeated in the result, a null id is kept, other columns are ignored, an empty
    table gives no rows.
    """
    laid = assembled(pieces(docs, doc_id, text, unit))
    own = [laid.schema["doc_id"]]
    facts = _parse_datatype_string(f"{_FACTS}, output_sha256 string").fields
    passed = StructType([*own, *_parse_datatype_string("key binary, place long, piece binary, copies int"), *facts])
    final = StructType([*own, *facts, *_parse_datatype_string("restored_sha256 string")])

    def digest_output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Digest | None = None
        out: list[tuple] = []
        for first, row in _documents(batches):
            if first:
                out += open_.close() if open_ else ()
                open_ = _Digest(row)
            out += open_.add(row)
            if len(out) >= BATCH_ROWS:
                yield _arrow(passed, out)
                out = []
        out += open_.close() if open_ else ()
        if out:
            yield _arrow(passed, out)

    def digest_restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256()
        for batch in batches:
            ends, shas = [], []
            copies = batch.column("copies").to_pylist()
            for i, piece in enumerate(batch.column("piece").to_pylist()):
                if piece is not None:
                    sha.update(piece)
                else:
                    ends.append(i)
                    shas.append(sha.hexdigest())
                    sha = hashlib.sha256()
            closed = batch.select(final.names[:-1]).take(pa.array(ends, pa.int32()))
            closed = pa.RecordBatch.from_arrays([*closed.columns, pa.array(shas, pa.string())], final.names)
            yield from _repeated(closed, [copies[i] for i in ends])

    return laid.mapInArrow(digest_output, passed).sortWithinPartitions("key", "place").mapInArrow(digest_restored, final)


def _repeated(rows: pa.RecordBatch, copies: list[int]) -> Iterator[pa.RecordBatch]:
    """Each row as many times as it has copies, in batches."""
    at = np.repeat(np.arange(len(copies)), copies) if max(copies, default=1) < 8192 else None
    if at is not None:
        yield rows.take(pa.array(at, pa.int32()))
        return
    for i, n in enumerate(copies):
        for done in range(0, n, 8192):
            yield rows.take(pa.array(np.full(min(8192, n - done), i), pa.int32()))


def outputs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: int = UNIT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``: the output texts, put together from their sorted pieces.

    Null ids, texts, repeated rows and empty tables as in ``digests``. About SLICE_BYTES of output are held at once, a longer text alone.
    """
    laid = assembled(pieces(docs, doc_id, text, unit))
    schema = StructType([laid.schema["doc_id"], *_parse_datatype_string(f"{_FACTS}, output string")])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        copies: list[int] = []
        head, parts, size = None, [], 0

        def close() -> None:
            if head is not None:
                rows.append((*(head[c] for c in schema.names[:-1]), b"".join(parts)))

        def made() -> Iterator[pa.RecordBatch]:
            whole = pa.array([r[-1] for r in rows], pa.binary()).view(pa.string())
            facts = _arrow(StructType(schema.fields[:-1]), [r[:-1] for r in rows])
            yield from _repeated(pa.RecordBatch.from_arrays([*facts.columns, whole], schema.names), copies)

        for first, row in _documents(batches):
            if first:
                close()
                if size > SLICE_BYTES or len(rows) >= BATCH_ROWS:
                    yield from made()
                    rows, copies, size = [], [], 0
                head, parts = row, []
                copies.append(0)
            copies[-1] += row["copies"] if row["position"] == 0 else 0
            if row["piece"] is not None:
                parts.append(row["piece"])
                size += len(row["piece"])
        close()
        if rows:
            yield from made()

    return laid.mapInArrow(put_together, schema)
