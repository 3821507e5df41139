"""Merkle manifest of a dataset: leaf places from the ranks of ids in compressed bitmaps, trees reduced by keyed slot arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from siftwell.runtime import cut_lineage, number_in_group, number_rows, running

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of an id within its container, levels of a slot array, rows of a partial count.
LOW_BITS, LEVELS, COUNT_ROWS = 10, 8, 1 << 18
#: An id that is null stands in a container below all others.
_NULL_HIGH = -(1 << 62)


def node(children: Sequence[str]) -> str:
    """H: lowercase hex SHA-256 of the digests' hex text, one after another."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """H of a row: each value as ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each group of a stream that is sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        change = np.zeros(max(len(batch) - 1, 0), bool)
        for c in keys:
            column = batch.column(c)
            change |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, max(len(batch) - 1, 0))))
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                own = tuple(batch.column(c)[a].as_py() for c in keys)
                if own != key and held:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = own
                held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _grouped(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[tuple, pa.Table], dict[str, list]], schema: str) -> DataFrame:
    """What ``fn`` makes of each group of ``keys`` (none null), its rows in ``order``: groups are streamed, one is held at a time."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {n: [] for n in names}
        for key, rows in _runs(batches, keys):
            for n, values in fn(key, rows).items():
                out[n] += values
            if len(out[names[0]]) >= 4096:
                yield pa.RecordBatch.from_pydict(out, types)
                out = {n: [] for n in names}
        if out[names[0]]:
            yield pa.RecordBatch.from_pydict(out, types)

    types = to_arrow_schema(_parse_datatype_string(schema))
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _container(lows: np.ndarray) -> bytes:
    """Sorted distinct low bits as a bitmap, or as themselves if that is shorter."""
    if 2 * len(lows) < (1 << LOW_BITS) // 8:
        return lows.astype(np.uint16).tobytes()
    bits = np.zeros(1 << LOW_BITS, np.uint8)
    bits[lows] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Ranks:
    """A container with its popcount directory: ``rank`` counts the rows whose low bits are smaller."""

    def __init__(self, data: bytes, extra: Sequence[tuple[int, int]] = ()) -> None:
        if len(data) == (1 << LOW_BITS) // 8:
            self.words = np.frombuffer(data, np.uint64)
        else:
            bits = np.zeros(1 << LOW_BITS, np.uint8)
            bits[np.frombuffer(data, np.uint16)] = 1
            self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.extra_lows = np.array([low for low, _ in extra], np.int64)
        self.extra = np.concatenate([[0], np.cumsum([n for _, n in extra], dtype=np.int64)])

    def lows(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, lows: np.ndarray) -> np.ndarray:
        below = self.words[lows >> 6] & ((np.uint64(1) << (lows & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[lows >> 6] + np.bitwise_count(below).astype(np.int64) + self.extra[np.searchsorted(self.extra_lows, lows)]


_COUNTS = "run string, high long, bits binary, lows array<int>, extra array<long>"


def containers(ids: DataFrame) -> DataFrame:
    """(run, high, bits, lows, extra, rows, before, n) of ``ids`` (run, high, low): per run one compressed bitmap for each ``high``.

    Tasks make partial bitmaps of what they read, which are merged; ``lows`` and ``extra`` name ids that stand on
    several rows and how many more than one; ``before`` is the number of the run's rows in lower containers, ``n`` in all.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= COUNT_ROWS:
                yield counted(pa.Table.from_batches(held))
                held = []
        if held:
            yield counted(pa.Table.from_batches(held))

    def counted(rows: pa.Table) -> pa.RecordBatch:
        found = rows.group_by(["run", "high", "low"]).aggregate([([], "count_all")]).sort_by([("run", "ascending"), ("high", "ascending"), ("low", "ascending")])
        out: dict[str, list] = {"run": [], "high": [], "bits": [], "lows": [], "extra": []}
        for (run, high), part in _runs(iter(found.combine_chunks().to_batches()), ("run", "high")):
            lows, n = part.column("low").to_numpy(), part.column("count_all").to_numpy()
            many = n > 1
            for name, value in zip(out, (run, high, _container(lows), lows[many].tolist(), (n[many] - 1).tolist()), strict=True):
                out[name].append(value)
        return pa.RecordBatch.from_pydict(out, schema)

    def merged(key: tuple, rows: pa.Table) -> dict[str, list]:
        count = np.zeros(1 << LOW_BITS, np.int64)
        for bits, lows, extra in zip(*(rows.column(c).to_pylist() for c in ("bits", "lows", "extra")), strict=True):
            count[Ranks(bits).lows()] += 1
            count[np.array(lows, np.int64)] += np.array(extra, np.int64)
        many = np.flatnonzero(count > 1)
        return {
            "run": [key[0]], "high": [key[1]], "bits": [_container(np.flatnonzero(count))], "lows": [many.tolist()],
            "extra": [(count[many] - 1).tolist()], "rows": [int(count.sum())],
        }

    schema = to_arrow_schema(_parse_datatype_string(_COUNTS))
    parts = ids.select("run", "high", "low").mapInArrow(partial, _COUNTS)
    whole = _grouped(parts, ("run", "high"), (), merged, f"{_COUNTS}, rows long")
    summed = cut_lineage(running(whole, ["run"], ["high"], F.col("rows"), "sum", "before", inclusive=False))
    return summed.join(summed.groupBy("run").agg(F.sum("rows").alias("n")), "run")


def places(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(row, place, n) of ``asked`` (run, high, low, row): the rank of an id among the ``n`` rows of its run, by its container's bitmap, in any order."""

    def ranked(key: tuple, rows: pa.Table) -> dict[str, list]:
        bits, lows, extra, before, n = (rows.column(c)[0].as_py() for c in ("bits", "lows", "extra", "before", "n"))
        own = rows.slice(1)
        rank = Ranks(bits, list(zip(lows, extra, strict=True))).rank(own.column("low").to_numpy()) + before
        return {"row": own.column("row").to_pylist(), "place": rank.tolist(), "n": [n] * len(own)}

    empty = {c: F.lit(None).cast(t) for c, t in (("bits", "binary"), ("lows", "array<int>"), ("extra", "array<long>"), ("before", "long"), ("n", "long"))}
    sides = found.select("run", "high", F.lit(-1).alias("low"), F.lit(None).cast("long").alias("row"), *empty).unionByName(
        asked.select("run", "high", "low", "row", *(c.alias(n) for n, c in empty.items()))
    )
    return _grouped(sides, ("run", "high"), ("low",), ranked, "row long, place long, n long")


def _depth(n: int) -> int:
    return max(0, int(n - 1).bit_length())


def _reduced(digests: list[str | None], levels: int) -> list[list[str]]:
    """Level by level, a slot array's nodes: two consecutive ones, or the last one, become their H."""
    out = [digests]
    for _ in range(levels):
        out.append([node(out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def reduce_trees(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots) of ``leaves`` (run, place, n, digest), n being the number of leaves of the run.

    ``levels`` are written tables of nodes, the leaves first, each LEVELS above the one before; a group of 2 ** LEVELS neighbours
    fills one slot array by place and gives one node. ``roots`` is (run, digest).
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = [leaves]

    def up(key: tuple, rows: pa.Table) -> dict[str, list]:
        slots: list[str | None] = [None] * len(rows)
        for at, digest in zip((rows.column("place").to_numpy() & ((1 << LEVELS) - 1)).tolist(), rows.column("digest").to_pylist(), strict=True):
            slots[at] = digest
        n = rows.column("n")[0].as_py()
        top = _reduced(slots, min(LEVELS, _depth(n)))[-1][0]
        return {"run": [key[0]], "place": [key[1]], "n": [-(-n >> LEVELS)], "digest": [top]}

    while most > 1:
        below = levels[-1].select("run", F.shiftright("place", LEVELS).alias("slots"), "place", "n", "digest")
        levels.append(cut_lineage(_grouped(below, ("run", "slots"), (), up, "run string, place long, n long, digest string")))
        most = -(-most >> LEVELS)
    return levels, levels[-1].select("run", "digest")


def _fold(digest: str, path: Sequence[str]) -> str:
    """The root that ``digest`` leads to. A step of a path is ``L`` or ``R`` with the sibling on that side, or ``-`` for none."""
    for step in path:
        digest = node([step[1:], digest] if step[0] == "L" else [digest, step[1:]] if step[0] == "R" else [digest])
    return digest


def _own_path(levels: list[list[str]], at: int) -> list[str]:
    path = []
    for nodes in levels[:-1]:
        other = at ^ 1
        path.append("-" if other >= len(nodes) else f"{'L' if other < at else 'R'}{nodes[other]}")
        at >>= 1
    return path


def paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(run, place, n, digest, path, top) of the slot arrays' parents: the way from each node of the second level up, through its run's ``tops`` (run, path, top).

    ``path`` joins the steps by commas. The last table is ``tops`` itself, at place 0 of each run.
    """
    above = tops.select("run", F.lit(0).cast("long").alias("place"), "path", "top")

    def down(key: tuple, rows: pa.Table) -> dict[str, list]:
        upper, top, places_, nodes = _slots(rows)
        made = _reduced(nodes, min(LEVELS, _depth(rows.column("n")[-1].as_py())))
        ways = [",".join([*_own_path(made, p & ((1 << LEVELS) - 1)), *upper]) for p in places_]
        return {"run": [key[0]] * len(places_), "place": places_, "path": ways, "top": [top] * len(places_)}

    for level in reversed(levels[1:-1]):
        above = cut_lineage(_grouped(_with_paths(level, above, ()), ("run", "slots"), ("below",), down, "run string, place long, path string, top string"))
    return above


def _with_paths(level: DataFrame, above: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Rows of ``level`` by slot array, the way from the array's top upwards in front of them."""
    rows = level.select("run", F.shiftright("place", LEVELS).alias("slots"), F.lit(1).alias("below"), "place", "n", "digest", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("top"), *carried)
    heads = above.select("run", F.col("place").alias("slots"), F.lit(0).alias("below"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"), "path", "top")
    return rows.unionByName(heads.select("*", *(F.lit(None).cast(level.schema[c].dataType).alias(c) for c in carried)))


def _slots(rows: pa.Table) -> tuple[list[str], str, list[int], list[str]]:
    path, top = rows.column("path")[0].as_py(), rows.column("top")[0].as_py()
    own = rows.slice(1)
    places_ = own.column("place").to_pylist()
    nodes: list[str] = [""] * len(places_)
    for p, digest in zip(places_, own.column("digest").to_pylist(), strict=True):
        nodes[p & ((1 << LEVELS) - 1)] = digest
    return [s for s in path.split(",") if s], top, places_, nodes


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", tampered: Column | None = None, changed: dict[str, Column] | None = None) -> DataFrame:
    """(row, id, run, high, low, digest, altered): a written leaf for each row of ``docs``; ``altered`` is the leaf of a ``tampered`` row with ``changed`` columns, else null."""
    own = leaf([F.col(c) for c in fields])
    other = leaf([(changed or {}).get(c, F.col(c)) for c in fields])
    key = F.col(order).cast("long")
    return cut_lineage(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(order).alias("id"),
            F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("run"),
            F.coalesce(F.shiftright(key, LOW_BITS), F.lit(_NULL_HIGH)).alias("high"),
            F.coalesce(key.bitwiseAND(F.lit((1 << LOW_BITS) - 1)), F.lit(0)).cast("int").alias("low"),
            own.alias("digest"),
            (F.when(tampered, other) if tampered is not None else F.lit(None).cast("string")).alias("altered"),
        )
    )


def placed(rows: DataFrame) -> DataFrame:
    """``leaves`` with their ``place`` in their run and the run's number of rows ``n``, written.

    Rows whose id no other row of the run has get their place from the rank. Ids on several rows are ranked once and
    their rows numbered from there by leaf, spread over tasks however many they are.
    """
    found = containers(rows)
    several = cut_lineage(found.where(F.size("lows") > 0).select("run", "high", F.explode("lows").alias("low")))
    if several.isEmpty():
        ranks = places(rows, found)
    else:
        key = ["run", "high", "low"]
        alone = rows.join(several, key, "left_anti")
        named = cut_lineage(several.withColumn("row", F.monotonically_increasing_id()))
        first = places(named, found).withColumnRenamed("place", "first").join(named, "row").drop("row")
        ties = number_in_group(rows.join(several, key, "left_semi"), key, ["digest", "row"], "nth").join(first, key)
        ranks = places(alone, found).unionByName(ties.select("row", (F.col("first") + F.col("nth") - 1).alias("place"), "n"))
    return cut_lineage(rows.join(ranks, "row"))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", tampered: Column | None = None, changed: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, run, place, leaf, subroot, root, path, proof, folded_root) for every row of ``docs``.

    Rows are leaves over ``fields``. The leaves of a ``group`` (a null one is a group of its own, first) stand by ``order``, null first,
    equal ones by leaf. The places come from the ranks of ids in the group's bitmaps, so the leaves themselves are
    never sorted; trees are reduced in slot arrays, first each group's, then the tree of the groups' subroots in bytewise order.
    ``path`` holds the siblings of the leaf up to the root, ``proof`` is H of them; ``folded_root`` is the root that the row leads
    to by that path, from its leaf, or where ``tampered`` holds from the leaf of the row with ``changed`` columns. Extra columns are
    ignored, repeated rows are leaves of their own, an empty table gives no rows. ``order`` is an integer column.
    """
    own = placed(leaves(docs, fields, group, order, tampered, changed))
    trees, subroots = reduce_trees(own)
    ordered = cut_lineage(number_rows(subroots, ["run"], "nth"))
    tops = cut_lineage(ordered.select(F.lit("").alias("run"), (F.col("nth") - 1).alias("place"), F.lit(ordered.count()).cast("long").alias("n"), "digest", F.col("run").alias("named")))
    upper, root = reduce_trees(tops)
    start = root.select("run", F.lit("").alias("path"), F.col("digest").alias("top"))

    def through(key: tuple, rows: pa.Table) -> dict[str, list]:
        above, top, places_, nodes = _slots(rows)
        made = _reduced(nodes, min(LEVELS, _depth(rows.column("n")[-1].as_py())))
        ways = [",".join([*_own_path(made, p & ((1 << LEVELS) - 1)), *above]) for p in places_]
        own_rows = rows.slice(1)
        return {"run": own_rows.column("named").to_pylist(), "path": ways, "top": [f"{d} {top}" for d in own_rows.column("digest").to_pylist()]}

    heads = _grouped(_with_paths(tops, paths(upper, start), ["named"]), ("run", "slots"), ("below",), through, "run string, path string, top string")
    heads = cut_lineage(heads)

    def proofs(key: tuple, rows: pa.Table) -> dict[str, list]:
        above, top, places_, nodes = _slots(rows)
        made = _reduced(nodes, min(LEVELS, _depth(rows.column("n")[-1].as_py())))
        subroot, root_ = top.split(" ")
        out: dict[str, list] = {c: [] for c in ("id", "run", "place", "leaf", "subroot", "root", "path", "proof", "folded_root")}
        own_rows = rows.slice(1)
        for id_, place, digest, altered in zip(own_rows.column("id").to_pylist(), places_, own_rows.column("digest").to_pylist(), own_rows.column("altered").to_pylist(), strict=True):
            path = [*_own_path(made, place & ((1 << LEVELS) - 1)), *above]
            values = (id_, key[0], place, digest, subroot, root_, ",".join(path), node([s[1:] for s in path]), _fold(altered or digest, path))
            for c, v in zip(out, values, strict=True):
                out[c].append(v)
        return out

    schema = f"id {docs.schema[order].dataType.simpleString()}, run string, place long, leaf string, subroot string, root string, path string, proof string, folded_root string"
    return _grouped(_with_paths(own, paths(trees, heads), ["id", "altered"]), ("run", "slots"), ("below",), proofs, schema).withColumnRenamed("id", "doc_id")
