"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import connected_components
from siftwell.runtime import cut_lineage

#: Orders in which the vectors are laid out, random hashes that make the key of an order, and neighbours compared with each vector.
PASSES, PLANES, NEIGHBOURS = 12, 24, 16
#: Passes that are shuffled together.
AT_ONCE = 4
#: Vectors of a component that are multiplied with as many others at a time.
BLOCK = 1024
SEED = 7


def _unit(values: list | None) -> np.ndarray | None:
    """The vector of length one, None if it is null, empty, zero or holds null or non-finite components."""
    vector = np.array(values if values is not None else [], np.float64)
    largest = np.abs(vector).max(initial=0.0)
    if not 0 < largest < np.inf:
        return None
    vector = vector / largest
    return vector / np.sqrt(vector @ vector)


def with_units(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, unit): the vector of length one in double precision, null if it or the label can't be compared."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("label").is_valid().to_pylist()
            units = [_unit(v) if ok else None for v, ok in zip(batch.column("vector").to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(units, pa.list_(pa.float64()))], ["vec_id", "label", "unit"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, unit array<double>")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def with_keys(nodes: DataFrame, passes: range, size: int) -> DataFrame:
    """``nodes`` once for each pass, with ``pass`` and ``key``: the signs of PLANES random projections, the first in the highest bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = [np.random.default_rng([SEED, nth, size]).standard_normal((PLANES, size)) for nth in passes]
        for batch in batches:
            units = _matrix(batch.column("unit"), size)
            for nth, own in zip(passes, planes, strict=True):
                keys = (units @ own.T > 0) @ (1 << np.arange(PLANES - 1, -1, -1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), nth), pa.int32()), pa.array(keys, pa.int64())], [*batch.schema.names, "pass", "key"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.mapInArrow(run, f"{fields}, pass int, key long")


def neighbour_links(keyed: DataFrame, size: int, cosine: float, neighbours: int) -> DataFrame:
    """(a, b) of vectors at most ``neighbours`` places apart in the order of pass, label and key whose cosine is high enough.

    The order is dealt out by ranges, so a label or key of any size spans as many tasks as
    it needs; places are compared within a task. Pairs cut apart at a task's edge are left to the other passes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            part = (batch.column("node").to_numpy(), batch.column("label").to_numpy(zero_copy_only=False), _matrix(batch.column("unit"), size))
            old = 0 if held is None else len(held[0])
            ids, labels, units = part if held is None else tuple(np.concatenate(x) for x in zip(held, part, strict=True))
            left, right = [], []
            for step in range(1, min(neighbours, len(ids) - 1) + 1):
                first = max(0, old - step)
                near = np.einsum("ij,ij->i", units[first : len(ids) - step], units[first + step :]) >= cosine
                hit = np.flatnonzero(near & (labels[first : len(ids) - step] == labels[first + step :])) + first
                left.append(ids[hit])
                right.append(ids[hit + step])
            held = tuple(x[-neighbours:] for x in (ids, labels, units))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    order = ["pass", "label", "key", "node"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("node", "label", "unit").mapInArrow(run, "a long, b long")


def link_counts(members: DataFrame, size: int, cosine: float, block: int = BLOCK) -> DataFrame:
    """(node, n_links): other vectors within ``cosine`` of each one in its component, copies included. ``members``: root, node, unit, n.

    A component above ``block`` vectors is cut into blocks of about as many by hashed id; every pair of
    blocks is one product and dealt out by itself, and only a count per vector and block pair is sent on.
    """
    large = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    cut = members.join(large, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = pairs.select("root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") <= F.col("other")).alias("low"), "node", "unit", "n")

    def count(key, table):
        table = table.combine_chunks()
        ids, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        units = _matrix(table.column("unit").combine_chunks(), size)
        if key[1].as_py() == key[2].as_py():
            near = units @ units.T >= cosine
            return pa.table({"node": ids, "links": near @ n - np.diagonal(near) * n})
        low = table.column("low").to_numpy()
        a, b = np.flatnonzero(low), np.flatnonzero(~low)
        near = units[a] @ units[b].T >= cosine
        return pa.table({"node": np.concatenate([ids[a], ids[b]]), "links": np.concatenate([near @ n[b], near.T @ n[a]]).astype(np.int64)})

    return dealt.repartition("root", "p", "q").groupBy("root", "p", "q").applyInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("n_links"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, passes: int = PASSES, neighbours: int = NEIGHBOURS, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Equal vectors of a label are one node. Each pass sorts the nodes of a label by the
    concatenated signs of random projections and compares every node with its
    ``neighbours`` next ones; pairs of cosine ``cosine`` or more are kept and all passes
    united to components. Links are then counted exactly within each component, so a
    group denser than the window loses none. Vectors that are null, empty, zero or hold null
    or non-finite components, and vectors without a label, link with nothing, nor do vectors
    of different lengths. Repeated rows and other copies link with each other. A null
    vec_id names a component only if nothing else is in it, and such a row is not kept; an empty table gives no rows.
    """
    rows = cut_lineage(with_units(vectors, vec_id, vector, label).withColumn("row", F.monotonically_increasing_id()))
    nodes = cut_lineage(rows.where("unit is not null").groupBy("label", "unit").agg(F.min("row").alias("node"), F.min("vec_id").alias("first_id"), F.count("*").alias("n")))
    links = []
    sizes = [r[0] for r in nodes.select(F.size("unit")).distinct().collect()]
    for size in sizes:
        own = nodes.where(F.size("unit") == size).select("node", "label", "unit")
        links += [cut_lineage(neighbour_links(with_keys(own, range(i, min(i + AT_ONCE, passes)), size), size, cosine, neighbours)) for i in range(0, passes, AT_ONCE)]
    if not links:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    groups = connected_components(reduce(DataFrame.unionAll, links))
    members = cut_lineage(nodes.join(groups, "node"))
    counts = [link_counts(members.where(F.size("unit") == size).select("root", "node", "unit", "n"), size, cosine) for size in sizes]
    smallest = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = members.join(smallest, "root").select("node", "component_id")
    linked = named.join(reduce(DataFrame.unionAll, counts), "node")
    known = nodes.join(linked, "node", "left").select(
        "label", "unit", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    found = rows.join(known, ["label", "unit"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
