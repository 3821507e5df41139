"""Vector search: exact and cell-probed top-k, links, diversity, embedding and caching."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions import text as tx
from siftwell.runtime import cut_lineage

# A batch of queries travels to every task only up to this many bytes of float64.
MAX_QUERY_BYTES = 64 << 20
# Rows per side of one block product beyond that, and similarities that one product may hold.
BLOCK_ROWS = 8192
TILE_CELLS = 8 << 20
# Blocks that a side is cut into while they hold no more rows than a task may hold of a side.
BLOCK_PARTS, HELD_ROWS = 16, 32_768
# Rows of (query, cell) that are made at a time, and of hits that are given out at a time.
ASK_ROWS, GIVEN_ROWS = 65_536, 100_000
# What rounding of a cosine to six places can hide.
SLACK = 2e-6


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit-length float64 rows of a list column (zero vectors stay zero)."""
    flat = column.combine_chunks()
    rows = len(flat)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = values.reshape(rows, -1) if rows else np.zeros((0, 1))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _order_of(ids: np.ndarray) -> np.ndarray:
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    return rank


def _top_k(sims: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by falling similarity, ties by id order."""
    if len(sims) > k:
        kth = np.partition(sims, len(sims) - k)[len(sims) - k]
        cand = np.flatnonzero(sims >= kth)
    else:
        cand = np.arange(len(sims))
    return cand[np.lexsort((tie[cand], -sims[cand]))][:k]


def _block_product(qid, qm, cid, cm, k: int, not_self: bool):
    """(query ids, chunk ids, similarities) of the top k of every query against one block."""
    q, c, s = _block_best(qid, qm, cid, cm, k, not_self)
    return qid[q], cid[c], s


def _block_best(qid, qm, cid, cm, k: int, not_self: bool, bar: np.ndarray | None = None):
    """Places of queries and of rows, and similarities, of the top k of every query against one block; with a ``bar`` for each query, of those that reach it.

    Queries are taken in tiles, so that a product holds at most ``TILE_CELLS`` similarities. A product in single precision leaves those that
    can be among the best k; only their similarities are computed in double precision, or all of a row where very many are as near.
    """
    tie = _order_of(cid)
    qs, cs, ss = [], [], []
    tile = max(1, TILE_CELLS // max(1, len(cid)))
    wanted = k + not_self
    slack = np.float32(SLACK + 4 * (qm.shape[1] + 8) * np.finfo(np.float32).eps)
    few = max(64, 4 * wanted)
    quick = len(cid) > few and qm.dtype == cm.dtype == np.float64 and np.isfinite(qm).all() and np.isfinite(cm).all()
    cm32 = cm.astype(np.float32) if quick else None
    for start in range(0, len(qid), tile):
        block = qm[start : start + tile]
        crowded = np.arange(len(block))
        if quick:
            near = block.astype(np.float32) @ cm32.T
            least = np.partition(near, len(cid) - wanted, axis=1)[:, len(cid) - wanted] if bar is None else bar[start : start + tile].astype(np.float32)
            held = near >= (least - slack)[:, None]
            crowd = held.sum(axis=1) > few
            crowded = np.flatnonzero(crowd)
            held[crowd] = False
            i, j = np.nonzero(held)
            exact = np.round(np.einsum("ij,ij->i", block[i], cm[j]), 6)
            if not_self:
                other = cid[j] != qid[start + i]
                i, j, exact = i[other], j[other], exact[other]
            order = np.lexsort((tie[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.searchsorted(i, np.arange(len(block)))
            best = np.arange(len(i)) - first[i] < k
            qs.append(start + i[best])
            cs.append(j[best])
            ss.append(exact[best])
        for i in crowded.tolist():
            row = np.round(cm @ block[i], 6)
            if not_self:
                row = np.where(cid == qid[start + i], -np.inf, row)
            top = _top_k(row, tie, k)
            top = top[np.isfinite(row[top])]
            qs.append(np.repeat(start + i, len(top)))
            cs.append(top)
            ss.append(row[top])
    q = np.concatenate(qs) if qs else np.zeros(0, int)
    c = np.concatenate(cs) if cs else np.zeros(0, int)
    s = np.concatenate(ss) if ss else np.zeros(0)
    if bar is not None:
        reached = s >= bar[q]
        q, c, s = q[reached], c[reached], s[reached]
    return q, c, s


class _Best:
    """The best ``k`` rows of each of a batch of queries so far, and its bar: the similarity of the k-th, or what it starts with."""

    def __init__(self, k: int, bar: np.ndarray) -> None:
        self.k, self.bar = k, bar
        self.query, self.ids, self.sims = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, query: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        if not len(query):
            return
        met = np.zeros(len(self.bar), bool)
        met[query] = True
        old = met[self.query]
        q, s = np.concatenate([self.query[old], query]), np.concatenate([self.sims[old], sims])
        c = ids if self.ids is None else np.concatenate([self.ids[old], ids])
        order = np.lexsort((_order_of(c), -s, q))
        q, c, s = q[order], c[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        full = place == self.k - 1
        self.bar[q[full]] = np.maximum(self.bar[q[full]], s[full])
        keep = place < self.k
        self.query, self.sims = np.concatenate([self.query[~old], q[keep]]), np.concatenate([self.sims[~old], s[keep]])
        self.ids = c[keep] if self.ids is None else np.concatenate([self.ids[~old], c[keep]])


def _types(queries: DataFrame, query_id: str, vectors: DataFrame, id_col: str) -> str:
    return f"query_id {dict(queries.dtypes)[query_id]}, {id_col} {dict(vectors.dtypes)[id_col]}, cosine double"


def _ranked(partial: DataFrame, id_col: str, k: int) -> DataFrame:
    """Final cut over the per-block winners; similarity is 1 - distance / 2, floored at 0."""
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), id_col)
    distance = F.round(1 - F.col("cosine"), 6)
    return (
        partial.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select(
            "query_id", id_col, distance.alias("distance"),
            F.round(F.greatest(F.lit(0.0), 1 - distance / 2), 7).alias("similarity"), "rank",
        )
    )


def _pairwise(left: DataFrame, right: DataFrame, keys: list[str], id_col: str, k: int, schema: str, not_self: bool) -> DataFrame:
    """Block products of two tables that carry the same block keys; each task holds one block of each side."""
    names = ["query_id", id_col, "cosine"]

    def product(lt: pa.Table, rt: pa.Table) -> pa.Table:
        if lt.num_rows == 0 or rt.num_rows == 0:
            empty = {"query_id": lt["query_id"].slice(0, 0), id_col: rt[id_col].slice(0, 0), "cosine": pa.array([], pa.float64())}
            return pa.table(empty)
        q, c, s = _block_product(
            lt["query_id"].to_numpy(), _matrix(lt["qvec"]), rt[id_col].to_numpy(), _matrix(rt["vec"]), k, not_self
        )
        return pa.table([pa.array(q, lt["query_id"].type), pa.array(c, rt[id_col].type), pa.array(s)], names=names)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(product, schema)


def _block_size(total: int, least: int) -> int:
    """Rows of a block of a table of ``total`` rows: ``least`` or more, so that a table has BLOCK_PARTS blocks as long as a block stays below HELD_ROWS.

    Each block goes to every block of the other side, so what is shuffled grows with the number of blocks.
    """
    return max(least, min(HELD_ROWS, -(-total // BLOCK_PARTS)))


def _blocks(df: DataFrame, id_col: str, rows: int) -> tuple[DataFrame, int]:
    total = df.count()
    n = max(1, -(-total // _block_size(total, rows)))
    return df.withColumn("_b", F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")), n


def block_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, query_id: str, query_vec: str, not_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact top-k for query tables too large to send to every task.

    Both sides are cut by id hash into blocks of bounded size (``block_rows`` at least) and every pair of
    blocks is one task: no row pairs are ever written, only k winners per query
    and block, and no block is larger than another.
    """
    left, nl = _blocks(queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("qvec")), "query_id", block_rows)
    right, nr = _blocks(vectors.select(id_col, F.col(vec_col).alias("vec")), id_col, block_rows)
    left = left.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))).withColumnRenamed("_b", "_l")
    right = right.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(nl - 1)))).withColumnRenamed("_b", "_r")
    schema = _types(queries, query_id, vectors, id_col)
    return _ranked(_pairwise(left, right, ["_l", "_r"], id_col, k, schema, not_self), id_col, k)


def knn_exact(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "chunk_id", vec_col: str = "vector", query_id: str = "query_id", query_vec: str = "vector", not_self: bool = False) -> DataFrame:
    """Top ``k`` by cosine for every query: query_id, id, distance (0–2), similarity, rank.

    A query batch below ``MAX_QUERY_BYTES`` (checked by a bounded fetch) goes to
    all tasks; each task multiplies its Arrow batches tile by tile and keeps only k rows per
    query, whose last one is the bar for the next batch, so the vectors are read once and never shuffled. A larger batch takes
    the block-product path. Filter ``vectors`` first: the predicate reaches the scan.
    """
    first = queries.select(query_vec).limit(1).collect()
    if not first:
        first = [[[0.0]]]
    limit = max(1, MAX_QUERY_BYTES // (8 * max(1, len(first[0][0]))))
    head = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("qvec")).limit(limit + 1).toArrow()
    if head.num_rows > limit:
        return block_top_k(vectors, queries, k, id_col, vec_col, query_id, query_vec, not_self)
    qid, qm = head["query_id"].to_numpy(), _matrix(head["qvec"])
    qtype = head["query_id"].type
    shared = vectors.sparkSession.sparkContext.broadcast((qid, qm))
    schema = _types(queries, query_id, vectors, id_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mat = shared.value
        best, id_type = _Best(k, np.full(len(ids), -np.inf)), None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = pa.Table.from_batches([batch])
            id_type = t[id_col].type
            cid, block = t[id_col].to_numpy(), _matrix(t["vec"])
            query, at, sims = _block_best(ids, mat, cid, block, k, not_self, best.bar if np.isfinite(best.bar).all() else None)
            best.add(query, cid[at], sims)
        if best.ids is not None:
            for a in range(0, len(best.query), GIVEN_ROWS):
                part = slice(a, a + GIVEN_ROWS)
                yield pa.record_batch(
                    [pa.array(ids[best.query[part]], qtype), pa.array(best.ids[part], id_type), pa.array(best.sims[part])], names=["query_id", id_col, "cosine"]
                )

    partial = vectors.select(id_col, F.col(vec_col).alias("vec")).mapInArrow(scan, schema)
    return _ranked(partial, id_col, k)


def knn_by_file(vectors: DataFrame, queries: DataFrame, file_col: str, value: object, k: int = 10, **cols: str) -> DataFrame:
    """Top-k within one file: the equality filter is applied before the search."""
    return knn_exact(vectors.filter(F.col(file_col) == F.lit(value)), queries, k, **cols)


def similarity_threshold(hits: DataFrame, threshold: float | Column, distance: str = "distance") -> DataFrame:
    """similarity = max(0, 1 - distance / 2), kept when at least ``threshold``."""
    sim = F.round(F.greatest(F.lit(0.0), 1 - F.col(distance) / 2), 7)
    return hits.withColumn("similarity", sim).filter(F.col("similarity") >= threshold)


# Rows from which the centres of exact cells are learned (they decide how much is skipped, never what is found), and rows of a cell aimed at.
CENTRE_ROWS, CELL_ROWS = 16_384, 2048


def _centres(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Centres of unit vectors by a few rounds of Lloyd's algorithm."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(sample @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        held = np.bincount(nearest, minlength=cells)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def _distances(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (m * m).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * (m @ centres.T)
    return np.sqrt(np.maximum(square, 0))


def metric_cells(vectors: DataFrame, id_col: str, vec_col: str, cells: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(placed, centres): (id, vec, cell, away) of every vector, written, with its nearest centre and the distance to it.

    Centres are learned on about CENTRE_ROWS vectors, by default one for CELL_ROWS of all.
    """
    total = vectors.count()
    base = vectors.select(id_col, F.col(vec_col).alias("vec"))
    share = min(1.0, CENTRE_ROWS / max(total, 1))
    sample = base.sample(share, 7).select("vec").limit(2 * CENTRE_ROWS).toArrow() if share < 1 else base.select("vec").toArrow()
    m = _matrix(sample["vec"])
    wanted = max(1, total // CELL_ROWS) if cells is None else cells
    centres = _centres(m, max(1, min(wanted, len(m) // 4))) if len(m) else np.zeros((1, 1))
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = _distances(_matrix(pa.chunked_array([batch.column("vec")])), shared.value)
                cell = np.argmin(away, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell])], [id_col, "vec", "cell", "away"])

    kind = base.schema["vec"].dataType.simpleString()
    return cut_lineage(base.mapInArrow(place, f"{id_col} {dict(base.dtypes)[id_col]}, vec {kind}, cell int, away double")), centres


def _open_cells(vec: pa.Array, bar: np.ndarray, home: np.ndarray, centres: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(open, away): for each row which cells can hold a vector as near as its bar, its own left out, and how far their centres are."""
    near, far = edges.T
    reach = np.sqrt(np.maximum(2 - 2 * (bar - SLACK), 0))[:, None] + 1e-9
    away = _distances(_matrix(pa.chunked_array([vec])), centres)
    wanted = (away - far <= reach) & (near - away <= reach)
    own = home < len(centres)
    wanted[np.flatnonzero(own), home[own]] = False
    return wanted, away


def _edges(cells: int, radii: dict[int, tuple[float, float]]) -> np.ndarray:
    edges = np.full((cells, 2), np.nan)
    for cell, between in radii.items():
        edges[cell] = between
    return edges


def cell_asks(placed: DataFrame, bars: DataFrame, centres: np.ndarray, radii: dict[int, tuple[float, float]], id_col: str) -> DataFrame:
    """(query_id, qvec, cell, bar, away): the other cells that can hold a vector as near as a query's k-th best so far.

    By the triangle inequality no vector of a cell is nearer than the distance to its centre less the cell's radius, nor than the
    centre's least distance less that to the centre; cells beyond the ``bar`` (a cosine) of bars(query_id, bar) are left out.
    """
    shared = placed.sparkSession.sparkContext.broadcast((centres, _edges(len(centres), radii)))
    rows = placed.select(F.col(id_col).alias("query_id"), F.col("vec").alias("qvec"), "cell").join(bars, "query_id", "left")
    kind = rows.schema["qvec"].dataType.simpleString()
    step = max(1, ASK_ROWS // len(centres))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                bar = batch.column("bar").fill_null(-1.0).to_numpy(zero_copy_only=False)
                wanted, away = _open_cells(batch.column("qvec"), bar, batch.column("cell").to_numpy(), *shared.value)
                at, cell = np.nonzero(wanted)
                taken = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(taken), batch.column("qvec").take(taken), pa.array(cell, pa.int32()), pa.array(bar[at]), pa.array(away[at, cell])],
                    ["query_id", "qvec", "cell", "bar", "away"],
                )

    return rows.mapInArrow(ask, f"query_id {dict(placed.dtypes)[id_col]}, qvec {kind}, cell int, bar double, away double")


def _split_cells(rows: DataFrame, id_col: str, block_rows: int, part: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of a part of their cell, at most about ``block_rows`` each, and (cell, parts)."""
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(f"{part}s"))
    return rows.join(F.broadcast(parts), "cell").withColumn(part, F.pmod(F.xxhash64(id_col), F.col(f"{part}s")).cast("int")).drop(f"{part}s"), parts


def _cell_hits(asks: DataFrame, placed: DataFrame, id_col: str, k: int, schema: str, not_self: bool, block_rows: int) -> DataFrame:
    """(query_id, id, cosine): the best ``k`` of each block for the queries that ask its cell, no worse than their bars; both sides of a large cell are split."""
    right, parts = _split_cells(placed.select(id_col, "vec", "cell", "away"), id_col, block_rows, "_part")
    left, asked = _split_cells(asks.select("query_id", "qvec", "cell", "bar", F.col("away").alias("_far")), "query_id", block_rows, "_ask")
    left = left.join(F.broadcast(parts), "cell").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    right = right.join(F.broadcast(asked), "cell").withColumn("_ask", F.explode(F.sequence(F.lit(0), F.col("_asks") - 1))).drop("_asks")
    left = left.select(*(F.col(c).alias(c) for c in left.columns))  # both sides may come from one table
    names = ["query_id", id_col, "cosine"]

    def product(lt: pa.Table, rt: pa.Table) -> pa.Table:
        if not lt.num_rows or not rt.num_rows:
            return pa.table([lt["query_id"].slice(0, 0), rt[id_col].slice(0, 0), pa.array([], pa.float64())], names=names)
        order = np.argsort(rt["away"].to_numpy(), kind="stable")
        rt = rt.take(pa.array(order))
        cid, cm, away = rt[id_col].to_numpy(), _matrix(rt["vec"]), rt["away"].to_numpy()
        qid, qm, bar, far = lt["query_id"].to_numpy(), _matrix(lt["qvec"]), lt["bar"].to_numpy(), lt["_far"].to_numpy()
        reach = np.sqrt(np.maximum(2 - 2 * (bar - SLACK), 0)) + 1e-9
        first, last = np.searchsorted(away, far - reach), np.searchsorted(away, far + reach, "right")
        out = []
        tile = max(1, TILE_CELLS // max(1, len(cid)))
        for start in range(0, len(qid), tile):
            end = min(start + tile, len(qid))
            a, b = int(first[start:end].min()), int(last[start:end].max())
            if a >= b:
                continue
            sims = np.round(qm[start:end] @ cm[a:b].T, 6)
            tie = _order_of(cid[a:b])
            for i, row in enumerate(sims, start):
                if not_self:
                    row = np.where(cid[a:b] == qid[i], -np.inf, row)
                row = np.where(row >= bar[i], row, -np.inf)
                top = _top_k(row, tie, k)
                top = top[np.isfinite(row[top])]
                out.append((np.repeat(i, len(top)), a + top, row[top]))
        q, c, v = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table([pa.array(qid[q], lt["query_id"].type), pa.array(cid[c], rt[id_col].type), pa.array(v)], names=names)

    keys = ["cell", "_part", "_ask"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(product, schema)


def metric_top_k(vectors: DataFrame, k: int, id_col: str = "chunk_id", vec_col: str = "vector", not_self: bool = True, cells: int | None = None, block_rows: int = BLOCK_ROWS, visit_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """Exact top ``k`` by cosine of every vector against all: query_id, id, distance, similarity, rank.

    Vectors are dealt to cells. Each is first compared within its own, which gives it a k-th best; then it
    visits only the cells that the triangle inequality does not rule out. For that the cells travel to the queries, ``visit_bytes`` of
    vectors at a time. A cell of any size is split.
    """
    placed, centres = metric_cells(vectors, id_col, vec_col, cells)
    schema = _types(vectors, id_col, vectors, id_col)
    home = placed.select(F.col(id_col).alias("query_id"), F.col("vec").alias("qvec"), "cell", F.lit(-2.0).alias("bar"), "away")
    own = cut_lineage(_cell_hits(home, placed, id_col, k, schema, not_self, block_rows))
    kth = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), id_col)
    bars = own.withColumn("_r", F.row_number().over(kth)).filter(F.col("_r") <= k).groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("cosine")).otherwise(F.lit(-1.0)).alias("bar")
    )
    radii = {r.cell: (r.near, r.far) for r in placed.groupBy("cell").agg(F.min("away").alias("near"), F.max("away").alias("far")).collect()}
    if len(radii) < 2:
        return _ranked(own, id_col, k)
    asked = cut_lineage(placed.select(F.col(id_col).alias("query_id"), F.col("vec").alias("qvec"), "cell").join(bars, "query_id", "left"))
    found = own
    for cells_, part, parts in _slices(placed, visit_bytes):
        among = placed.filter(F.col("cell").between(cells_[0], cells_[1]) & (F.pmod(F.xxhash64(id_col), F.lit(parts)) == part))
        found = found.unionByName(_visits(asked, among.select(id_col, "vec", "cell"), cells_[0], centres, _edges(len(centres), radii), id_col, k, schema, not_self))
    return _ranked(found, id_col, k)


def _slices(placed: DataFrame, most: int) -> list[tuple[tuple[int, int], int, int]]:
    """((first cell, last cell), part, parts): the placed vectors in slices of about ``most`` bytes of float64; a larger cell is cut by the hash of the id."""
    sizes = placed.groupBy("cell").agg((F.count("*") * F.max(F.size("vec")) * 8).alias("n")).orderBy("cell").collect()
    out: list[tuple[tuple[int, int], int, int]] = []
    held = 0
    for row in sizes:
        parts = max(1, -(-row.n // most))
        if parts == 1 and out and out[-1][2] == 1 and held + row.n <= most:
            out[-1] = ((out[-1][0][0], row.cell), 0, 1)
            held += row.n
        else:
            out += [((row.cell, row.cell), p, parts) for p in range(parts)]
            held = row.n
    return out


def _visits(asked: DataFrame, among: DataFrame, first: int, centres: np.ndarray, edges: np.ndarray, id_col: str, k: int, schema: str, not_self: bool) -> DataFrame:
    """(query_id, id, cosine): the best ``k`` of one slice of cells for the queries it is open to, no worse than their bars, written.

    The slice travels to the tasks, the queries stay where they are: no vector is written again for a cell that it visits.
    """
    rows = among.toArrow()
    if not rows.num_rows:
        return asked.sparkSession.createDataFrame([], schema)
    rows = rows.take(pa.array(np.argsort(rows["cell"].to_numpy(), kind="stable")))
    cell = rows["cell"].to_numpy()
    last = int(cell[-1]) + 1
    edge = np.searchsorted(cell, np.arange(first, last + 1))
    shared = asked.sparkSession.sparkContext.broadcast((rows[id_col].to_numpy(), _matrix(rows["vec"]), edge, centres[first:last], edges[first:last]))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, cm, starts, middle, between = shared.value
        step = max(1, TILE_CELLS // 4 // len(middle))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                if not batch.num_rows:
                    continue
                home = batch.column("cell").to_numpy().astype(np.int64) - first
                bar = batch.column("bar").fill_null(-1.0).to_numpy(zero_copy_only=False)
                wanted, away = _open_cells(batch.column("qvec"), bar, np.where(home < 0, len(middle), home), middle, between)
                qid, qm = batch.column("query_id").to_numpy(zero_copy_only=False), _matrix(pa.chunked_array([batch.column("qvec")]))
                best = _Best(k, bar.copy())
                for c in np.argsort(np.where(wanted, away, 9).sum(axis=0)).tolist():
                    rows_ = np.flatnonzero(wanted[:, c])
                    a, b = starts[c], starts[c + 1]
                    if len(rows_) and b > a:
                        q, j, s = _block_best(qid[rows_], qm[rows_], cid[a:b], cm[a:b], k, not_self, best.bar[rows_])
                        best.add(rows_[q], cid[a + j], s)
                if best.ids is not None:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("query_id").take(pa.array(best.query)), pa.array(best.ids, id_type), pa.array(best.sims)], ["query_id", id_col, "cosine"]
                    )

    id_type = rows[id_col].type
    found = cut_lineage(asked.mapInArrow(visit, schema))
    shared.unpersist()
    return found


def semantic_links(vectors: DataFrame, n: int = 5, threshold: float = 0.3, id_col: str = "chunk_id", vec_col: str = "vector", cells: int | None = None) -> DataFrame:
    """Up to ``n`` other chunks per chunk with similarity of at least ``threshold``."""
    hits = metric_top_k(vectors, n, id_col, vec_col, True, cells)
    return hits.filter(F.col("similarity") >= threshold).select(
        F.col("query_id").alias("source"), F.col(id_col).alias("target"), "similarity", "rank"
    )


def ann_cells(n: int) -> int:
    """Number of cells for n vectors: about their root, ten vectors a cell at least, 512 at most."""
    return max(1, min(512, int(n**0.5), n // 10))


def ann_index(vectors: DataFrame, cells: int | None = None, id_col: str = "chunk_id", vec_col: str = "vector", seed: int = 7, rows_per_cell: int | None = 512) -> tuple[DataFrame, DataFrame]:
    """(assigned, centroids): every vector with its cell, and the cell centres.

    Only the centres are trained on a share of the rows, about ``rows_per_cell`` for each
    cell (None: all rows); the assignment covers all of them. ``quantised`` makes a stored index of both.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    cells = ann_cells(n) if cells is None else cells
    base = vectors.select(id_col, vec_col, _unit(F.col(vec_col)).alias("_u")).withColumn("_f", array_to_vector("_u"))
    if cells <= 1:
        assigned = vectors.select(id_col, vec_col, F.lit(0).alias("cell"))
        centre = vectors.select(F.lit(0).alias("cell"), _unit(F.col(vec_col)).alias("centroid")).limit(1)
        return assigned, centre
    share = 1.0 if rows_per_cell is None else min(1.0, cells * rows_per_cell / n)
    train = base.sample(fraction=share, seed=seed) if share < 1.0 else base
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="_f", predictionCol="cell").fit(train)
    assigned = model.transform(base).select(id_col, vec_col, "cell")
    centres = vectors.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centroid array<double>"
    )
    return assigned, centres


def ann_assign(vectors: DataFrame, centroids: DataFrame, id_col: str = "chunk_id", vec_col: str = "vector") -> DataFrame:
    """(id, vec, cell) by given centres: the cell of the highest cosine, of equal ones the first."""
    near = knn_exact(centroids, vectors, 1, "cell", "centroid", id_col, vec_col).select(F.col("query_id").alias(id_col), "cell")
    return vectors.select(id_col, vec_col).join(near, id_col)


@dataclass(frozen=True)
class QuantisedIndex:
    """codes(id, cell, code): one signed byte a dimension; cells(cell, centroid, scale); vectors(id, vec) for the last step."""

    codes: DataFrame
    cells: DataFrame
    vectors: DataFrame
    id_col: str
    vec_col: str

    def write(self, path: str) -> None:
        """Codes in a folder per cell, so that a search reads only the cells it probes."""
        self.codes.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")

    @staticmethod
    def read(spark: SparkSession, path: str, id_col: str = "chunk_id", vec_col: str = "vector") -> "QuantisedIndex":
        return QuantisedIndex(*(spark.read.parquet(f"{path}/{part}") for part in ("codes", "cells", "vectors")), id_col, vec_col)


def quantised(assigned: DataFrame, centroids: DataFrame, id_col: str = "chunk_id", vec_col: str = "vector") -> QuantisedIndex:
    """Codes of ``assigned`` vectors: what is left of the unit vector beside its centre, in 127 steps either way of the cell's largest part."""
    centres = centroids.select("cell", F.col("centroid").cast("array<double>").alias("centroid"))
    left = assigned.select(id_col, "cell", _unit(F.col(vec_col)).alias("_u")).join(F.broadcast(centres), "cell").select(
        id_col, "cell", F.zip_with("_u", "centroid", lambda x, c: x - c).alias("_left")
    )
    largest = left.groupBy("cell").agg(F.max(F.array_max(F.transform("_left", lambda x: F.abs(x)))).alias("_most"))
    cells = centres.join(largest, "cell", "left").select("cell", "centroid", (F.coalesce("_most", F.lit(0.0)) / 127).alias("scale"))
    steps = F.transform("_left", lambda x: F.when(F.col("scale") == 0, F.lit(0)).otherwise(F.round(x / F.col("scale"))).cast("tinyint"))
    codes = left.join(F.broadcast(cells.select("cell", "scale")), "cell").select(id_col, "cell", steps.alias("code"))
    return QuantisedIndex(codes, cells, assigned.select(id_col, vec_col), id_col, vec_col)


def quantised_search(index: QuantisedIndex, queries: DataFrame, k: int = 10, nprobe: int = 20, refine: int = 5, query_id: str = "query_id", query_vec: str = "vector", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top ``k`` of the ``nprobe`` nearest cells: their codes are scanned, and the best ``refine`` times k of each query are scored by their vectors.

    Queries join the codes by cell, so that of codes stored by cell only the probed ones are read; no cell or group of queries is held whole
    beyond ``block_rows`` a side.
    """
    id_col, vec_col = index.id_col, index.vec_col
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("qvec"))
    probes = knn_exact(index.cells, asked, nprobe, "cell", "centroid", "query_id", "qvec").select("query_id", "cell")
    probes = cut_lineage(asked.join(probes, "query_id"))
    wanted = probes.select("cell").distinct()
    right, parts = _split_cells(index.codes.join(F.broadcast(wanted), "cell"), id_col, block_rows, "_part")
    left, asks = _split_cells(probes.select("query_id", "qvec", "cell"), "query_id", block_rows, "_ask")
    left = left.join(F.broadcast(parts), "cell").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    left = left.join(F.broadcast(index.cells), "cell")
    right = right.join(F.broadcast(asks), "cell").withColumn("_ask", F.explode(F.sequence(F.lit(0), F.col("_asks") - 1))).drop("_asks")
    names = ["query_id", id_col, "cosine"]

    def scan(lt: pa.Table, rt: pa.Table) -> pa.Table:
        if not lt.num_rows or not rt.num_rows:
            return pa.table([lt["query_id"].slice(0, 0), rt[id_col].slice(0, 0), pa.array([], pa.float64())], names=names)
        centre = np.array(lt["centroid"][0].as_py(), np.float32)
        code = rt["code"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rt.num_rows, -1).astype(np.float32)
        near = centre + code * np.float32(lt["scale"][0].as_py())
        q, c, v = _block_product(lt["query_id"].to_numpy(), _matrix(lt["qvec"]).astype(np.float32), rt[id_col].to_numpy(), near, k * refine, False)
        return pa.table([pa.array(q, lt["query_id"].type), pa.array(c, rt[id_col].type), pa.array(v.astype(np.float64))], names=names)

    keys = ["cell", "_part", "_ask"]
    schema = f"query_id {dict(asked.dtypes)['query_id']}, {id_col} {dict(index.codes.dtypes)[id_col]}, cosine double"
    rough = _ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, schema), id_col, k * refine)
    pairs = rough.select("query_id", id_col).join(index.vectors.select(id_col, _unit(F.col(vec_col)).alias("_u")), id_col).join(asked.select("query_id", _unit(F.col("qvec")).alias("_q")), "query_id")
    cosine = F.round(F.aggregate(F.zip_with("_u", "_q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 6)
    return _ranked(pairs.select("query_id", id_col, cosine.alias("cosine")), id_col, k)


def _unit(vec: Column) -> Column:
    dbl = vec.cast("array<double>")
    norm = F.sqrt(F.aggregate(dbl, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(dbl, lambda x: F.when(norm == 0, 0.0).otherwise(x / norm))


def ann_search(assigned: DataFrame, centroids: DataFrame, queries: DataFrame, k: int = 10, nprobe: int = 20, id_col: str = "chunk_id", vec_col: str = "vector", query_id: str = "query_id", query_vec: str = "vector", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top-k among the ``nprobe`` cells nearest each query, scored exactly.

    Queries meet only the vectors of their cells. A cell larger than a block, of vectors
    or of queries, is split by id hash on that side and the other side repeated per
    part, so a cell holding a third of all vectors or queries is still many equal tasks.
    """
    probes = cut_lineage(knn_exact(centroids, queries, nprobe, "cell", "centroid", query_id, query_vec).select("query_id", "cell"))
    held, sought = (_block_size(df.count(), block_rows) for df in (assigned, probes))
    parts = (
        assigned.groupBy("cell").agg(F.count("*").alias("_n"))
        .select("cell", F.ceil(F.col("_n") / held).cast("int").alias("_parts"))
    )
    asked = probes.groupBy("cell").agg(F.ceil(F.count("*") / sought).cast("int").alias("_asks"))
    right = assigned.join(F.broadcast(parts), "cell").select(
        id_col, F.col(vec_col).alias("vec"), "cell", F.pmod(F.xxhash64(id_col), F.col("_parts")).cast("int").alias("_part")
    )
    left = (
        queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("qvec"))
        .join(probes, "query_id").join(F.broadcast(parts), "cell").join(F.broadcast(asked), "cell")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .select("query_id", "qvec", "cell", "_part", F.pmod(F.xxhash64("query_id"), F.col("_asks")).cast("int").alias("_ask"))
    )
    right = right.join(F.broadcast(asked), "cell").withColumn("_ask", F.explode(F.sequence(F.lit(0), F.col("_asks") - 1))).drop("_asks")
    schema = _types(queries, query_id, assigned, id_col)
    return _ranked(_pairwise(left, right, ["cell", "_part", "_ask"], id_col, k, schema, False), id_col, k)


def get_vectors(vectors: DataFrame, ids: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Vectors of the asked ids; ids without one are absent."""
    return vectors.join(ids.select(id_col).distinct(), id_col, "left_semi")


def dimension_check(vectors: DataFrame, expected: int, vec_col: str = "vector") -> DataFrame:
    """Rows per stored dimension with a flag whether it equals the expected one."""
    return (
        vectors.groupBy(F.size(vec_col).alias("dimension")).agg(F.count("*").alias("vectors"))
        .withColumn("matches", F.col("dimension") == expected)
    )


def assert_dimension(vectors: DataFrame, expected: int, vec_col: str = "vector") -> None:
    bad = dimension_check(vectors, expected, vec_col).filter(~F.col("matches")).take(1)
    if bad:
        raise ValueError(f"stored dimension {bad[0]['dimension']} differs from {expected}")


def hash_vectors(df: DataFrame, id_col: str, text: str, dim: int = 64) -> DataFrame:
    """Default embedding: unit-length token counts in ``dim`` md5 buckets; ``id_col`` must be unique, rows without tokens get none.

    Each row is counted by itself, as in ``token_rows``.
    """
    lists = tx.token_lists(df, id_col, text)
    characters = tx.word_characters(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, terms, term, tf in tx.counted(batches, characters):
            bucket = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim for t in terms.to_pylist()], np.int64)
            held = np.unique(row)
            weights = np.bincount(row * dim + bucket[term], tf, len(ids) * dim).reshape(-1, dim)[held]
            unit = weights / np.sqrt((weights * weights).sum(axis=1, keepdims=True))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * dim, pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(held)), vectors], [id_col, "vector"])

    return lists.mapInArrow(run, f"`{id_col}` {dict(lists.dtypes)[id_col]}, vector array<double>")


Embedder = Callable[[list[str]], np.ndarray]


def embed_chunks(df: DataFrame, embedder: Embedder, dim: int, text: str = "content", out: str = "vector") -> DataFrame:
    """Vectors from a user function over batches of texts (Arrow), with a dimension check."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            m = np.asarray(embedder(s.fillna("").tolist()), dtype=np.float32).reshape(len(s), -1)
            if len(s) and m.shape[1] != dim:
                raise ValueError(f"embedder gave {m.shape[1]} values, expected {dim}")
            yield pd.Series(list(m))

    return df.withColumn(out, run(F.col(text)))


def content_key(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def split_by_cache(df: DataFrame, cache: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(hits with their vector, distinct texts still to embed) by content hash."""
    keyed = df.withColumn("cache_key", content_key(F.col(text)))
    hits = keyed.join(cache, "cache_key")
    misses = keyed.join(cache.select("cache_key"), "cache_key", "left_anti").groupBy("cache_key").agg(F.min(text).alias(text))
    return hits, misses


def embedding_cache(df: DataFrame, cache: DataFrame, embedder: Embedder, dim: int, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(rows with vectors, new cache rows): copies of one text are embedded once."""
    keyed = df.withColumn("cache_key", content_key(F.col(text)))
    _, misses = split_by_cache(df, cache, text)
    fresh = cut_lineage(embed_chunks(misses, embedder, dim, text).select("cache_key", "vector"))
    return keyed.join(cache.unionByName(fresh), "cache_key"), fresh


def mmr(candidates: DataFrame, diversity: float = 0.5, k: int = 10, score: str = "score", rank: str = "rank", vec_col: str = "vector", id_col: str = "chunk_id") -> DataFrame:
    """Greedy diversity ranking per query over an already cut candidate list.

    Each step takes the highest λ·score − (1 − λ)·(closest chosen), λ = 1 − diversity,
    earlier candidates winning ties. A group holds one query's candidates (a few
    times k), so grouping by query is bounded.
    """
    lam = 1.0 - diversity
    types = dict(candidates.dtypes)
    schema = f"query_id {types['query_id']}, {id_col} {types[id_col]}, {score} double, mmr_rank int"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank, kind="stable").reset_index(drop=True)
        m = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
        m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-10)
        rel = pdf[score].to_numpy(dtype=np.float64)
        closest = np.zeros(len(pdf))
        open_ = np.ones(len(pdf), dtype=bool)
        chosen: list[int] = []
        for step in range(min(k, len(pdf))):
            value = np.where(open_, lam * rel - (1.0 - lam) * closest, -np.inf)
            best = int(np.argmax(value))
            chosen.append(best)
            open_[best] = False
            sims = m @ m[best]
            closest = sims if step == 0 else np.maximum(closest, sims)
        out = pdf.loc[chosen, ["query_id", id_col, score]].copy()
        out["mmr_rank"] = np.arange(1, len(chosen) + 1, dtype=np.int32)
        return out

    cols = ["query_id", id_col, F.col(score).cast("double").alias(score), rank, vec_col]
    return candidates.select(*cols).groupBy("query_id").applyInPandas(pick, schema)


Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def overlap_score(query: Column, document: Column) -> Column:
    """Default pair score: share of query words in the document, as a logit-like value in -3…3."""
    asked = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""))
    share = F.size(F.array_intersect(asked, F.split(F.lower(document), r"\s+"))) / F.size(asked)
    return 6.0 * F.when(F.size(asked) > 0, share).otherwise(0.0) - 3.0


def pair_rerank(hits: DataFrame, limit: int = 10, scorer: Scorer | None = None, query: str = "query_text", document: str = "content", id_col: str = "chunk_id") -> DataFrame:
    """Score (query, document) pairs of a hit list, squash to 0–1, keep the top 3·limit per query."""
    raw = overlap_score(F.col(query), F.col(document)) if scorer is None else _scorer_udf(scorer)(F.col(query), F.col(document))
    out = hits.withColumn("score", F.round(1 / (1 + F.exp(-raw)), 6))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_col)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 3 * limit)


def _scorer_udf(scorer: Scorer):
    @F.pandas_udf("double")
    def run(query: pd.Series, document: pd.Series) -> pd.Series:
        return scorer(query, document)

    return run


def code_vector_enrich(hits: DataFrame, second: DataFrame, threshold: float = 0.75, boost: float = 0.15, id_col: str = "chunk_id") -> DataFrame:
    """Raise hits that also reach ``threshold`` in a second vector table; adds no new ones."""
    strong = second.filter(F.col("similarity") >= threshold).select("query_id", id_col, F.lit(True).alias("_hit"))
    score = F.when(F.col("_hit"), F.least(F.lit(1.0), F.col("similarity") + boost)).otherwise(F.col("similarity"))
    return hits.join(strong, ["query_id", id_col], "left").withColumn("score", F.round(score, 7)).drop("_hit")
