"""Contiguous shards of nearly equal bytes, by prefix sums over partition totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.runtime import cut_lineage

#: Bytes that a document takes besides its text.
OVERHEAD = 16
_LOW = (1 << 33) - 1


def shard_by_bytes(rows: DataFrame, shards: int, size: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in its shard), cut where the running bytes pass equal targets.

    Rows are dealt by ranges of ``order`` and written once, with their place within
    their partition. One total per partition gives the bytes before it, a running sum
    within it the bytes before each row, and a row belongs to the shard whose target
    holds its middle byte: shards are contiguous and differ from the target by
    no more than their outer rows. Only ids, places and sizes are summed; the rows come
    back through a table of one piece per partition and shard, broadcast as it has at most
    partitions + shards rows. Nulls come first, rows that agree in ``order`` are dealt by their place in the
    input, a size that is null or negative counts as nothing, and if all sizes are nothing, all rows are in shard 0.
    Columns named shard or slot are replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    taken = rows.drop("shard", "slot").withColumn("_at", F.monotonically_increasing_id())
    dealt = taken.repartitionByRange(*order, "_at").sortWithinPartitions(*order, "_at").drop("_at")
    laid = cut_lineage(dealt.withColumn("_place", F.monotonically_increasing_id()))
    pid, bytes_ = F.shiftright("_place", 33), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    narrow = laid.select(pid.alias("_pid"), F.col("_place").bitwiseAND(F.lit(_LOW)).alias("_nth"), bytes_.alias("_size"))
    totals = narrow.groupBy("_pid").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "_pid",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(all_rows).alias("_all"),
    )
    within = Window.partitionBy("_pid").orderBy("_nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = narrow.withColumn("_end", F.sum("_size").over(within)).join(F.broadcast(starts), "_pid")
    middle = 2 * (F.col("_bytes_before") + F.col("_end")) - F.col("_size")
    share = (middle.cast("decimal(38,0)") * shards / F.greatest(2 * F.col("_all"), F.lit(1))).cast("long")
    placed = placed.withColumn("shard", F.least(share, F.lit(shards - 1)).cast("int"))
    pieces = placed.groupBy("_pid", "shard").agg(F.min("_nth").alias("_from"), F.max("_nth").alias("_to"), F.min("_rows_before").alias("_rows_before"))
    first = Window.partitionBy("shard")
    pieces = pieces.select("_pid", "shard", "_from", "_to", (F.col("_rows_before") - F.min(F.col("_rows_before") + F.col("_from")).over(first)).alias("_shift"))
    nth = F.col("_place").bitwiseAND(F.lit(_LOW))
    found = laid.withColumn("_pid", pid).join(F.broadcast(pieces), "_pid").where((nth >= F.col("_from")) & (nth <= F.col("_to")))
    return found.withColumn("slot", nth + F.col("_shift")).drop("_pid", "_place", "_from", "_to", "_shift")


def sized(docs: DataFrame, text: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text plus ``overhead``) and ``text_crc32`` (of the empty string if null)."""
    return docs.withColumn("size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).withColumn(
        "text_crc32", F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    )


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``docs`` by doc_id in contiguous shards of nearly equal bytes, with ``size``, ``text_crc32``, ``shard`` and ``slot``."""
    return shard_by_bytes(sized(docs), shards, "size", ["doc_id", "text_crc32"])
