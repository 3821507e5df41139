"""Change events: watching, debouncing, applying; incremental indexing and chunk states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators import joins
from siftwell.runtime import cut_lineage, running
from siftwell.sources import tables

EVENT_SCHEMA = "event_id bigint, ts timestamp, file_path string, event_type string, new_path string"


def watch_changes(spark: SparkSession, folder: str, fmt: str = "parquet", schema: str = EVENT_SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """Change events as a stream of files; a move is a deletion and a creation."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)
    return split_moves(raw)


def split_moves(events: DataFrame) -> DataFrame:
    one = lambda path, kind: F.struct(path.alias("file_path"), F.lit(kind).alias("event_type"))
    both = F.array(one(F.col("file_path"), "deleted"), one(F.col("new_path"), "created"))
    same = F.array(F.struct("file_path", "event_type"))
    return events.select("event_id", "ts", F.explode(F.when(F.col("event_type") == "moved", both).otherwise(same)).alias("e")).select("event_id", "ts", "e.*")


def debounce(events: DataFrame, gap: str = "1 second", watermark: str | None = None) -> DataFrame:
    """(file_path, session start, end, events): a file is due after a quiet gap. Works on a batch or a stream."""
    src = events.withWatermark("ts", watermark) if watermark else events
    out = src.groupBy(F.session_window("ts", gap), "file_path").agg(F.count("*").alias("events"))
    return out.select("file_path", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def debounce_batch(events: DataFrame, gap_seconds: float) -> DataFrame:
    """The same sessions for a batch table where one file may hold very many events.

    A session opens when the gap to the latest earlier event is longer than the quiet time. Both running steps are
    split over range partitions, and sessions are closed by a partial aggregate.
    """
    sec = F.col("ts").cast("double")
    base = events.select("file_path", "event_id", sec.alias("_t"))
    seen = running(base, ["file_path"], ["_t", "event_id"], F.col("_t"), "max", "_prev", inclusive=False)
    opens = F.when(F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") > gap_seconds), 1).otherwise(0)
    numbered = running(seen, ["file_path"], ["_t", "event_id"], opens, "sum", "_s")
    return numbered.groupBy("file_path", "_s").agg(F.min("_t").alias("start"), F.max("_t").alias("last"), F.count("*").alias("events")).drop("_s")


def latest_changes(events: DataFrame) -> DataFrame:
    """(file_path, ts, event_id, event_type): the last event of every file (partial max)."""
    return events.groupBy("file_path").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e")).select("file_path", "e.*")


def apply_changes(chunks: DataFrame, events: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunk table after a batch of events: touched files leave, living ones come back from ``fresh``."""
    last = latest_changes(events)
    alive = last.filter(F.col("event_type") != "deleted").select("file_path")
    kept = chunks.join(last.select("file_path"), "file_path", "left_anti")
    return kept.unionByName(fresh.join(alive, "file_path", "left_semi").select(*kept.columns))


def due_changes(events: DataFrame, gap_seconds: float, watermark: str, keep_applied: str | None = None) -> DataFrame:
    """(file_path, event_type, start, last, event_id, events) of a stream of events: a file's last change, once it has been quiet for ``gap_seconds``.

    Each file has its open run of events in state and a timer at its last one plus the gap; when the watermark passes the timer the
    change goes out, and its time and id stay behind, for deletions too, so that an event that comes late opens nothing. ``keep_applied``
    (an interval such as "7 days") forgets them some time after. Times in state are microseconds.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    ttl = None if keep_applied is None else int(_seconds(events.sparkSession, keep_applied) * 1000)
    gap = int(gap_seconds * 1_000_000)

    class Quiet(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.run = handle.getValueState("run", "start bigint, last bigint, event_id bigint, event_type string, events bigint, timer bigint")
            self.applied = handle.getValueState("applied", "last bigint, event_id bigint", **({} if ttl is None else {"ttlDurationMs": ttl}))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            applied = tuple(self.applied.get()) if self.applied.exists() else None
            run = tuple(self.run.get()) if self.run.exists() else None
            for at, event_id, event_type in sorted((r.at, r.event_id, r.event_type) for r in rows):
                if applied is not None and (at, event_id) <= applied:
                    continue
                if run is not None and at - run[1] > gap:
                    applied = run[1:3]
                    yield _due(key[0], run)
                    if run[5]:
                        self.handle.deleteTimer(run[5])
                    run = None
                if run is None:
                    run = (at, at, event_id, event_type, 1, 0)
                elif (at, event_id) >= run[1:3]:
                    run = (run[0], at, event_id, event_type, run[4] + 1, run[5])
                else:
                    run = (min(run[0], at), *run[1:4], run[4] + 1, run[5])
            if applied is not None:
                self.applied.update(applied)
            if run is not None:
                due = (run[1] + gap) // 1000 + 1
                if run[5] != due:
                    if run[5]:
                        self.handle.deleteTimer(run[5])
                    self.handle.registerTimer(due)
                self.run.update((*run[:5], due))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            if self.run.exists():
                run = tuple(self.run.get())
                self.run.clear()
                self.applied.update(run[1:3])
                yield _due(key[0], run)

        def close(self) -> None:
            pass

    timed = events.withWatermark("ts", watermark).withColumn("at", F.unix_micros("ts"))
    due = timed.groupBy("file_path").transformWithState(Quiet(), "file_path string, event_type string, start bigint, last bigint, event_id bigint, events bigint", "Append", "EventTime")
    return due.select("file_path", "event_type", F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), "event_id", "events")


def _due(file_path: str, run: tuple) -> Row:
    return Row(file_path=file_path, event_type=run[3], start=run[0], last=run[1], event_id=run[2], events=run[4])


def _seconds(spark: SparkSession, interval: str) -> float:
    return float(spark.sql(f"SELECT cast(make_timestamp(2000, 1, 1, 0, 0, 0) + INTERVAL {interval} AS double) - cast(make_timestamp(2000, 1, 1, 0, 0, 0) AS double)").first()[0])


def due_batch(events: DataFrame, gap_seconds: float) -> DataFrame:
    """The rows of ``due_changes`` for a finished table of events."""
    base = events.select("file_path", "event_id", "ts", "event_type", F.col("ts").cast("double").alias("_t"))
    seen = running(base, ["file_path"], ["_t", "event_id"], F.col("_t"), "max", "_prev", inclusive=False)
    opens = F.when(F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") > gap_seconds), 1).otherwise(0)
    numbered = running(seen, ["file_path"], ["_t", "event_id"], opens, "sum", "_s")
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("e")
    out = numbered.groupBy("file_path", "_s").agg(F.min("ts").alias("start"), last, F.count("*").alias("events"))
    return out.select("file_path", "e.event_type", "start", F.col("e.ts").alias("last"), "e.event_id", "events")


def stream_changes(events: DataFrame, root: str, fresh: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Apply every micro-batch of events to the chunk table at ``root`` (keyed by file_path, see ``tables.write_keyed``).

    ``fresh`` turns the changed paths into newly cut chunks. The last event applied to
    each file, deletions too, is kept in a keyed table beside it, so that an event that comes late
    changes nothing. Only the folders of the changed files are read and written; a replayed batch gives the same table again.
    """
    applied = f"{root}-applied"

    def one_batch(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        last = latest_changes(batch)
        known = tables.has_table(spark, applied)
        if known:
            before = tables.read_keyed(spark, applied).select("file_path", F.struct("ts", "event_id").alias("_before"))
            last = last.join(before, "file_path", "left").filter(F.col("_before").isNull() | (F.struct("ts", "event_id") >= F.col("_before"))).drop("_before")
        last = cut_lineage(last)
        alive = last.filter(F.col("event_type") != "deleted").select("file_path")
        cut = fresh(alive)
        tables.upsert_keyed(cut, root, "file_path", gone=last)
        if known:
            tables.upsert_keyed(last, applied, "file_path")
        else:
            tables.write_keyed(last, applied, "file_path")

    return events.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_index(old_chunks: DataFrame, indexed: DataFrame, current: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chunk table of the current files: unchanged files keep their rows, moved ones get the new path, the rest is cut again.

    ``indexed`` and ``current`` hold file_path and file_hash; ``current`` also the text that ``cut`` needs.
    """
    moves = joins.detect_file_moves(current, indexed)
    moved = old_chunks.join(moves.select(F.col("old_path").alias("file_path"), F.col("new_path").alias("_new")), "file_path").withColumn(
        "file_path", F.col("_new")
    ).select(*old_chunks.columns)
    changes = joins.changed_files(current, indexed)
    same = old_chunks.join(changes.filter("change = 'same'").select("file_path"), "file_path", "left_semi")
    due = changes.filter("change IN ('new', 'changed')").select("file_path").join(moves.select(F.col("new_path").alias("file_path")), "file_path", "left_anti")
    fresh = cut(current.join(due, "file_path", "left_semi"))
    return same.unionByName(moved).unionByName(fresh.select(*old_chunks.columns))


def _set(chunks: DataFrame, due: Column, values: dict[str, Column]) -> DataFrame:
    """Set several columns where ``due`` holds, all judged on the row as it was."""
    return chunks.withColumns({c: F.when(due, v).otherwise(F.col(c)) for c, v in values.items()})


def claim_batch(chunks: DataFrame, batch: DataFrame, batch_id: int, now: Column) -> DataFrame:
    """Mark the pending chunks of a batch as processing."""
    hit = chunks.join(batch.select("chunk_id").distinct().withColumn("_hit", F.lit(True)), "chunk_id", "left")
    due = F.coalesce("_hit", F.lit(False)) & (F.col("embedding_status") == "pending")
    return _set(hit, due, {"batch_id": F.lit(batch_id), "updated_at": now, "embedding_status": F.lit("processing")}).drop("_hit")


def finish_batch(chunks: DataFrame, batch_id: int, now: Column, ok: bool = True) -> DataFrame:
    """Close the processing chunks of a batch."""
    due = (F.col("batch_id") == batch_id) & (F.col("embedding_status") == "processing")
    return _set(chunks, due, {"updated_at": now, "embedding_status": F.lit("complete" if ok else "error")})


def release_stuck(chunks: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Processing chunks not updated for some minutes become pending again."""
    stuck = (F.col("embedding_status") == "processing") & (F.col("updated_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return _set(chunks, stuck, {"batch_id": F.lit(0), "updated_at": now, "embedding_status": F.lit("pending")})


def staleness(files: DataFrame, indexed: DataFrame, as_of: Column, max_age_seconds: int = 300) -> DataFrame:
    """One row: files, indexed files, stale files, newest file, oldest index time, is_stale. Times are epoch seconds."""
    stored = indexed.select("file_path", F.col("mtime").alias("_stored"))
    joined = files.join(stored, "file_path", "left")
    stale = F.coalesce(F.col("mtime") > F.col("_stored"), F.lit(True))
    out = joined.agg(
        F.count("*").alias("total_files"), F.count_if(stale).alias("stale_files"), F.max("mtime").alias("newest_file"), F.min("_stored").alias("oldest_index")
    )
    n = indexed.agg(F.count("*")).scalar()
    age = F.coalesce(as_of - F.col("oldest_index"), F.lit(0))
    return out.withColumn("indexed_files", n).withColumn("age_seconds", age).withColumn("is_stale", age > max_age_seconds)


def phase_metrics(items: DataFrame, phase: str = "phase", count: str = "items", seconds: str = "seconds") -> DataFrame:
    """Items, seconds and items per second by phase."""
    out = items.groupBy(phase).agg(F.sum(count).alias("items"), F.sum(seconds).alias("seconds"))
    return out.withColumn("throughput", F.round(F.when(F.col("seconds") > 0, F.col("items") / F.col("seconds")).otherwise(0.0), 6))
