"""Reading and writing the tables: chunks, vectors, snapshots, text files. Plain Parquet, keyed tables in folders by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftwell.runtime import cut_lineage, drop_written

REQUIRED_CHUNK_COLUMNS = ["chunk_id", "file_path", "content"]


def scan_chunks(spark: SparkSession, path: str, file_path: str | None = None, language: str | None = None) -> DataFrame:
    """Stored chunks; both filters reach the scan (language is a partition column)."""
    df = spark.read.parquet(path)
    if file_path is not None:
        df = df.filter(F.col("file_path") == file_path)
    if language is not None:
        df = df.filter(F.col("language") == language)
    return df


def load_text_files(spark: SparkSession, glob: str, encoding: str = "UTF-8") -> DataFrame:
    """(file_path, text) of whole text files, one row each; blank files are left out, bytes that are not of the ``encoding`` become replacement characters."""
    if encoding.upper() == "UTF-8":
        raw = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.make_valid_utf8("value").alias("text"))
    else:
        files = spark.read.format("binaryFile").load(glob)
        raw = files.select(F.col("path").alias("file_path"), F.decode("content", encoding).alias("text"))
    return raw.filter(F.col("text").rlike(r"\S"))


def write_chunks(df: DataFrame, path: str, file_hash: Column, now: Column, language: str = "language") -> None:
    """Append chunks as pending, with hash and times, partitioned by language."""
    missing = [c for c in REQUIRED_CHUNK_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"chunks lack {missing}")
    out = df.withColumn("file_hash", file_hash).withColumn("embedding_status", F.lit("pending"))
    out.withColumn("created_at", now).withColumn("updated_at", now).write.mode("append").partitionBy(language).parquet(path)


def upsert_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows without the new keys, plus the new rows; columns missing on a side become null."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


# Partitions of a keyed table unless asked otherwise, and the columns that lay it out.
BUCKETS = 64
_BUCKET, _COUNT, _MARK = "_bucket", "_buckets", "_mark"


def _bucketed(df: DataFrame, key: str, buckets: Column) -> DataFrame:
    return df.withColumn(_COUNT, buckets.cast("int")).withColumn(_MARK, F.lit(False)).withColumn(_BUCKET, F.pmod(F.xxhash64(F.col(key)), F.col(_COUNT)).cast("int"))


def _marks(like: DataFrame, buckets: DataFrame) -> DataFrame:
    """One row without data for each of ``buckets``, so that a bucket that loses all rows is overwritten too."""
    empty = {c: F.lit(None).cast(t) for c, t in like.dtypes if c not in (_COUNT, _MARK, _BUCKET)}
    return buckets.select(*(v.alias(c) for c, v in empty.items()), _COUNT, F.lit(True).alias(_MARK), _BUCKET)


def _written(df: DataFrame, root: str) -> None:
    """Write by bucket; a bucket that is large is dealt to several tasks, so that there may be more of them than buckets."""
    df.hint("rebalance", _BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(root)


def write_keyed(df: DataFrame, root: str, key: str, buckets: int = BUCKETS) -> None:
    """Write a table whose rows lie in folders by the hash of ``key``, so that ``upsert_keyed`` rewrites only what it touches."""
    laid = _bucketed(df, key, F.lit(buckets))
    all_ = df.sparkSession.range(buckets).select(F.lit(buckets).alias(_COUNT), F.col("id").cast("int").alias(_BUCKET))
    _written(laid.unionByName(_marks(laid, all_)), root)


def has_table(spark: SparkSession, root: str) -> bool:
    """Whether something has been written to ``root``."""
    try:
        return bool(spark.read.parquet(root).columns)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False


def read_keyed(spark: SparkSession, root: str) -> DataFrame:
    """The rows of a keyed table."""
    return spark.read.parquet(root).filter(~F.col(_MARK)).drop(_BUCKET, _COUNT, _MARK)


def upsert_keyed(new: DataFrame, root: str, key: str, gone: DataFrame | None = None) -> None:
    """Replace the rows of the keys in ``new`` and drop those of the keys in ``gone``; only the folders they fall into are read and written.

    A key's rows in ``new`` all stay. The touched folders are put together aside and then swapped in by one dynamic overwrite, so the same call
    again gives the same table. Columns missing on a side become null; columns the table does not have are left out.
    """
    spark = new.sparkSession
    stored = spark.read.parquet(root)
    count = stored.filter(_MARK).agg(F.max(_COUNT)).first()[0]
    keys = new.select(key) if gone is None else new.select(key).unionByName(gone.select(key))
    keys = cut_lineage(_bucketed(keys.distinct(), key, F.lit(count)).select(key, _COUNT, _BUCKET))
    touched = keys.select(_COUNT, _BUCKET).distinct()
    wanted = [r[0] for r in touched.select(_BUCKET).collect()]
    old = stored.filter(~F.col(_MARK) & F.col(_BUCKET).isin(wanted)).join(keys.select(key), key, "left_anti")
    fresh = _bucketed(new, key, F.lit(count))
    fresh = fresh.select(*(c if c in fresh.columns else F.lit(None).cast(t).alias(c) for c, t in stored.dtypes))
    whole = cut_lineage(old.select(*stored.columns).unionByName(fresh).unionByName(_marks(stored, touched)))
    _written(whole, root)
    drop_written(whole, keys)
    spark.catalog.refreshByPath(root)


def write_vectors(new: DataFrame, root: str, model_version: str, now: Column, key: str = "chunk_id") -> None:
    """Upsert vectors by chunk id into a keyed table, stamped with time and model."""
    stamped = new.withColumn("embedded_at", now).withColumn("model_version", F.lit(model_version))
    if has_table(new.sparkSession, root):
        upsert_keyed(stamped, root, key)
    else:
        write_keyed(stamped, root, key)


def save_snapshot(snapshot: DataFrame, path: str, day: str = "day", project: str = "project") -> None:
    """Append snapshot rows partitioned by project and day; a project's day written again replaces that only."""
    snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(project, day).parquet(path)
