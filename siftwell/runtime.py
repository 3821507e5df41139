"""Session set-up and the few execution helpers every operator shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Spark removes the shuffle files of an execution when it ends.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "siftwell", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(cores))
        builder = builder.config("spark.driver.memory", "8g")
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; a scratch one only in local runs."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siftwell-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def cut_lineage(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and go on from the written table.

    Keeps loop plans short and survives lost executors. Unlike ``checkpoint()``
    the rows are computed once, not twice, and later joins know their size. Shuffle
    files of the write are given up when it ends, as nothing goes back to them. Rows that differ in ``partition_by`` lie in
    folders of their own, which can be dropped by themselves.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame, part: str | None = None) -> None:
    """Delete tables that ``cut_lineage`` wrote and that nothing will read again, or of them only the folder ``part`` (column=value)."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path
        shared = path(context.getCheckpointDir())
        for folder in {path(f).getParent() for f in df.inputFiles()}:
            if folder.toUri().getPath().startswith(f"{shared.toUri().getPath()}/cut-") and (part is None or folder.getName() == part):
                folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def number_rows(df: DataFrame, order: Sequence[Column | str], out: str = "ordinal") -> DataFrame:
    """Global 1-based row number in ``order`` without a one-task window.

    Rows are range-partitioned on the order (which must be unique, so a hot
    leading value still splits), written once, and each partition is shifted by
    the row count of those before it. Only one count per partition is windowed.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = cut_lineage(
        parts.withColumn("_mid", F.monotonically_increasing_id())
    )
    low_bits = (1 << 33) - 1
    parts = parts.withColumn("_pid", F.shiftright("_mid", 33))
    counts = parts.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = counts.select(
        F.col("_pid"),
        F.expr("coalesce(sum(_n) over (order by _pid rows between unbounded preceding and 1 preceding), 0)").alias("_before"),
    )
    return (
        parts.join(F.broadcast(before), "_pid")
        .withColumn(out, F.col("_before") + F.col("_mid").bitwiseAND(F.lit(low_bits)) + 1)
        .drop("_pid", "_mid", "_before")
    )


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, kind: str, out: str, inclusive: bool = True) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` per key in ``order``, safe for a key with very many rows.

    Rows are range-partitioned on key and order, so one key may span partitions;
    each partition runs its own window and adds the carry of the parts before it.
    Only one total per key and partition is windowed across partitions.
    """
    agg = {"sum": F.sum, "max": F.max}[kind]
    parts = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id()))
    totals = parts.groupBy(*keys, "_pid").agg(agg(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_pid", agg("_total").over(before).alias("_carry"))
    within = Window.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = parts.join(carry, [*keys, "_pid"]).withColumn("_local", agg(value).over(within))
    if kind == "sum":
        result = F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    else:
        result = F.greatest("_local", "_carry")
    return joined.withColumn(out, result).drop("_pid", "_carry", "_local")


def number_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based row number per key without sorting a whole key in one task."""
    return running(df, keys, order, F.lit(1), "sum", out)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def fixed_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A rule or lookup table whose size is fixed in the code (safe to broadcast), built in the JVM."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    items = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]
    typed = [F.col(f"r.{c.strip().split(' ')[0]}").cast(c.strip().split(" ")[1]).alias(c.strip().split(" ")[0]) for c in schema.split(",")]
    return spark.range(1, numPartitions=1).select(F.explode(F.array(*items)).alias("r")).select(*typed)
