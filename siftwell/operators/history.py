"""Metric snapshots over time, baselines, evolution of a commit history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions import metrics as mx
from siftwell.operators.aggregates import smell_array
from siftwell.runtime import number_rows

# Metrics where a rise is a regression.
RISING_IS_BAD = [
    "total_complexity", "avg_complexity", "max_complexity",
    "cognitive_complexity", "cyclomatic_complexity", "max_nesting_depth", "parameter_count",
]


def trend_metrics(chunk_metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot rows per key: lines, mean and max complexity, smells, complex functions, health."""
    c = F.col("cognitive_complexity")
    out = chunk_metrics.groupBy(*keys).agg(
        F.countDistinct("file_path").alias("total_files"),
        F.count("*").alias("total_chunks"),
        F.sum("lines_of_code").alias("total_lines"),
        F.coalesce(F.avg(F.when(c != 0, c)), F.lit(0.0)).alias("avg_complexity"),
        F.max("cognitive_complexity").alias("max_complexity"),
        F.sum(F.size(smell_array())).alias("total_smells"),
        F.count_if(c > 20).alias("high_complexity"),
    )
    return out.withColumn("health", mx.project_health(F.col("avg_complexity"), F.col("total_smells")))


def file_history(rows: DataFrame, n: int = 10, path: str = "file_path", ts: str = "ts") -> DataFrame:
    """The last n metric rows per file, newest first (group limit before the shuffle)."""
    w = Window.partitionBy(path).orderBy(F.col(ts).desc())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def project_history(snapshots: DataFrame, n: int = 10, project: str = "project", ts: str = "ts") -> DataFrame:
    return file_history(snapshots, n, project, ts)


def _ends(snapshots: DataFrame, project: str, ts: str, *values: str) -> DataFrame:
    row = F.struct(*values)
    return snapshots.groupBy(project).agg(
        F.count("*").alias("snapshots"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.min_by(row, ts).alias("first"),
        F.max_by(row, ts).alias("last"),
    )


def trend_change_rate(snapshots: DataFrame, as_of: Column, days: int, value: str = "avg_complexity", project: str = "project", ts: str = "ts") -> DataFrame:
    """Change per day between the first and last snapshot of the last ``days`` days; 0 within one day."""
    recent = snapshots.filter((F.col(ts) >= F.date_sub(as_of, days)) & (F.col(ts) <= as_of))
    ends = _ends(recent, project, ts, value)
    span = F.datediff("last_ts", "first_ts")
    delta = F.col(f"last.{value}") - F.col(f"first.{value}")
    rate = F.when((F.col("snapshots") >= 2) & (span > 0), delta / span).otherwise(0.0)
    return ends.select(project, "snapshots", F.round(rate, 6).alias("change_rate"))


def direction(first: Column, last: Column, count: Column, lower_is_better: bool, threshold: float = 0.05) -> Column:
    change = F.when(first == 0, F.when(last > 0, 1.0).otherwise(0.0)).otherwise(F.abs(last - first) / first)
    better = last < first if lower_is_better else last > first
    return F.when((count < 2) | (change < threshold), "stable").when(better, "improving").otherwise("worsening")


def trend_direction(snapshots: DataFrame, metrics: dict[str, bool], threshold: float = 0.05, project: str = "project", ts: str = "ts") -> DataFrame:
    """(project, metric, direction) for each metric; the flag says whether lower is better."""
    ends = _ends(snapshots, project, ts, *metrics)
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                direction(
                    F.col(f"first.{m}").cast("double"), F.col(f"last.{m}").cast("double"), F.col("snapshots"), lower, threshold
                ).alias("direction"),
            )
            for m, lower in metrics.items()
        ]
    )
    return ends.select(project, F.explode(rows).alias("r")).select(project, "r.*")


def regression_alerts(snapshots: DataFrame, threshold: float = 5.0, project: str = "project", ts: str = "ts") -> DataFrame:
    """Metrics whose change from first to last snapshot passes the threshold, as regression or improvement."""
    metrics = {"avg_complexity": 1, "total_smells": 1, "health": -1}
    ends = _ends(snapshots, project, ts, *metrics).filter(F.col("snapshots") >= 2)
    rows = []
    for m, bad_sign in metrics.items():
        old, new = F.col(f"first.{m}").cast("double"), F.col(f"last.{m}").cast("double")
        change = F.when(old == 0, F.when(new > 0, 100.0).otherwise(0.0)).otherwise((new - old) / old * 100)
        skip = F.lit(True) if m != "health" else old > 0
        kind = (
            F.when(skip & (change * bad_sign > threshold), "regression").when(skip & (change * bad_sign < -threshold), "improvement")
        )
        rows.append(
            F.struct(
                F.lit(m).alias("metric"), old.alias("old_value"), new.alias("new_value"),
                F.round(change, 4).alias("change_percent"), kind.alias("kind"),
            )
        )
    return ends.select(project, F.explode(F.array(*rows)).alias("r")).select(project, "r.*").filter(F.col("kind").isNotNull())


BASELINE_METRICS = ["total_complexity", "avg_complexity", "max_complexity", "function_count", "class_count"]


def compare_baseline(current: DataFrame, baseline: DataFrame, threshold: float = 5.0, path: str = "file_path") -> DataFrame:
    """Per file and metric: both values, deltas, class, and the verdict of the file.

    One full outer join on the path; the unpivot is an exploded struct array, so
    the file verdict is known in the same row and needs no second shuffle.
    """
    m = BASELINE_METRICS
    cur = current.select(path, F.struct(*m).alias("c"))
    base = baseline.select(path, F.struct(*m).alias("b"))
    joined = cur.join(base, path, "full_outer")

    def change(name: str) -> Column:
        old, new = F.col(f"b.{name}").cast("double"), F.col(f"c.{name}").cast("double")
        pct = mx.percent_change(old, new)
        delta = new - old
        kind = F.when((F.abs(pct) < threshold) | F.lit(name not in RISING_IS_BAD), "neutral").when(delta > 0, "regression").when(delta < 0, "improvement").otherwise("neutral")
        return F.struct(
            F.lit(name).alias("metric"), old.alias("baseline_value"), new.alias("current_value"),
            delta.alias("delta"), F.round(pct, 4).alias("delta_percent"), kind.alias("class"),
        )

    out = joined.withColumn("changes", F.array(*[change(x) for x in m]))
    has = lambda k: F.exists("changes", lambda x: x["class"] == k)
    verdict = (
        F.when(F.col("b").isNull(), "new").when(F.col("c").isNull(), "deleted")
        .when(has("regression"), "regression").when(has("improvement"), "improvement").otherwise("unchanged")
    )
    return out.withColumn("verdict", verdict).select(path, "verdict", F.explode("changes").alias("x")).select(path, "verdict", "x.*")


def phase_count(first: Column, last: Column) -> Column:
    span = F.datediff(last, first)
    return F.when(span < 30, 1).when(span < 180, 2).otherwise(F.least(F.lit(5), F.greatest(F.lit(3), F.floor(span / 90)))).cast("int")


def evolution_phases(commits: DataFrame, sha: str = "sha", ts: str = "ts") -> DataFrame:
    """Commits with their phase (0-based): equal counts in date order, the rest in the last phase.

    The global order comes from range partitions plus offsets, never one sorted task.
    """
    facts = commits.agg(
        F.struct(F.count("*").alias("n"), phase_count(F.min(ts), F.max(ts)).alias("phases")).alias("f")
    )
    out = number_rows(commits, [ts, sha], "_rn").withColumn("_f", facts.scalar())
    size = F.floor(F.col("_f.n") / F.col("_f.phases"))
    slot = F.floor((F.col("_rn") - 1) / F.greatest(size, F.lit(1)))
    return out.withColumn("phase", F.least(slot, F.col("_f.phases") - 1).cast("int")).drop("_rn", "_f")


def phase_summary(phased: DataFrame, n: int = 5) -> DataFrame:
    """Per phase: commits, first and last date, and the n largest commits as rows."""
    stats = phased.groupBy("phase").agg(F.count("*").alias("commits"), F.min("ts").alias("date_start"), F.max("ts").alias("date_end"))
    w = Window.partitionBy("phase").orderBy(F.col("files_changed").desc(), "sha")
    top = phased.select("phase", "sha", "files_changed", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= n)
    return top.join(F.broadcast(stats), "phase")


def timeline_events(commits: DataFrame, issues: DataFrame, pulls: DataFrame, n: int = 10, max_issues: int | None = None, max_pulls: int | None = None) -> DataFrame:
    """Event rows: the n widest commits, and the issues (opened, closed) and merged requests, all or the first by number."""
    big = commits.orderBy(F.col("files_changed").desc(), "sha").limit(n).select(
        F.col("ts").alias("date"), F.lit("commit").alias("event_type"), F.col("sha").cast("string").alias("ref"),
        F.least(F.col("files_changed") / 20, F.lit(1.0)).alias("importance"),
    )
    first = issues if max_issues is None else issues.orderBy("number").limit(max_issues)
    opened = first.select(
        F.col("created_at").alias("date"), F.lit("issue_opened").alias("event_type"), F.col("number").cast("string").alias("ref"), F.lit(0.6).alias("importance")
    )
    closed = first.filter(F.col("closed_at").isNotNull()).select(
        F.col("closed_at").alias("date"), F.lit("issue_closed").alias("event_type"), F.col("number").cast("string").alias("ref"), F.lit(0.5).alias("importance")
    )
    merged = pulls.filter(F.col("merged_at").isNotNull())
    merged = (merged if max_pulls is None else merged.orderBy("number").limit(max_pulls)).select(
        F.col("merged_at").alias("date"), F.lit("merge").alias("event_type"), F.col("number").cast("string").alias("ref"),
        F.least(F.col("files_changed") / 15, F.lit(1.0)).alias("importance"),
    )
    return big.unionByName(opened).unionByName(closed).unionByName(merged).orderBy("date", "ref")


def entity_history(entities: DataFrame) -> DataFrame:
    """Distinct (name, file_path, commit) rows."""
    return entities.select("name", "file_path", "commit").distinct()


def blame_latest(ranges: DataFrame, blame: DataFrame, block: int = 64, path: str = "file_path") -> DataFrame:
    """Latest author, date and commit among the blamed lines of each range.

    The range condition becomes an equi-join on (file, line block): a range is
    spread over its blocks, a line lies in one. Partial max before the shuffle.
    """
    spread = ranges.withColumn(
        "_block",
        F.explode(F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block))),
    )
    line_rows = blame.withColumn("_block", F.floor(F.col("line") / block)).select(path, "_block", "line", "author", "ts", "commit")
    hit = spread.join(line_rows, [path, "_block"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return (
        hit.groupBy(path, "start_line", "end_line")
        .agg(F.max(F.struct("ts", "author", "commit")).alias("m"))
        .select(path, "start_line", "end_line", "m.ts", "m.author", "m.commit")
    )


def latest_drift(audits: DataFrame, current: DataFrame, as_of: Column) -> DataFrame:
    """Per target: does the policy hash or head commit differ from the latest audit row?"""
    latest = audits.groupBy("target").agg(
        F.max_by(F.struct("ts", "commit_sha", "policy_sha256"), F.struct("ts", "commit_sha")).alias("a")
    )
    out = current.join(latest, "target", "left")
    policy = F.coalesce(F.col("current_policy") != F.col("a.policy_sha256"), F.lit(False))
    code = F.coalesce(F.col("current_commit") != F.col("a.commit_sha"), F.lit(False))
    return out.select(
        "target",
        policy.alias("policy_changed"),
        code.alias("code_changed"),
        (F.col("a").isNull() | policy | code).alias("has_drift"),
        F.datediff(as_of, F.col("a.ts")).alias("days_since"),
    )
