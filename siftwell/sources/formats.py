"""Text formats in and out: commit logs, diffs, result exports, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as tx

# Message patterns and files that mark dependency commits.
DEPENDENCY_MESSAGES = [
    r"bump\s+\S+\s+(from|to|version)",
    r"update\s+(dependencies|deps|packages)",
    r"upgrade\s+\S+\s+(from|to)",
    r"deps?:|chore\(deps?\):",
    r"^chore:\s*(bump|update|upgrade)",
]
DEPENDENCY_FILES = [
    "package.json", "package-lock.json", "requirements.txt", "Pipfile.lock", "Cargo.lock", "go.mod", "go.sum", "yarn.lock", "pnpm-lock.yaml",
]

def read_commits(log: DataFrame, text: str = "text") -> DataFrame:
    """Commits of ``hash|short|subject|body|author|email|date`` lines, each followed by tab-separated file counts.

    Every row of the input holds any number of commits. A row is cut before each
    header line, so parsing is Column work on one commit at a time.
    """
    parts = F.split(F.col(text), r"(?m)^(?=[^|\t\n]*(?:\|[^|\n]*){5}\|)")
    one = log.select(F.explode(parts).alias("_c")).filter(F.contains("_c", F.lit("|")))
    rows = F.split(F.col("_c"), "\n")
    head = F.split(rows[0], r"\|", 7)
    stats = F.filter(F.slice(rows, 2, F.size(rows)), lambda r: F.size(F.split(r, "\t")) >= 3)
    count = lambda r, i: F.coalesce(F.split(r, "\t")[i].try_cast("int"), F.lit(0))
    total = lambda i: F.aggregate("_s", F.lit(0), lambda acc, r: acc + count(r, i))
    return (
        one.select(head.alias("_h"), stats.alias("_s"))
        .filter((F.size("_h") == 7) & F.try_to_timestamp(F.get("_h", F.lit(6))).isNotNull())
        .select(
            F.get("_h", F.lit(0)).alias("sha"), F.get("_h", F.lit(2)).alias("message"), F.get("_h", F.lit(4)).alias("author"), F.get("_h", F.lit(5)).alias("email"),
            F.try_to_timestamp(F.get("_h", F.lit(6))).alias("ts"),
            F.transform("_s", lambda r: F.split(r, "\t")[2]).alias("files"), F.size("_s").alias("files_changed"),
            total(0).alias("insertions"), total(1).alias("deletions"), F.contains(F.lower(F.get("_h", F.lit(2))), F.lit("merge")).alias("is_merge"),
        )
    )


def parse_diff_stats(diffs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, file, additions, deletions) of unified diffs; the ``+++`` and ``---`` lines do not count.

    A diff is cut at its ``diff --git`` lines, so each file is one short text.
    """
    piece = diffs.select(key, F.explode(F.split(text, r"(?m)^(?=diff --git )")).alias("_d")).filter(F.startswith("_d", F.lit("diff --git ")))
    rows = F.split("_d", "\n")
    marked = lambda sign, three: F.size(F.filter(rows, lambda r: F.startswith(r, F.lit(sign)) & ~F.startswith(r, F.lit(three))))
    return piece.select(
        key, F.regexp_extract("_d", r" b/(.+)", 1).alias("file"), marked("+", "+++").alias("additions"), marked("-", "---").alias("deletions")
    )


def filter_dependency_commits(commits: DataFrame, message: str = "message", files: str = "files") -> DataFrame:
    """Without commits whose message or whole file list is about dependencies."""
    low = F.lower(message)
    told = tx.any_of([low.rlike(p) for p in DEPENDENCY_MESSAGES])
    only = (F.size(files) > 0) & F.forall(files, lambda f: tx.basename(f).isin(DEPENDENCY_FILES))
    return commits.filter(~(told | F.coalesce(only, F.lit(False))))


def export_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Ranked results as JSON lines, CSV or markdown text files."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        df.write.mode("overwrite").option("header", "true").csv(path)
    elif fmt == "markdown":
        df.select(markdown_row().alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def markdown_row() -> Column:
    """One result as a markdown section."""
    return F.format_string("## %d. %s:%d\n\nscore %.3f\n\n```\n%s\n```\n", "rank", "file_path", "start_line", "score", "content")


def sarif_results(smells: DataFrame) -> DataFrame:
    """(rule_id, fingerprint, result JSON) per smell; location is ``path:line``."""
    rule = F.regexp_replace(F.lower("name"), " ", "-")
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    mark = F.concat_ws(":", "name", "location", F.format_string("%.1f", F.col("metric_value")))
    fingerprint = F.substring(F.sha2(mark.cast("binary"), 256), 1, 16)
    line = F.regexp_extract("location", r":(\d+)$", 1)
    region = F.when(line != "", F.struct(line.cast("int").alias("startLine")))
    place = F.struct(F.struct(F.struct(F.regexp_replace("location", r":\d+$", "").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        rule.alias("ruleId"), level.alias("level"), F.struct(F.col("name").alias("text")).alias("message"), F.array(place).alias("locations"),
        F.struct(fingerprint.alias("primaryLocationLineHash")).alias("partialFingerprints"),
        F.struct(F.col("metric_value").alias("metricValue"), F.col("threshold")).alias("properties"),
    )
    return smells.select(rule.alias("rule_id"), level.alias("level"), fingerprint.alias("fingerprint"), F.to_json(result).alias("result"))


def export_sarif(smells: DataFrame, path: str) -> None:
    sarif_results(smells).select(F.col("result").alias("value")).write.mode("overwrite").text(path)
