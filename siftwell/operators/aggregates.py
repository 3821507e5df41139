"""Summaries over chunk, smell, file and commit tables. Every one is a partial aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions import metrics as mx
from siftwell.functions import text as tx
from siftwell.runtime import fixed_table

# Minutes to fix and debt category per smell type.
REMEDIATION = [
    ("long_method", 20, "maintainability"),
    ("deep_nesting", 15, "complexity"),
    ("god_class", 120, "maintainability"),
    ("high_cognitive_complexity", 30, "complexity"),
    ("high_cyclomatic_complexity", 25, "complexity"),
    ("complex_method", 25, "complexity"),
    ("circular_dependency", 60, "maintainability"),
    ("empty_catch", 5, "reliability"),
    ("magic_number", 5, "maintainability"),
    ("long_parameter_list", 15, "maintainability"),
    ("duplicate_code", 30, "maintainability"),
    ("dead_code", 10, "maintainability"),
    ("missing_docstring", 10, "documentation"),
]
DEFAULT_MINUTES = 15
SEVERITY_FACTOR = {"error": 1.5, "warning": 1.0, "info": 0.5}
REVIEW_WEIGHT = {"critical": 0.25, "high": 0.15, "medium": 0.10, "low": 0.05, "info": 0.01}
# File suffixes counted as documentation.
DOC_SUFFIXES = [".md", ".rst", ".txt", ".adoc", ".org"]


def index_stats(chunks: DataFrame, language: str = "lang", path: str = "file_path") -> DataFrame:
    """Rows per (dimension, value): total chunks and files, chunks per language, files per suffix."""
    total = chunks.agg(F.count("*").alias("chunks"), F.countDistinct(path).alias("files"))
    head = total.select(
        F.explode(
            F.array(
                F.struct(F.lit("total").alias("dimension"), F.lit("chunks").alias("value"), F.col("chunks").alias("n")),
                F.struct(F.lit("total").alias("dimension"), F.lit("files").alias("value"), F.col("files").alias("n")),
            )
        ).alias("r")
    ).select("r.*")
    by_language = chunks.groupBy(F.col(language).alias("value")).agg(F.count("*").alias("n"))
    by_type = (
        chunks.select(path).distinct().groupBy(tx.suffix(F.col(path)).alias("value")).agg(F.count("*").alias("n"))
    )
    return head.unionByName(by_language.select(F.lit("language").alias("dimension"), "value", "n")).unionByName(
        by_type.select(F.lit("file_type").alias("dimension"), "value", "n")
    )


def status_counts(chunks: DataFrame, status: str = "embedding_status") -> DataFrame:
    """One row: chunks per embedding status, files and languages."""
    s = F.col(status)
    return chunks.agg(
        F.count("*").alias("total"),
        *[F.count_if(s == v).alias(v) for v in ("pending", "processing", "complete", "error")],
        F.countDistinct("file_path").alias("files"),
        F.countDistinct("lang").alias("languages"),
    )


def dominant_hash(chunks: DataFrame, path: str = "file_path", digest: str = "file_hash") -> DataFrame:
    """Most frequent hash per file, the smallest one on ties (a partial-aggregating max of a struct)."""
    counts = chunks.groupBy(path, digest).agg(F.count("*").alias("n"))
    best = counts.groupBy(path).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(digest).alias("h"))).alias("b"))
    return best.select(path, F.col("b.h").alias(digest), (-F.col("b.k")).alias("n"))


def _ancestors(path: Column) -> Column:
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    prefixes = F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(depth >= 1, prefixes).otherwise(F.array().cast("array<string>"))


def directory_rollup(files: DataFrame, path: str = "file_path", chunks: str = "chunks", modified: str = "modified") -> DataFrame:
    """Per ancestor directory: depth, chunks below, newest change, files directly inside, direct subdirectories."""
    base = files.select(
        F.explode(_ancestors(F.col(path))).alias("directory"),
        F.regexp_replace(path, "/[^/]*$", "").alias("_parent"),
        F.col(chunks).alias("_c"),
        F.col(modified).alias("_m"),
    )
    stats = base.groupBy("directory").agg(
        F.sum("_c").alias("total_chunks"),
        F.max("_m").alias("last_modified"),
        F.count_if(F.col("directory") == F.col("_parent")).alias("file_count"),
    )
    children = (
        stats.filter(F.contains("directory", F.lit("/")))
        .groupBy(F.regexp_replace("directory", "/[^/]*$", "").alias("directory"))
        .agg(F.count("*").alias("subdirectory_count"))
    )
    return stats.join(children, "directory", "left").select(
        "directory",
        F.size(F.split("directory", "/")).alias("depth"),
        "total_chunks",
        "last_modified",
        "file_count",
        F.coalesce("subdirectory_count", F.lit(0)).alias("subdirectory_count"),
    )


def directory_languages(files: DataFrame, path: str = "file_path", chunks: str = "chunks", language: str = "lang") -> DataFrame:
    """Chunks per (ancestor directory, language)."""
    return (
        files.select(F.explode(_ancestors(F.col(path))).alias("directory"), F.col(language).alias("language"), F.col(chunks).alias("c"))
        .groupBy("directory", "language")
        .agg(F.sum("c").alias("chunks"))
    )


def smell_array() -> Column:
    return mx.smells(
        F.col("cognitive_complexity"),
        F.col("cyclomatic_complexity"),
        F.col("max_nesting_depth"),
        F.col("parameter_count"),
        F.col("lines_of_code"),
    )


def detect_smells(chunk_metrics: DataFrame) -> DataFrame:
    """One row per smell of each function row."""
    return chunk_metrics.select("file_path", "name", F.explode(smell_array()).alias("s")).select(
        "file_path",
        F.col("name").alias("function_name"),
        F.col("s.name").alias("name"),
        F.col("s.severity").alias("severity"),
        F.col("s.metric_value").alias("metric_value"),
        F.col("s.threshold").alias("threshold"),
    )


def god_classes(file_metrics: DataFrame) -> DataFrame:
    """Files with too many methods and too many lines."""
    return file_metrics.filter(
        (F.col("method_count") > mx.GOD_CLASS_METHODS) & (F.col("total_lines") > mx.GOD_CLASS_LINES)
    ).select(
        "file_path",
        F.lit(None).cast("string").alias("function_name"),
        F.lit("God Class").alias("name"),
        F.lit("error").alias("severity"),
        F.col("method_count").cast("double").alias("metric_value"),
        F.lit(float(mx.GOD_CLASS_METHODS)).alias("threshold"),
    )


def file_metrics(chunk_metrics: DataFrame) -> DataFrame:
    """Per file: complexity sum, mean, maximum, sizes, kinds and smell count, in one aggregate."""
    kind = F.col("chunk_type")
    return chunk_metrics.groupBy("file_path").agg(
        F.count("*").alias("chunk_count"),
        F.sum("cognitive_complexity").alias("total_complexity"),
        F.avg("cognitive_complexity").alias("avg_complexity"),
        F.max("cognitive_complexity").alias("max_complexity"),
        F.sum("lines_of_code").alias("total_lines"),
        F.sum("comment_lines").alias("comment_lines"),
        F.count_if(kind == "function").alias("function_count"),
        F.count_if(kind == "class").alias("class_count"),
        F.count_if(kind == "method").alias("method_count"),
        F.sum(F.size(smell_array())).alias("smell_count"),
    )


def with_health(files: DataFrame) -> DataFrame:
    return files.withColumn(
        "health",
        mx.file_health(F.col("avg_complexity"), F.col("smell_count"), F.col("total_lines"), F.col("comment_lines")),
    )


def project_summary(files: DataFrame, chunk_metrics: DataFrame) -> DataFrame:
    """One row: totals, mean file complexity, mean health, files below 0.7, and one column per grade."""
    g = mx.grade(F.col("cognitive_complexity"))
    totals = with_health(files).agg(
        F.count("*").alias("total_files"),
        F.sum("total_lines").alias("total_lines"),
        F.sum("function_count").alias("total_functions"),
        F.sum("class_count").alias("total_classes"),
        F.round(F.avg("avg_complexity"), 2).alias("avg_file_complexity"),
        F.round(F.avg("health"), 6).alias("avg_health"),
        F.count_if(F.col("health") < 0.7).alias("files_needing_attention"),
    )
    grades = chunk_metrics.agg(
        F.struct(*[F.count_if(g == x).alias(f"grade_{x.lower()}") for x in "ABCDF"]).alias("g")
    )
    return totals.withColumn("g", grades.scalar()).select("*", "g.*").drop("g")


def hotspots(files: DataFrame, n: int = 10) -> DataFrame:
    """The n files of highest mean complexity (a top-k report)."""
    return files.orderBy(F.col("avg_complexity").desc(), "file_path").limit(n)


def coupling(imports: DataFrame, source: str = "file_path", target: str = "module") -> DataFrame:
    """Ce, Ca, instability, grade and category per file of an import table."""
    pairs = imports.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("s").alias("file"), F.lit(1).alias("ce"), F.lit(0).alias("ca")),
        F.struct(F.col("t").alias("file"), F.lit(0).alias("ce"), F.lit(1).alias("ca")),
    )).alias("e")).select("e.*")
    out = both.groupBy("file").agg(F.sum("ce").alias("efferent"), F.sum("ca").alias("afferent"))
    total = F.col("efferent") + F.col("afferent")
    instability = F.when(total == 0, 0.0).otherwise(F.col("efferent") / total)
    return out.withColumn("instability", instability).select(
        "file",
        "efferent",
        "afferent",
        "instability",
        mx.stability_grade(F.col("instability")).alias("grade"),
        mx.stability_category(F.col("instability")).alias("category"),
    )


def debt_items(smells: DataFrame) -> DataFrame:
    """Smells with minutes (severity-weighted) and debt category."""
    table = fixed_table(smells.sparkSession, REMEDIATION, "smell_type string, base_minutes int, category string")
    factor = F.lit(1.0)
    for sev, x in SEVERITY_FACTOR.items():
        factor = F.when(F.col("severity") == sev, x).otherwise(factor)
    return (
        smells.withColumn("smell_type", F.regexp_replace(F.lower("name"), " ", "_"))
        .join(F.broadcast(table), "smell_type", "left")
        .withColumn("minutes", F.coalesce("base_minutes", F.lit(DEFAULT_MINUTES)) * factor)
        .withColumn("category", F.coalesce("category", F.lit("maintainability")))
    )


def debt_summary(smells: DataFrame, top: int = 10) -> DataFrame:
    """Rows (section, key, minutes, hours, items): total, by category, by severity, top files and smell types.

    Small dimensions are first summed to one row per combination and only those
    few rows go through the grouping sets; files are summed apart and cut to the top.
    """
    items = debt_items(smells)
    sums = [F.sum("minutes").alias("minutes"), F.count("*").alias("items")]
    small = items.groupBy("category", "severity", "smell_type").agg(*sums)
    rolled = small.groupingSets([[], ["category"], ["severity"], ["smell_type"]], "category", "severity", "smell_type").agg(
        F.grouping_id().alias("gid"), F.sum("minutes").alias("minutes"), F.sum("items").alias("items")
    )
    section = F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "category").when(F.col("gid") == 5, "severity").otherwise("smell_type")
    parts = rolled.select(section.alias("section"), F.coalesce("category", "severity", "smell_type", F.lit("all")).alias("key"), "minutes", "items")
    w = Window.partitionBy("section").orderBy(F.col("minutes").desc(), "key")
    parts = parts.withColumn("_r", F.row_number().over(w)).filter((F.col("section") != "smell_type") | (F.col("_r") <= top)).drop("_r")
    files = items.groupBy("file_path").agg(*sums).orderBy(F.col("minutes").desc(), "file_path").limit(top)
    out = parts.unionByName(files.select(F.lit("file").alias("section"), F.col("file_path").alias("key"), "minutes", "items"))
    return out.select("section", "key", F.round("minutes", 2).alias("minutes"), F.round(F.col("minutes") / 60, 2).alias("hours"), "items")


def smell_summary(smells: DataFrame) -> DataFrame:
    """Rows (section, key, n): total, per severity, per smell name, in one grouping-set pass."""
    out = smells.groupingSets([[], ["severity"], ["name"]], "severity", "name").agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n")
    )
    section = F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "severity").otherwise("name")
    return out.select(section.alias("section"), F.coalesce("severity", "name", F.lit("all")).alias("key"), "n")


def engineer_scores(functions: DataFrame, author: str = "author_id") -> DataFrame:
    """Issue counts, weighted issues and score per author: max(0, 100 - 10 · issues per thousand lines)."""
    cc, ln = F.col("cyclomatic_complexity"), F.col("lines_of_code")
    out = functions.groupBy(author).agg(
        F.count("*").alias("functions"),
        F.sum(ln).alias("total_lines"),
        F.count_if(cc > 10).alias("complex"),
        F.count_if(cc > 20).alias("very_complex"),
        F.count_if(ln > 50).alias("long"),
        F.count_if(ln > 100).alias("very_long"),
        F.count_if(F.col("max_nesting_depth") > 4).alias("nested"),
        F.count_if(F.col("parameter_count") > 5).alias("many_params"),
        F.round(F.avg(cc), 1).alias("avg_complexity"),
    )
    issues = (
        F.col("complex") * 2 + F.col("very_complex") * 5 + F.col("long") + F.col("very_long") * 3 + F.col("nested") * 2 + F.col("many_params")
    )
    score = F.when(F.col("total_lines") == 0, 100.0).otherwise(
        F.greatest(F.lit(0.0), 100 - issues / F.col("total_lines") * 1000 * 10)
    )
    return out.withColumn("issues", issues).withColumn("score", F.round(score, 1))


def contributors(commits: DataFrame, author: str = "author", ts: str = "ts") -> DataFrame:
    """Commits, first and last date per author."""
    return commits.groupBy(author).agg(
        F.count("*").alias("commits"), F.min(ts).alias("first_commit"), F.max(ts).alias("last_commit")
    )


def top_files(commit_files: DataFrame, group: str = "author", n: int = 5) -> DataFrame:
    """The n most touched files per group; the rank filter is a group limit below the shuffle."""
    w = Window.partitionBy(group).orderBy(F.col("touches").desc(), "path")
    return (
        commit_files.groupBy(group, "path").agg(F.count("*").alias("touches"))
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    )


def commit_density(commits: DataFrame, by_author: bool = False) -> DataFrame:
    keys = (["author"] if by_author else []) + [F.to_date("ts").alias("day")]
    return commits.groupBy(*keys).agg(F.count("*").alias("commits"))


def language_profile(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Per suffix: files, percent, and the size category and type of the whole collection."""
    ext = (
        files.select(tx.suffix(F.col(path)).alias("suffix")).filter(F.col("suffix") != "")
        .groupBy("suffix").agg(F.count("*").alias("files"))
    )
    totals = ext.agg(
        F.sum("files").alias("n"),
        F.sum(F.when(F.col("suffix").isin(DOC_SUFFIXES), F.col("files")).otherwise(0)).alias("doc"),
        F.sum(F.when(F.col("suffix") == ".py", F.col("files")).otherwise(0)).alias("py"),
        F.sum(F.when(F.col("suffix").isin(".js", ".ts", ".tsx", ".jsx"), F.col("files")).otherwise(0)).alias("js"),
        F.sum(F.when(F.col("suffix") == ".java", F.col("files")).otherwise(0)).alias("java"),
    ).select(F.struct("*").alias("t"))
    out = ext.withColumn("t", totals.scalar())
    n = F.col("t.n")
    size = F.when(n < 1000, "small").when(n < 10000, "medium").when(n < 50000, "large").otherwise("enterprise")
    kind = (
        F.when(F.col("t.doc") / n > 0.3, "documentation").when(F.col("t.py") / n > 0.6, "python")
        .when(F.col("t.js") / n > 0.6, "javascript").when(F.col("t.java") / n > 0.6, "java").otherwise("mixed")
    )
    return out.select(
        "suffix", "files", F.round(F.col("files") / n * 100, 4).alias("percent"), size.alias("size"), kind.alias("type")
    )


def concept_members(chunks: DataFrame, min_chunks: int = 2, summary_words: int | None = None) -> DataFrame:
    """(concept, chunk_id, frequency) for concepts held by several chunks.

    Concepts are the name, the parent name, the path parts and the long words of the
    summary, all or the first ``summary_words``, cleaned to lower-case words. Members stay rows: a
    concept shared by a third of all chunks never becomes one array.
    """
    cleaned = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    path_parts = F.transform(F.split(F.regexp_replace("file_path", r"\.[^./]+$", ""), "/"), cleaned)
    long_words = F.filter(F.regexp_extract_all(F.lower("docstring"), F.lit("[a-z]+"), 0), lambda w: F.length(w) > 4)
    long_words = long_words if summary_words is None else F.slice(long_words, 1, summary_words)
    concepts = F.array_distinct(
        F.concat(F.array_compact(F.array(cleaned("name"), cleaned("parent_name"))), path_parts, F.coalesce(long_words, F.array().cast("array<string>")))
    )
    members = (
        chunks.select("chunk_id", F.explode(concepts).alias("concept")).filter(F.length("concept") > 2).distinct()
    )
    frequent = members.groupBy("concept").agg(F.count("*").alias("frequency")).filter(F.col("frequency") >= min_chunks)
    return members.join(frequent, "concept")


def audit_summary(verdicts: DataFrame) -> DataFrame:
    """Verdict counts with ignored ones apart, and the overall status."""
    active = ~F.col("ignored")
    s = F.col("status")
    names = ["PASS", "FAIL", "INSUFFICIENT_EVIDENCE", "MANUAL_REVIEW"]
    out = verdicts.agg(
        *[F.count_if(active & (s == x)).alias(x.lower()) for x in names],
        F.count_if(F.col("ignored")).alias("ignored"),
        F.count("*").alias("total"),
    )
    overall = (
        F.when(F.col("fail") > 0, "FAILED")
        .when(F.col("manual_review") + F.col("insufficient_evidence") > 0, "CERTIFIED_WITH_EXCEPTIONS")
        .otherwise("CERTIFIED")
    )
    return out.withColumn("overall", overall)


def review_score(comments: DataFrame, key: str = "file_path") -> DataFrame:
    """Verdict and score of review comments per key."""
    weight = F.lit(0.0)
    for sev, x in REVIEW_WEIGHT.items():
        weight = F.when(F.col("severity") == sev, x).otherwise(weight)
    out = comments.groupBy(key).agg(
        F.count_if(F.col("is_blocking")).alias("_b"),
        F.count_if(F.col("severity").isin("medium", "high")).alias("_m"),
        F.sum(weight).alias("_w"),
    )
    verdict = F.when(F.col("_b") > 0, "request_changes").when(F.col("_m") > 0, "comment").otherwise("approve")
    return out.select(key, verdict.alias("verdict"), F.round(F.greatest(F.lit(0.0), 1 - F.col("_w")), 6).alias("score"))


def result_quality(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: mean score, counts per band, file diversity, share of query words found in any hit.

    Words are matched as rows, so no hit texts are gathered per query.
    """
    base = hits.groupBy("query_id").agg(
        F.round(F.avg("score"), 3).alias("average_score"),
        F.count_if(F.col("score") >= 0.8).alias("high_quality"),
        F.count_if((F.col("score") >= 0.6) & (F.col("score") < 0.8)).alias("medium_quality"),
        F.count_if(F.col("score") < 0.6).alias("low_quality"),
        F.round(F.countDistinct("file_path") / F.count("*"), 3).alias("diversity"),
    )
    asked = queries.select("query_id", F.array_distinct(tx.words(F.col("text"))).alias("_q"))
    found = (
        hits.select("query_id", "content").join(asked, "query_id")
        .select("query_id", F.size("_q").alias("_n"), F.explode(F.array_intersect("_q", tx.words(F.col("content")))).alias("_w"))
        .groupBy("query_id").agg(F.round(F.countDistinct("_w") / F.max("_n"), 3).alias("coverage"))
    )
    return base.join(found, "query_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def baseline_summary(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Totals of two file-metric tables side by side."""

    def side(df: DataFrame, name: str) -> DataFrame:
        n = F.count("*")
        total = F.coalesce(F.sum("total_complexity"), F.lit(0))
        return df.agg(
            F.struct(
                n.alias(f"total_files_{name}"),
                F.coalesce(F.sum("function_count"), F.lit(0)).alias(f"total_functions_{name}"),
                total.alias(f"total_complexity_{name}"),
                F.round(F.when(n > 0, total / n).otherwise(0.0), 2).alias(f"avg_complexity_{name}"),
                F.coalesce(F.max("max_complexity"), F.lit(0)).alias(f"max_complexity_{name}"),
            ).alias("s")
        )

    return side(current, "current").select("s.*", side(baseline, "baseline").scalar().alias("b")).select("*", "b.*").drop("b")
