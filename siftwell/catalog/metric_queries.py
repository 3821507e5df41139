"""Metric, aggregation and history queries."""

from pyspark.sql import functions as F

from siftwell.catalog import standins as st
from siftwell.catalog.registry import query
from siftwell.functions import metrics as mx
from siftwell.operators import aggregates as ag
from siftwell.operators import history as hi

GRADE = "CASE WHEN {0} <= 5 THEN 'A' WHEN {0} <= 10 THEN 'B' WHEN {0} <= 20 THEN 'C' WHEN {0} <= {1} THEN 'D' ELSE 'F' END"


@query("grade", f"WITH {st.CM} SELECT {GRADE.format('cognitive_complexity', 30)} AS grade, count(*) AS n FROM cm GROUP BY 1")
def grade(spark, d):
    return st.chunk_metrics(spark, d).groupBy(mx.grade(F.col("cognitive_complexity")).alias("grade")).agg(F.count("*").alias("n"))


@query("detect_smells", f"WITH {st.SMELLS} SELECT * FROM smells")
def detect_smells(spark, d):
    return ag.detect_smells(st.chunk_metrics(spark, d))


@query(
    "god_classes",
    """WITH f AS (SELECT l_suppkey AS s, count_if(l_returnflag = 'A') AS m, sum(floor(l_extendedprice / 1000)::INT) AS n
    FROM lineitem GROUP BY 1) SELECT 's' || s AS file_path, 'error' AS severity, m::DOUBLE AS metric_value FROM f WHERE m > 20 AND n > 500""",
)
def god_classes(spark, d):
    cm = st.chunk_metrics(spark, d).withColumn("file_path", F.concat(F.lit("s"), F.col("author_id")))
    return ag.god_classes(ag.file_metrics(cm)).select("file_path", "severity", "metric_value")


@query(
    "halstead",
    """WITH h AS (SELECT l_linenumber AS n1, round(l_tax * 100)::INT AS n2, l_quantity::INT AS b1, round(l_discount * 100)::INT AS b2, * FROM lineitem),
    v AS (SELECT *, CASE WHEN n1 + n2 = 0 OR b1 + b2 = 0 THEN 0 ELSE (b1 + b2) * log2(n1 + n2) END AS volume,
          CASE WHEN n2 = 0 OR b1 + b2 = 0 THEN 0 ELSE n1 / 2.0 * (b2 / n2) END AS difficulty FROM h)
    SELECT l_orderkey, l_linenumber, n1 + n2 AS vocabulary, b1 + b2 AS length, round(volume, 6)::DOUBLE AS volume,
      round(difficulty, 6)::DOUBLE AS difficulty, round(difficulty * volume, 4)::DOUBLE AS effort,
      round(difficulty * volume / 18, 4)::DOUBLE AS time_seconds, round(volume / 3000, 6)::DOUBLE AS estimated_bugs FROM v""",
)
def halstead(spark, d):
    li = st.table(spark, d, "lineitem")
    h = mx.halstead(
        F.col("l_linenumber"), F.round(F.col("l_tax") * 100).cast("int"), F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int")
    )
    places = {"volume": 6, "difficulty": 6, "effort": 4, "time_seconds": 4, "estimated_bugs": 6}
    return li.select("l_orderkey", "l_linenumber", *[(F.round(c, places[k]) if k in places else c).alias(k) for k, c in h.items()])


@query(
    "chunk_quality",
    f"""WITH {st.CM}, q AS (
      SELECT *, (lines_of_code > 50)::INT + (parameter_count > 5)::INT + (max_nesting_depth > 4)::INT + (cyclomatic_complexity > 10)::INT
             + (chunk_type = 'class' AND lines_of_code > 500)::INT AS smell_count,
             CASE WHEN cyclomatic_complexity = 0 THEN greatest(1.0, lines_of_code / 5) ELSE cyclomatic_complexity END::DOUBLE AS eff FROM cm)
    SELECT file_path, name, smell_count, {GRADE.format('eff', 50)} AS complexity_grade,
           round(greatest(0, greatest(0, 1 - least(eff / 50, 1)) - smell_count * 0.1), 2)::DOUBLE AS quality_score FROM q""",
)
def chunk_quality(spark, d):
    cm = st.chunk_metrics(spark, d)
    known = F.when(F.col("cyclomatic_complexity") > 0, F.col("cyclomatic_complexity"))
    eff = mx.effective_complexity(known, F.lit(0.0), F.col("lines_of_code"))
    n = mx.chunk_smell_count(F.col("chunk_type"), F.col("lines_of_code"), F.col("parameter_count"), F.col("max_nesting_depth"), known)
    return cm.select(
        "file_path", "name", n.alias("smell_count"), mx.chunk_grade(eff).alias("complexity_grade"), mx.chunk_quality(eff, n).alias("quality_score")
    )


@query(
    "threshold_compare",
    f"""WITH {st.FILE_METRICS}, v AS (
      SELECT 'avg_cognitive_complexity' AS metric, avg(cognitive_complexity) AS value, 10.0::DOUBLE AS threshold FROM cm
      UNION ALL SELECT 'avg_cyclomatic_complexity', avg(cyclomatic_complexity), 10.0 FROM cm
      UNION ALL SELECT 'avg_file_lines', avg(total_lines), 500.0 FROM fm),
    p AS (SELECT *, value / threshold * 100 AS pct FROM v)
    SELECT metric, round(value, 4) AS value, threshold, round(pct, 4) AS percentage,
      CASE WHEN pct < 50 THEN 'well_below' WHEN pct < 100 THEN 'below' WHEN pct <= 110 THEN 'at_threshold' WHEN pct <= 150 THEN 'above' ELSE 'well_above' END AS comparison,
      CASE WHEN pct < 100 THEN 'info' WHEN pct <= 150 THEN 'warning' ELSE 'error' END AS severity FROM p""",
)
def threshold_compare(spark, d):
    cm = st.chunk_metrics(spark, d)
    a = cm.agg(F.avg("cognitive_complexity").alias("a"), F.avg("cyclomatic_complexity").alias("b"), F.sum("lines_of_code").alias("l"), F.countDistinct("file_path").alias("f"))
    rows = F.array(
        F.struct(F.lit("avg_cognitive_complexity").alias("metric"), F.col("a").alias("value"), F.lit(10.0).alias("threshold")),
        F.struct(F.lit("avg_cyclomatic_complexity").alias("metric"), F.col("b").alias("value"), F.lit(10.0).alias("threshold")),
        F.struct(F.lit("avg_file_lines").alias("metric"), (F.col("l") / F.col("f")).alias("value"), F.lit(500.0).alias("threshold")),
    )
    v = a.select(F.explode(rows).alias("r")).select("r.*")
    p = mx.threshold_position(F.col("value"), F.col("threshold"))
    return v.select("metric", F.round("value", 4).alias("value"), "threshold", F.round(p["percentage"], 4).alias("percentage"), p["comparison"].alias("comparison"), p["severity"].alias("severity"))


@query("file_metrics_agg", f"WITH {st.FILE_METRICS} SELECT * REPLACE (round(avg_complexity, 6) AS avg_complexity) FROM fm")
def file_metrics_agg(spark, d):
    return ag.file_metrics(st.chunk_metrics(spark, d)).withColumn("avg_complexity", F.round("avg_complexity", 6))


@query("file_health", f"WITH {st.FILE_METRICS} SELECT file_path, round(health, 6) AS health FROM health")
def file_health(spark, d):
    return ag.with_health(ag.file_metrics(st.chunk_metrics(spark, d))).select("file_path", F.round("health", 6).alias("health"))


@query(
    "project_summary",
    f"""WITH {st.FILE_METRICS} SELECT count(*) AS total_files, sum(total_lines)::BIGINT AS total_lines, sum(function_count)::BIGINT AS total_functions,
      sum(class_count)::BIGINT AS total_classes, round(avg(avg_complexity), 2) AS avg_file_complexity, round(avg(health), 6) AS avg_health,
      count_if(health < 0.7)::BIGINT AS files_needing_attention,
      (SELECT count_if(cognitive_complexity <= 5) FROM cm)::BIGINT AS grade_a,
      (SELECT count_if(cognitive_complexity > 5 AND cognitive_complexity <= 10) FROM cm)::BIGINT AS grade_b,
      (SELECT count_if(cognitive_complexity > 10 AND cognitive_complexity <= 20) FROM cm)::BIGINT AS grade_c,
      (SELECT count_if(cognitive_complexity > 20 AND cognitive_complexity <= 30) FROM cm)::BIGINT AS grade_d,
      (SELECT count_if(cognitive_complexity > 30) FROM cm)::BIGINT AS grade_f FROM health""",
)
def project_summary(spark, d):
    cm = st.chunk_metrics(spark, d)
    return ag.project_summary(ag.file_metrics(cm), cm)


@query(
    "hotspots",
    f"WITH {st.FILE_METRICS} SELECT file_path, round(avg_complexity, 6) AS avg_complexity FROM fm ORDER BY fm.avg_complexity DESC, file_path LIMIT 10",
)
def hotspots(spark, d):
    return ag.hotspots(ag.file_metrics(st.chunk_metrics(spark, d))).select("file_path", F.round("avg_complexity", 6).alias("avg_complexity"))


DEBT = f"""{st.SMELLS}, items AS (
      SELECT *, replace(lower(name), ' ', '_') AS smell_type,
        CASE name WHEN 'Long Method' THEN 20 WHEN 'Deep Nesting' THEN 15 WHEN 'Long Parameter List' THEN 15 ELSE 25 END::DOUBLE AS minutes,
        CASE WHEN name IN ('Deep Nesting', 'Complex Method') THEN 'complexity' ELSE 'maintainability' END AS category FROM smells)"""


@query(
    "debt_summary",
    f"""WITH {DEBT}, parts AS (
      SELECT 'total' AS section, 'all' AS key, sum(minutes) AS minutes, count(*) AS items, 1 AS r FROM items
      UNION ALL SELECT 'category', category, sum(minutes), count(*), 1 FROM items GROUP BY category
      UNION ALL SELECT 'severity', severity, sum(minutes), count(*), 1 FROM items GROUP BY severity
      UNION ALL SELECT 'file', file_path, sum(minutes), count(*), row_number() OVER (ORDER BY sum(minutes) DESC, file_path) FROM items GROUP BY file_path
      UNION ALL SELECT 'smell_type', smell_type, sum(minutes), count(*), row_number() OVER (ORDER BY sum(minutes) DESC, smell_type) FROM items GROUP BY smell_type)
    SELECT section, key, round(minutes, 2) AS minutes, round(minutes / 60, 2) AS hours, items FROM parts WHERE r <= 10""",
)
def debt_summary(spark, d):
    return ag.debt_summary(ag.detect_smells(st.chunk_metrics(spark, d)))


@query(
    "smell_summary",
    f"""WITH {st.SMELLS} SELECT 'total' AS section, 'all' AS key, count(*) AS n FROM smells
    UNION ALL SELECT 'severity', severity, count(*) FROM smells GROUP BY severity
    UNION ALL SELECT 'name', name, count(*) FROM smells GROUP BY name""",
)
def smell_summary(spark, d):
    return ag.smell_summary(ag.detect_smells(st.chunk_metrics(spark, d)))


@query(
    "engineer_scores",
    f"""WITH {st.CM}, e AS (SELECT author_id, count(*) AS functions, sum(lines_of_code)::BIGINT AS total_lines,
      count_if(cyclomatic_complexity > 10)::BIGINT AS complex, count_if(cyclomatic_complexity > 20)::BIGINT AS very_complex,
      count_if(lines_of_code > 50)::BIGINT AS long, count_if(lines_of_code > 100)::BIGINT AS very_long,
      count_if(max_nesting_depth > 4)::BIGINT AS nested, count_if(parameter_count > 5)::BIGINT AS many_params,
      round(avg(cyclomatic_complexity), 1) AS avg_complexity FROM cm GROUP BY 1),
    i AS (SELECT *, complex * 2 + very_complex * 5 + long + very_long * 3 + nested * 2 + many_params AS issues FROM e)
    SELECT *, round(CASE WHEN total_lines = 0 THEN 100 ELSE greatest(0, 100 - issues / total_lines * 1000 * 10) END, 1)::DOUBLE AS score FROM i""",
)
def engineer_scores(spark, d):
    return ag.engineer_scores(st.chunk_metrics(spark, d))


@query(
    "review_score",
    f"""WITH {st.SMELLS}, s AS (SELECT file_path, CASE WHEN metric_value > threshold * 2 THEN 'high' WHEN metric_value > threshold * 1.5 THEN 'medium' ELSE 'low' END AS severity,
       metric_value > threshold * 3 AS is_blocking FROM smells)
    SELECT file_path, CASE WHEN bool_or(is_blocking) THEN 'request_changes' WHEN bool_or(severity IN ('medium', 'high')) THEN 'comment' ELSE 'approve' END AS verdict,
      round(greatest(0, 1 - sum(CASE severity WHEN 'high' THEN 0.15 WHEN 'medium' THEN 0.1 ELSE 0.05 END)), 6)::DOUBLE AS score FROM s GROUP BY 1""",
)
def review_score(spark, d):
    v, t = F.col("metric_value"), F.col("threshold")
    s = ag.detect_smells(st.chunk_metrics(spark, d)).select(
        "file_path", F.when(v > t * 2, "high").when(v > t * 1.5, "medium").otherwise("low").alias("severity"), (v > t * 3).alias("is_blocking")
    )
    return ag.review_score(s)


@query(
    "index_stats",
    f"""WITH {st.CHUNKS} SELECT 'total' AS dimension, 'chunks' AS value, count(*) AS n FROM chunks
    UNION ALL SELECT 'total', 'files', count(DISTINCT file_path) FROM chunks
    UNION ALL SELECT 'language', lang, count(*) FROM chunks GROUP BY lang
    UNION ALL SELECT 'file_type', '.md', count(DISTINCT file_path) FROM chunks""",
)
def index_stats(spark, d):
    return ag.index_stats(st.chunks(spark, d))


@query(
    "status_counts",
    f"""WITH {st.CHUNKS}, s AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'complete' ELSE 'error' END AS st FROM chunks)
    SELECT count(*) AS total, count_if(st = 'pending')::BIGINT AS pending, count_if(st = 'processing')::BIGINT AS processing, count_if(st = 'complete')::BIGINT AS complete,
      count_if(st = 'error')::BIGINT AS error, count(DISTINCT file_path) AS files, count(DISTINCT lang) AS languages FROM s""",
)
def status_counts(spark, d):
    k = F.col("doc_id") % 4
    status = F.when(k == 0, "pending").when(k == 1, "processing").when(k == 2, "complete").otherwise("error")
    return ag.status_counts(st.chunks(spark, d).withColumn("embedding_status", status))


@query(
    "dominant_hash",
    """WITH c AS (SELECT source, md5(lang) AS h, count(*) AS n FROM documents GROUP BY ALL)
    SELECT source AS file_path, h AS file_hash, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, h) AS r FROM c) WHERE r = 1""",
)
def dominant_hash(spark, d):
    docs = st.table(spark, d, "documents").select(F.col("source").alias("file_path"), F.md5(F.col("lang").cast("binary")).alias("file_hash"))
    return ag.dominant_hash(docs)


PAGE_PATHS = r"""pp AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS file_path, len(html) AS modified,
   regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS lang FROM pages)"""


def page_paths(spark, d):
    url = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return st.table(spark, d, "pages").select(
        "page_id", url.alias("file_path"), F.length("html").cast("long").alias("modified"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1).alias("lang"), F.lit(1).alias("chunks")
    )


@query(
    "directory_rollup",
    f"""WITH {PAGE_PATHS}, parts AS (SELECT *, string_split(file_path, '/') AS p FROM pp),
    anc AS (SELECT array_to_string(p[1:i], '/') AS directory, array_to_string(p[1:len(p) - 1], '/') AS parent, modified
      FROM (SELECT *, unnest(generate_series(1, len(p) - 1)) AS i FROM parts)),
    s AS (SELECT directory, count(*) AS total_chunks, max(modified) AS last_modified, count_if(directory = parent)::BIGINT AS file_count FROM anc GROUP BY 1)
    SELECT directory, len(string_split(directory, '/'))::INT AS depth, total_chunks, last_modified, file_count,
      (SELECT count(*) FROM s c WHERE len(c.directory) > len(s.directory) AND regexp_replace(c.directory, '/[^/]*$', '') = s.directory) AS subdirectory_count FROM s""",
)
def directory_rollup(spark, d):
    return ag.directory_rollup(page_paths(spark, d))


@query(
    "directory_languages",
    f"""WITH {PAGE_PATHS}, parts AS (SELECT *, string_split(file_path, '/') AS p FROM pp)
    SELECT array_to_string(p[1:i], '/') AS directory, lang AS language, count(*) AS chunks
      FROM (SELECT *, unnest(generate_series(1, len(p) - 1)) AS i FROM parts) GROUP BY ALL""",
)
def directory_languages(spark, d):
    return ag.directory_languages(page_paths(spark, d))


@query(
    "coupling",
    """WITH e AS (SELECT DISTINCT 'part' || l_partkey AS s, 'supp' || l_suppkey AS t FROM lineitem UNION SELECT 'supp' || s_suppkey, 'nation' || s_nationkey FROM supplier),
    b AS (SELECT s AS file, 1 AS ce, 0 AS ca FROM e UNION ALL SELECT t, 0, 1 FROM e),
    g AS (SELECT file, sum(ce)::BIGINT AS efferent, sum(ca)::BIGINT AS afferent FROM b GROUP BY 1), i AS (SELECT *, efferent / (efferent + afferent) AS x FROM g)
    SELECT file, efferent, afferent, round(x, 6) AS instability, CASE WHEN x <= 0.2 THEN 'A' WHEN x <= 0.4 THEN 'B' WHEN x <= 0.6 THEN 'C' WHEN x <= 0.8 THEN 'D' ELSE 'F' END AS grade,
      CASE WHEN x <= 0.3 THEN 'Stable' WHEN x <= 0.7 THEN 'Balanced' ELSE 'Unstable' END AS category FROM i""",
)
def coupling(spark, d):
    li = st.table(spark, d, "lineitem").select(F.concat(F.lit("part"), "l_partkey").alias("file_path"), F.concat(F.lit("supp"), "l_suppkey").alias("module"))
    sn = st.table(spark, d, "supplier").select(F.concat(F.lit("supp"), "s_suppkey").alias("file_path"), F.concat(F.lit("nation"), "s_nationkey").alias("module"))
    return ag.coupling(li.unionByName(sn)).withColumn("instability", F.round("instability", 6))


@query(
    "contributors",
    f"WITH {st.COMMITS} SELECT author, count(*) AS commits, min(ts) AS first_commit, max(ts) AS last_commit FROM commits GROUP BY author",
)
def contributors(spark, d):
    return ag.contributors(st.commits(spark, d))


@query(
    "contributor_top_files",
    f"""WITH {st.COMMITS}, t AS (SELECT author, path, count(*) AS touches FROM cf GROUP BY ALL)
    SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY author ORDER BY touches DESC, path))::INT AS rank FROM t) WHERE rank <= 5""",
)
def contributor_top_files(spark, d):
    return ag.top_files(st.commit_files(spark, d))


@query(
    "commit_density",
    f"WITH {st.COMMITS} SELECT author, ts AS day, count(*) AS commits FROM commits GROUP BY ALL",
)
def commit_density(spark, d):
    return ag.commit_density(st.commits(spark, d), by_author=True)


@query(
    "language_profile",
    """WITH f AS (SELECT CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.md' WHEN 'de' THEN '.js' ELSE '.java' END AS suffix FROM documents),
    g AS (SELECT suffix, count(*) AS files FROM f GROUP BY 1), t AS (SELECT sum(files) AS n, coalesce(sum(files) FILTER (suffix = '.md'), 0) AS md,
      coalesce(sum(files) FILTER (suffix = '.py'), 0) AS py, coalesce(sum(files) FILTER (suffix = '.js'), 0) AS js, coalesce(sum(files) FILTER (suffix = '.java'), 0) AS jv FROM g)
    SELECT suffix, files, round(files / n * 100, 4) AS percent, CASE WHEN n < 1000 THEN 'small' WHEN n < 10000 THEN 'medium' WHEN n < 50000 THEN 'large' ELSE 'enterprise' END AS size,
      CASE WHEN md / n > 0.3 THEN 'documentation' WHEN py / n > 0.6 THEN 'python' WHEN js / n > 0.6 THEN 'javascript' WHEN jv / n > 0.6 THEN 'java' ELSE 'mixed' END AS type FROM g, t""",
)
def language_profile(spark, d):
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".md").when(F.col("lang") == "de", ".js").otherwise(".java")
    return ag.language_profile(st.table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), ext).alias("file_path")))


@query(
    "concept_frequency",
    rf"""WITH {st.FILES}, c AS (
      SELECT doc_id AS chunk_id, unnest(list_concat(list_concat([source, lang], [trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) FOR x IN string_split(regexp_replace(file_path, '\.[^./]+$', ''), '/')]),
        list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: len(w) > 4))) AS concept FROM files),
    m AS (SELECT DISTINCT chunk_id, concept FROM c WHERE len(concept) > 2), f AS (SELECT concept, count(*) AS frequency FROM m GROUP BY 1 HAVING count(*) >= 2)
    SELECT concept, chunk_id, frequency FROM m JOIN f USING (concept)""",
)
def concept_frequency(spark, d):
    base = st.files(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("name"), F.col("lang").alias("parent_name"), "file_path", F.col("text").alias("docstring"))
    return ag.concept_members(base)


@query(
    "audit_summary",
    """WITH v AS (SELECT toxic = 1 AND quality = 0 AS ignored, CASE WHEN quality = 1 AND toxic = 0 THEN 'PASS' WHEN quality = 1 THEN 'MANUAL_REVIEW' ELSE 'INSUFFICIENT_EVIDENCE' END AS s FROM labels)
    SELECT count_if(NOT ignored AND s = 'PASS')::BIGINT AS pass, count_if(NOT ignored AND s = 'FAIL')::BIGINT AS fail, count_if(NOT ignored AND s = 'INSUFFICIENT_EVIDENCE')::BIGINT AS insufficient_evidence,
      count_if(NOT ignored AND s = 'MANUAL_REVIEW')::BIGINT AS manual_review, count_if(ignored)::BIGINT AS ignored, count(*) AS total,
      CASE WHEN bool_or(NOT ignored AND s = 'FAIL') THEN 'FAILED' WHEN bool_or(NOT ignored AND s <> 'PASS') THEN 'CERTIFIED_WITH_EXCEPTIONS' ELSE 'CERTIFIED' END AS overall FROM v""",
)
def audit_summary(spark, d):
    q, t = F.col("quality"), F.col("toxic")
    status = F.when((q == 1) & (t == 0), "PASS").when(q == 1, "MANUAL_REVIEW").otherwise("INSUFFICIENT_EVIDENCE")
    return ag.audit_summary(st.table(spark, d, "labels").select(((t == 1) & (q == 0)).alias("ignored"), status.alias("status")))


SIDE = "sum(cognitive_complexity)::BIGINT AS total_complexity, avg(cognitive_complexity) AS avg_complexity, max(cognitive_complexity) AS max_complexity, count_if(chunk_type = 'function')::BIGINT AS function_count, count_if(chunk_type = 'class')::BIGINT AS class_count"
SIDES = f"""{st.CM}, cur AS (SELECT file_path, {SIDE} FROM cm WHERE side = 'O' GROUP BY 1), bas AS (SELECT file_path, {SIDE} FROM cm WHERE side = 'F' GROUP BY 1)"""


@query(
    "baseline_summary",
    "WITH " + SIDES + " SELECT * FROM " + ", ".join(
        f"""(SELECT count(*) AS total_files_{n}, sum(function_count)::BIGINT AS total_functions_{n}, sum(total_complexity)::BIGINT AS total_complexity_{n},
        round(sum(total_complexity) / count(*), 2) AS avg_complexity_{n}, max(max_complexity) AS max_complexity_{n} FROM {t})""" for n, t in (("current", "cur"), ("baseline", "bas"))
    ),
)
def baseline_summary(spark, d):
    cm = st.chunk_metrics(spark, d)
    return ag.baseline_summary(ag.file_metrics(cm.filter("side = 'O'")), ag.file_metrics(cm.filter("side = 'F'")))


@query(
    "compare_baseline",
    "WITH " + SIDES + ", j AS (SELECT coalesce(c.file_path, b.file_path) AS file_path, c.file_path AS cp, b.file_path AS bp, u.* FROM cur c FULL JOIN bas b ON c.file_path = b.file_path, LATERAL (VALUES "
    + ", ".join(f"('{m}', b.{m}::DOUBLE, c.{m}::DOUBLE)" for m in hi.BASELINE_METRICS)
    + """) u(metric, baseline_value, current_value)),
    p AS (SELECT *, current_value - baseline_value AS delta, CASE WHEN baseline_value = 0 THEN CASE WHEN current_value > 0 THEN 100.0 WHEN current_value < 0 THEN -100.0 ELSE 0.0 END
            ELSE (current_value - baseline_value) / baseline_value * 100 END AS pct FROM j),
    k AS (SELECT *, CASE WHEN abs(pct) < 5 OR metric LIKE '%count' THEN 'neutral' WHEN delta > 0 THEN 'regression' WHEN delta < 0 THEN 'improvement' ELSE 'neutral' END AS class FROM p),
    v AS (SELECT file_path, bool_or(class = 'regression') AS reg, bool_or(class = 'improvement') AS imp FROM k GROUP BY 1)
    SELECT file_path, CASE WHEN bp IS NULL THEN 'new' WHEN cp IS NULL THEN 'deleted' WHEN reg THEN 'regression' WHEN imp THEN 'improvement' ELSE 'unchanged' END AS verdict,
      metric, round(baseline_value, 6) AS baseline_value, round(current_value, 6) AS current_value, round(delta, 6) AS delta, round(pct, 4)::DOUBLE AS delta_percent, class FROM k JOIN v USING (file_path)""",
)
def compare_baseline(spark, d):
    cm = st.chunk_metrics(spark, d)
    out = hi.compare_baseline(ag.file_metrics(cm.filter("side = 'O'")), ag.file_metrics(cm.filter("side = 'F'")))
    for c in ("baseline_value", "current_value", "delta"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("trend_metrics", f"WITH {st.SNAPSHOTS} SELECT * REPLACE (round(avg_complexity, 6) AS avg_complexity) FROM snap")
def trend_metrics(spark, d):
    return st.snapshots(spark, d).withColumn("avg_complexity", F.round("avg_complexity", 6))


@query(
    "file_history",
    f"""WITH {st.CM}, m AS (SELECT file_path, ts, count(*) AS chunks, max(cognitive_complexity) AS max_complexity FROM cm GROUP BY ALL)
    SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY file_path ORDER BY ts DESC))::INT AS rank FROM m) WHERE rank <= 3""",
)
def file_history(spark, d):
    rows = st.chunk_metrics(spark, d).groupBy("file_path", "ts").agg(F.count("*").alias("chunks"), F.max("cognitive_complexity").alias("max_complexity"))
    return hi.file_history(rows, 3)


@query(
    "project_history",
    f"""WITH {st.SNAPSHOTS} SELECT project, ts, total_chunks, rank FROM (SELECT *, (row_number() OVER (PARTITION BY project ORDER BY ts DESC))::INT AS rank FROM snap) WHERE rank <= 10""",
)
def project_history(spark, d):
    return hi.project_history(st.snapshots(spark, d)).select("project", "ts", "total_chunks", "rank")


@query(
    "trend_change_rate",
    f"""WITH {st.SNAPSHOTS}, r AS (SELECT * FROM snap WHERE ts >= DATE '2001-12-01' - 365 AND ts <= DATE '2001-12-01'),
    e AS (SELECT project, count(*) AS snapshots, date_diff('day', min(ts), max(ts)) AS span, arg_max(avg_complexity, ts) - arg_min(avg_complexity, ts) AS delta FROM r GROUP BY 1)
    SELECT project, snapshots, round(CASE WHEN snapshots >= 2 AND span > 0 THEN delta / span ELSE 0 END, 6) AS change_rate FROM e""",
)
def trend_change_rate(spark, d):
    return hi.trend_change_rate(st.snapshots(spark, d), F.lit("2001-12-01").cast("date"), 365)


TREND_METRICS = {"avg_complexity": True, "total_smells": True, "health": False, "total_lines": False}


@query(
    "trend_direction",
    f"WITH {st.SNAPSHOTS}, u AS (" + " UNION ALL ".join(
        f"SELECT project, '{m}' AS metric, {lower} AS lower, count(*) AS n, arg_min({m}, ts)::DOUBLE AS a, arg_max({m}, ts)::DOUBLE AS b FROM snap GROUP BY project" for m, lower in TREND_METRICS.items()
    ) + """), c AS (SELECT *, CASE WHEN a = 0 THEN CASE WHEN b > 0 THEN 1.0 ELSE 0.0 END ELSE abs(b - a) / a END AS ch FROM u)
    SELECT project, metric, CASE WHEN n < 2 OR ch < 0.05 THEN 'stable' WHEN (lower AND b < a) OR (NOT lower AND b > a) THEN 'improving' ELSE 'worsening' END AS direction FROM c""",
)
def trend_direction(spark, d):
    return hi.trend_direction(st.snapshots(spark, d), TREND_METRICS)


@query(
    "regression_alerts",
    f"WITH {st.SNAPSHOTS}, u AS (" + " UNION ALL ".join(
        f"SELECT project, '{m}' AS metric, {s} AS s, arg_min({m}, ts)::DOUBLE AS old_value, arg_max({m}, ts)::DOUBLE AS new_value FROM snap GROUP BY project HAVING count(*) >= 2"
        for m, s in (("avg_complexity", 1), ("total_smells", 1), ("health", -1))
    ) + """), c AS (SELECT *, CASE WHEN old_value = 0 THEN CASE WHEN new_value > 0 THEN 100.0 ELSE 0.0 END ELSE (new_value - old_value) / old_value * 100 END AS ch FROM u)
    SELECT project, metric, round(old_value, 6) AS old_value, round(new_value, 6) AS new_value, round(ch, 4)::DOUBLE AS change_percent, CASE WHEN ch * s > 5 THEN 'regression' ELSE 'improvement' END AS kind
    FROM c WHERE abs(ch) > 5 AND (metric <> 'health' OR old_value > 0)""",
)
def regression_alerts(spark, d):
    out = hi.regression_alerts(st.snapshots(spark, d))
    return out.withColumn("old_value", F.round("old_value", 6)).withColumn("new_value", F.round("new_value", 6))


PHASES = f"""{st.COMMITS}, n AS (SELECT count(*) AS n, CASE WHEN date_diff('day', min(ts), max(ts)) < 30 THEN 1 WHEN date_diff('day', min(ts), max(ts)) < 180 THEN 2
      ELSE least(5, greatest(3, date_diff('day', min(ts), max(ts)) // 90)) END AS k FROM commits),
    ph AS (SELECT commits.*, least((row_number() OVER (ORDER BY ts, sha) - 1) // (n // k), k - 1)::INT AS phase FROM commits, n)"""


@query("evolution_phases", f"WITH {PHASES} SELECT sha, phase FROM ph")
def evolution_phases(spark, d):
    return hi.evolution_phases(st.commits(spark, d)).select("sha", "phase")


@query(
    "phase_summary",
    f"""WITH {PHASES}, s AS (SELECT phase, count(*) AS commits, min(ts) AS date_start, max(ts) AS date_end FROM ph GROUP BY 1),
    t AS (SELECT phase, sha, files_changed, (row_number() OVER (PARTITION BY phase ORDER BY files_changed DESC, sha))::INT AS rank FROM ph)
    SELECT * FROM t JOIN s USING (phase) WHERE rank <= 5""",
)
def phase_summary(spark, d):
    return hi.phase_summary(hi.evolution_phases(st.commits(spark, d)))


@query(
    "phase_top_files",
    f"""WITH {PHASES}, t AS (SELECT phase, path, count(*) AS touches FROM ph JOIN cf USING (sha) GROUP BY ALL)
    SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY phase ORDER BY touches DESC, path))::INT AS rank FROM t) WHERE rank <= 5""",
)
def phase_top_files(spark, d):
    phased = hi.evolution_phases(st.commits(spark, d)).select("sha", "phase")
    return ag.top_files(st.commit_files(spark, d).select("sha", "path").join(phased, "sha"), "phase")


@query(
    "timeline_events",
    f"""WITH {st.COMMITS} SELECT * FROM (SELECT ts AS date, 'commit' AS event_type, sha::VARCHAR AS ref, least(files_changed / 20, 1.0)::DOUBLE AS importance FROM commits ORDER BY files_changed DESC, sha LIMIT 10)
    UNION ALL SELECT ts::DATE, 'issue_opened', event_id::VARCHAR, 0.6 FROM (SELECT * FROM events WHERE event_type = 'error')
    UNION ALL SELECT ts::DATE + 7, 'issue_closed', event_id::VARCHAR, 0.5 FROM (SELECT * FROM events WHERE event_type = 'error') WHERE value > 5
    UNION ALL SELECT ts::DATE, 'merge', event_id::VARCHAR, least(floor(value) / 15, 1.0) FROM (SELECT * FROM events WHERE event_type = 'purchase')""",
)
def timeline_events(spark, d):
    ev = st.table(spark, d, "events")
    issues = ev.filter("event_type = 'error'").select(
        F.col("event_id").alias("number"), F.to_date("ts").alias("created_at"), F.when(F.col("value") > 5, F.date_add(F.to_date("ts"), 7)).alias("closed_at")
    )
    pulls = ev.filter("event_type = 'purchase'").select(F.col("event_id").alias("number"), F.to_date("ts").alias("merged_at"), F.floor("value").alias("files_changed"))
    return hi.timeline_events(st.commits(spark, d), issues, pulls)


@query("entity_history", "SELECT DISTINCT p_name AS name, p_brand AS file_path, p_type AS commit FROM part")
def entity_history(spark, d):
    return hi.entity_history(st.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.col("p_type").alias("commit")))


@query(
    "blame_latest",
    """WITH b AS (SELECT 'p' || (l_partkey % 97) AS file_path, l_orderkey // 10 AS line, l_suppkey AS author, l_shipdate::DATE AS ts, l_orderkey AS commit FROM lineitem),
    r AS (SELECT 'p' || (p_partkey % 97) AS file_path, p_partkey // 2 AS start_line, p_partkey // 2 + p_size AS end_line FROM part)
    SELECT file_path, start_line, end_line, max(struct_pack(ts := ts, author := author, commit := commit)).ts AS ts, max(struct_pack(ts := ts, author := author, commit := commit)).author AS author,
      max(struct_pack(ts := ts, author := author, commit := commit)).commit AS commit FROM r JOIN b USING (file_path) WHERE line BETWEEN start_line AND end_line GROUP BY ALL""",
)
def blame_latest(spark, d):
    b = st.table(spark, d, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey") % 97).alias("file_path"), F.floor(F.col("l_orderkey") / 10).alias("line"), F.col("l_suppkey").alias("author"),
        F.to_date("l_shipdate").alias("ts"), F.col("l_orderkey").alias("commit"),
    )
    half = F.floor(F.col("p_partkey") / 2)
    r = st.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey") % 97).alias("file_path"), half.alias("start_line"), (half + F.col("p_size")).alias("end_line"))
    return hi.blame_latest(r, b)


@query(
    "latest_drift",
    """WITH a AS (SELECT o_custkey AS target, o_orderdate::DATE AS ts, o_orderkey AS c, o_orderpriority AS p FROM orders),
    l AS (SELECT target, max(struct_pack(ts := ts, c := c, p := p)) AS m FROM a GROUP BY 1),
    cur AS (SELECT c_custkey AS target, '1-URGENT' AS cp, c_custkey AS cc FROM customer)
    SELECT target, coalesce(cp <> m.p, false) AS policy_changed, coalesce(cc <> m.c, false) AS code_changed, m IS NULL OR cp <> m.p OR cc <> m.c AS has_drift,
      date_diff('day', m.ts, DATE '2002-01-01')::INT AS days_since FROM cur LEFT JOIN l USING (target)""",
)
def latest_drift(spark, d):
    a = st.table(spark, d, "orders").select(
        F.col("o_custkey").alias("target"), F.to_date("o_orderdate").alias("ts"), F.col("o_orderkey").alias("commit_sha"), F.col("o_orderpriority").alias("policy_sha256")
    )
    cur = st.table(spark, d, "customer").select(F.col("c_custkey").alias("target"), F.lit("1-URGENT").alias("current_policy"), F.col("c_custkey").alias("current_commit"))
    return hi.latest_drift(a, cur, F.lit("2002-01-01").cast("date"))
