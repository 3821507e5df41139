"""Combining and re-scoring ranked lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions import metrics as mx
from siftwell.functions import queries as qx
from siftwell.functions import text as tx
from siftwell.runtime import fixed_table

# Rank-fusion constant, chunk-type factors and the types they apply to.
RRF_K = 60
TYPE_BOOST = 1.15
TYPE_DAMPEN = 0.90
TEXT_TYPES = ["docstring", "comment", "text", "module"]
CODE_TYPES = ["function", "method", "class", "code", "class_method", "interface", "mixin", "constructor", "widget"]
SOURCE_BOOST = 1.15

# Weights of the final ranker.
EXACT_NAME = 0.15
PARTIAL_NAME = 0.05
FILE_EXACT = 0.08
FILE_PARTIAL = 0.03
FUNCTION_CHUNK = 0.05
CLASS_CHUNK = 0.03
SOURCE_FILE = 0.02
SHALLOW_PATH = 0.02
TEST_FILE = -0.02
DEEP_PATH = -0.01
BOILERPLATE = -0.15
KEYWORD_MATCH = 0.02
CODE_REF_MATCH = 0.03
TERM_MATCH = 0.02
SOURCE_SUFFIXES = [".py", ".js", ".ts", ".java", ".cpp", ".c", ".go", ".rs"]

# Names that every program of a language has.
BOILERPLATE_NAMES = {
    "python": [
        "__init__", "__str__", "__repr__", "__eq__", "__hash__", "__len__", "__iter__", "__next__", "__enter__", "__exit__",
        "main", "setUp", "tearDown", "setUpClass", "tearDownClass",
    ],
    "javascript": [
        "constructor", "render", "componentDidMount", "componentWillUnmount", "componentDidUpdate", "useState", "useEffect",
        "index", "main", "default",
    ],
    "typescript": [
        "constructor", "render", "componentDidMount", "componentWillUnmount", "componentDidUpdate", "useState", "useEffect",
        "index", "main", "default",
    ],
    "jsx": [
        "constructor", "render", "componentDidMount", "componentWillUnmount", "componentDidUpdate", "useState", "useEffect",
        "index", "main", "default",
    ],
    "tsx": [
        "constructor", "render", "componentDidMount", "componentWillUnmount", "componentDidUpdate", "useState", "useEffect",
        "index", "main", "default",
    ],
    "dart": ["build", "dispose", "initState", "didChangeDependencies", "main", "createState"],
    "php": ["__construct", "__destruct", "__toString", "__get", "__set", "__call", "__callStatic", "index", "main"],
    "ruby": ["initialize", "to_s", "to_h", "to_a", "inspect", "main", "setup", "teardown"],
}


def _rank_window(score: str, id_col: str):
    return Window.partitionBy("query_id").orderBy(F.col(score).desc(), id_col)


def hybrid_rrf(vector_hits: DataFrame, text_hits: DataFrame, alpha: Column | float = 0.7, chunk_type: Column | None = None, natural_language: Column | None = None, id_col: str = "chunk_id") -> DataFrame:
    """Weighted reciprocal-rank fusion of a vector and a text list, scaled so the best of a query is 1.

    ``alpha`` (and the two optional columns) may be columns of either hit table;
    with both given, chunks of the matching type gain and others lose.
    """
    v = vector_hits.withColumnRenamed("rank", "_rv")
    b = text_hits.withColumnRenamed("rank", "_rb")
    keys = ["query_id", id_col]
    joined = v.join(b, keys, "full_outer")
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    raw = F.coalesce(a / (RRF_K + F.col("_rv")), F.lit(0.0)) + F.coalesce((1 - a) / (RRF_K + F.col("_rb")), F.lit(0.0))
    if chunk_type is not None and natural_language is not None:
        is_text, is_code = chunk_type.isin(TEXT_TYPES), chunk_type.isin(CODE_TYPES)
        fits = (natural_language & is_text) | (~natural_language & is_code)
        raw = raw * F.when(fits, TYPE_BOOST).when(is_text | is_code, TYPE_DAMPEN).otherwise(1.0)
    out = joined.withColumn("_raw", raw)
    top = F.max("_raw").over(Window.partitionBy("query_id"))
    return (
        out.withColumn("score", F.round(F.when(top > 0, F.col("_raw") / top).otherwise(0.0), 8))
        .withColumn("rank", F.row_number().over(_rank_window("score", id_col)))
        .select(*keys, "score", "rank")
    )


def rrf_three_way(lists: dict[str, DataFrame]) -> DataFrame:
    """Fuse named lists (query_id, file_path, start_line, content, rank) by place.

    Score Σ 1/(60 + rank), the longest content is kept, files below ``src/`` gain 15 %.
    """
    rows = None
    for name, df in lists.items():
        part = df.select("query_id", "file_path", "start_line", "content", (1 / (RRF_K + F.col("rank"))).alias("_s"), F.lit(name).alias("_list"))
        rows = part if rows is None else rows.unionByName(part)
    path = F.col("file_path")
    boost = F.when(F.contains(path, F.lit("/src/")) | F.startswith(path, F.lit("src/")), SOURCE_BOOST).otherwise(1.0)
    out = rows.groupBy("query_id", "file_path", "start_line").agg(
        F.sum("_s").alias("_sum"),
        F.max_by("content", F.length("content")).alias("content"),
        F.array_join(F.sort_array(F.collect_set("_list")), ",").alias("strategies"),
    )
    return out.withColumn("score", F.round(F.col("_sum") * boost, 6)).drop("_sum")


def boilerplate_table(spark) -> DataFrame:
    rows = [(lang, n) for lang, names in BOILERPLATE_NAMES.items() for n in names]
    return fixed_table(spark, rows, "language string, function_name string")


def boilerplate_penalty(hits: DataFrame, query: str = "query_text", name: str = "function_name", language: str = "language", penalty: float = BOILERPLATE) -> DataFrame:
    """Adds ``boilerplate``: the penalty for a name common in its language unless the query holds the name."""
    table = boilerplate_table(hits.sparkSession).select(
        F.col("language").alias("_lang"), F.col("function_name").alias("_name"), F.lit(True).alias("_common")
    )
    asked = F.contains(F.lower(query), F.lower(name))
    out = hits.join(F.broadcast(table), (F.lower(language) == F.col("_lang")) & (F.col(name) == F.col("_name")), "left")
    value = F.when(F.col("_common") & ~asked, penalty).otherwise(0.0)
    return out.withColumn("boilerplate", F.coalesce(value, F.lit(0.0))).drop("_lang", "_name", "_common")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it stands in ``use``: Spark computes what stands in a lambda for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(query_words: Column, value: Column) -> Column:
    return _once(value, lambda v: F.size(F.filter(query_words, lambda w: F.contains(v, w))))


def _name_boost(name: Column, query: Column, query_words: Column) -> Column:
    low = F.lower(name)
    exact = F.when(F.contains(low, query), EXACT_NAME).otherwise(0.0)
    return F.when(F.coalesce(name, F.lit("")) != "", exact + PARTIAL_NAME * _matches(query_words, low)).otherwise(0.0)


def _list_boost(values: Column, query_words: Column, each: float) -> Column:
    holds = lambda low, words: F.exists(words, lambda w: F.contains(low, w))
    hit = _once(query_words, lambda words: F.size(F.filter(values, lambda v: _once(F.lower(v), lambda low: holds(low, words)))))
    return F.coalesce(hit * each, F.lit(0.0))


def rank_features(hits: DataFrame, query: str = "query_text", score: str = "score", id_col: str = "chunk_id", keywords: str | None = None, code_refs: str | None = None, technical_terms: str | None = None) -> DataFrame:
    """Final ranker: name, file, content, kind, suffix, test, depth and boilerplate terms, clamped to 0–1.

    Needs query_id, file_path, content, chunk_type, language, function_name, class_name.
    All terms are Column arithmetic on the hit row; only the rank shuffles.
    """
    q = F.lower(query)
    qw = F.array_distinct(tx.words(F.col(query)))
    file_name = F.lower(tx.basename(F.col("file_path")))
    depth = F.size(F.split("file_path", "/"))
    found = _matches(qw, F.lower("content"))
    terms = [
        F.col(score),
        _name_boost(F.col("function_name"), q, qw),
        _name_boost(F.col("class_name"), q, qw),
        F.when(F.contains(file_name, q), FILE_EXACT).otherwise(0.0) + FILE_PARTIAL * _matches(qw, file_name),
        _once(found, lambda n: F.when(n > 0, n / F.size(qw) * 0.1).otherwise(0.0)),
        F.when(F.col("chunk_type") == "function", FUNCTION_CHUNK).when(F.col("chunk_type") == "class", CLASS_CHUNK).otherwise(0.0),
        F.when(tx.suffix(F.col("file_path")).isin(SOURCE_SUFFIXES), SOURCE_FILE).otherwise(0.0),
        F.when(F.contains(file_name, F.lit("test")), TEST_FILE).otherwise(0.0),
        F.when(depth <= 3, SHALLOW_PATH).when(depth > 5, DEEP_PATH).otherwise(0.0),
        F.col("boilerplate"),
    ]
    for col, each in ((keywords, KEYWORD_MATCH), (code_refs, CODE_REF_MATCH), (technical_terms, TERM_MATCH)):
        if col is not None:
            terms.append(_list_boost(F.col(col), qw, each))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    out = boilerplate_penalty(hits, query).withColumn(score, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6))
    return out.drop("boilerplate").withColumn("rank", F.row_number().over(_rank_window(score, id_col)))


def quality_rerank(hits: DataFrame, weight: float = 0.3, score: str = "score", id_col: str = "chunk_id") -> DataFrame:
    """(1 - w)·score + w·quality/100 where a quality (stored or from grade and smells) is known."""
    quality = F.coalesce(F.col("quality_score"), mx.quality_score(F.col("complexity_grade"), F.col("smell_count")))
    mixed = F.when(quality.isNotNull(), (1 - weight) * F.col(score) + weight * quality / 100).otherwise(F.col(score))
    return hits.withColumn(score, F.round(mixed, 6)).withColumn("rank", F.row_number().over(_rank_window(score, id_col)))


def kg_boost(hits: DataFrame, edges: DataFrame, nodes: DataFrame, queries: DataFrame, score: str = "score", id_col: str = "chunk_id") -> DataFrame:
    """+0.02 per neighbouring entity whose name holds a query word, at most 1.

    Neighbour matches are counted per (query, chunk) with partial sums, so a hub
    with a third of all edges only adds to counters.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    asked = queries.select("query_id", F.array_distinct(tx.words(F.col("text"))).alias("_qw"))
    near = (
        hits.select("query_id", id_col).join(both, F.col(id_col) == F.col("src")).filter(F.col("src") != F.col("dst"))
        .join(nodes.select(F.col("id").alias("dst"), F.lower("name").alias("_name")), "dst")
        .join(asked, "query_id")
        .filter(F.exists("_qw", lambda w: F.contains(F.col("_name"), w)))
        .groupBy("query_id", id_col).agg(F.count("*").alias("related"))
    )
    out = hits.join(near, ["query_id", id_col], "left").withColumn("related", F.coalesce("related", F.lit(0)))
    return out.withColumn(score, F.round(F.least(F.lit(1.0), F.col(score) + 0.02 * F.col("related")), 6))


def context_boost(hits: DataFrame, context: DataFrame, score: str = "score") -> DataFrame:
    """+0.1 for a hit in a context file, +0.05 each when its function or class name occurs in a context text.

    All names are looked up in the distinct blank-separated words of the texts in one pass.
    """
    from siftwell.operators.names import substring_pairs

    in_file = context.select("file_path").distinct().withColumn("_in", F.lit(True))
    vocabulary = context.select(F.explode(F.array_distinct(tx.words(F.col("text")))).alias("text")).distinct().select(F.col("text").alias("text_id"), "text")
    asked = hits.select(F.explode(F.array(F.lower("function_name"), F.lower("class_name"))).alias("needle")).filter(F.col("needle") != "").distinct()
    vocabulary = substring_pairs(vocabulary, asked).select(F.col("needle").alias("_w")).distinct()
    out = hits.join(in_file, "file_path", "left")
    for name in ("function_name", "class_name"):
        flag = vocabulary.select(F.col("_w").alias(f"_{name}"))
        out = out.join(flag, F.lower(name) == F.col(f"_{name}"), "left")
    bonus = (
        F.when(F.col("_in"), 0.1).otherwise(0.0)
        + F.when(F.col("_function_name").isNotNull(), 0.05).otherwise(0.0)
        + F.when(F.col("_class_name").isNotNull(), 0.05).otherwise(0.0)
    )
    return out.withColumn(score, F.round(F.least(F.lit(1.0), F.col(score) + bonus), 6)).drop("_in", "_function_name", "_class_name")


def context_lines(hits: DataFrame, files: DataFrame, n: int = 3) -> DataFrame:
    """The n lines before and after each hit, from a join with the file texts."""
    ls = F.col("_lines")
    start, end = F.col("start_line"), F.col("end_line")
    first = F.greatest(F.lit(1), start - n)
    return (
        hits.join(files.select("file_path", tx.lines(F.col("text")).alias("_lines")), "file_path", "left")
        .withColumn("context_before", F.transform(F.slice(ls, first, start - first), lambda x: F.rtrim(x)))
        .withColumn("context_after", F.transform(F.slice(ls, end + 1, n), lambda x: F.rtrim(x)))
        .drop("_lines")
    )


def suggest_queries(hits: DataFrame, queries: DataFrame, n: int = 5, per_kind: int = 3, best_files: int = 5) -> DataFrame:
    """(query_id, suggestion, place): up to ``n`` follow-ups per query that it does not hold already.

    With hits: ``per_kind`` function names, class names and parts of the
    file names of the ``best_files`` best hits each, in name order. Without: related terms.
    Only that many values per query and kind ever meet.
    """
    five = hits.filter(F.col("rank") <= best_files)
    stem = F.regexp_replace(tx.basename(F.col("file_path")), r"(?<=.)\.[^.]*$", "")
    kinds = [
        (0, hits.select("query_id", F.col("function_name").alias("suggestion"))),
        (1, hits.select("query_id", F.col("class_name").alias("suggestion"))),
        (2, five.select("query_id", F.explode(F.split(stem, "_")).alias("suggestion"))),
    ]
    first = Window.partitionBy("query_id", "kind").orderBy("suggestion")
    rows = None
    for kind, df in kinds:
        part = df.filter(F.coalesce("suggestion", F.lit("")) != "").distinct().withColumn("kind", F.lit(kind))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= per_kind)
    found = hits.select("query_id").distinct()
    alone = queries.join(found, "query_id", "left_anti").select(
        "query_id", F.posexplode(qx.suggest_without_results(F.col("text"))).alias("_r", "suggestion")
    ).withColumn("kind", F.lit(0))
    every = rows.unionByName(alone.select(*rows.columns)).join(queries.select("query_id", tx.words(F.col("text")).alias("_w")), "query_id")
    every = every.filter(~F.array_contains("_w", F.lower("suggestion")))
    best = every.groupBy("query_id", "suggestion").agg(F.min(F.struct("kind", "_r")).alias("_o"))
    w = Window.partitionBy("query_id").orderBy("_o", "suggestion")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("query_id", "suggestion", "place")
