"""Cutting texts into chunks and describing chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as tx

# Window length and overlap in lines, size from which a block of lines makes a text one of paragraphs, and merge target in characters.
WINDOW_LINES = 30
WINDOW_OVERLAP = 4
MIN_PARAGRAPH = 20
MERGE_LIMIT = 400


def line_windows(df: DataFrame, text: str = "text", size: int = WINDOW_LINES, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """One row per overlapping line window: content, start_line, end_line (1-based)."""
    overlap = max(0, min(overlap, size - 1))
    stride = size - overlap
    total = F.size("_lines")
    last = F.greatest(F.lit(0), F.ceil((total - size) / F.lit(stride)).cast("int"))
    out = (
        df.withColumn("_lines", tx.lines(F.col(text)))
        .withColumn("_w", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("start_line", F.col("_w") * stride + 1)
        .withColumn("end_line", F.least(F.col("_w") * stride + size, total))
        .withColumn("content", F.array_join(F.slice("_lines", F.col("start_line"), F.lit(size)), "\n"))
    )
    return out.filter(F.col("content").rlike(r"\S")).drop("_lines", "_w")


_PARAGRAPH = "struct<content:string,start_line:int,end_line:int>"


def paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    """Paragraph chunks of each text: lines up to a blank one, neighbours joined while they stay below MERGE_LIMIT characters.

    One pass over a text's lines as a Column: the open paragraph's lines, the chunk that may still grow, and the finished ones.
    """
    none = F.lit(None).cast(_PARAGRAPH)
    state = F.struct(F.array().cast(f"array<{_PARAGRAPH}>").alias("done"), none.alias("last"), F.array().cast("array<string>").alias("run"), F.lit(0).alias("line"))

    def chunk(content: Column, start: Column, end: Column) -> Column:
        return F.struct(content.alias("content"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))

    def step(s: Column, row: Column) -> Column:
        line = s["line"] + 1
        filled = F.coalesce(row.rlike(r"\S"), F.lit(False))
        body = F.concat(F.array_join(s["run"], "\n"), F.lit("\n"))
        closes = ~filled & (F.size(s["run"]) > 0)
        joins_ = s["last"].isNotNull() & (F.length(s["last"]["content"]) + F.length(body) < MERGE_LIMIT)
        joined = chunk(F.concat(s["last"]["content"], F.lit("\n"), body), s["last"]["start_line"], line - 1)
        alone = chunk(body, line - F.size(s["run"]), line - 1)
        done = F.when(closes & ~joins_ & s["last"].isNotNull(), F.concat(s["done"], F.array(s["last"]))).otherwise(s["done"])
        last = F.when(closes & joins_, joined).when(closes, alone).otherwise(s["last"])
        run = F.when(filled, F.concat(s["run"], F.array(row))).otherwise(F.array().cast("array<string>"))
        return F.struct(done.alias("done"), last.alias("last"), run.alias("run"), line.cast("int").alias("line"))

    ended = F.concat(tx.lines(F.col(text)), F.array(F.lit("")))
    found = F.aggregate(ended, state, step, lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))))
    return df.withColumn("_c", F.explode(found)).select(*df.columns, "_c.content", "_c.start_line", "_c.end_line")


def chunk_text(df: DataFrame, text: str = "text", path: str = "file_path", mode: str = "auto") -> DataFrame:
    """Chunks of a text table.

    ``auto``: paragraphs where a text has any, line windows otherwise;
    ``lines`` / ``paragraphs`` force one of them. Adds chunk_id, chunk_type,
    content, start_line, end_line; the text column itself is dropped.
    """
    if mode == "lines":
        out = line_windows(df, text)
    elif mode == "paragraphs":
        out = paragraphs(df, text)
    else:
        sizes = F.transform(F.split(text, r"\n[ \t]*\n"), lambda p: F.length(F.trim(p)))
        has = F.exists(sizes, lambda n: n > MIN_PARAGRAPH)
        out = paragraphs(df.filter(has), text).unionByName(line_windows(df.filter(~has), text))
    cid = tx.chunk_id(
        F.col(path), F.lit("text"), F.lit(None).cast("string"), F.col("start_line"), F.col("end_line"), F.col("content")
    )
    return out.drop(text).withColumn("chunk_type", F.lit("text")).withColumn("chunk_id", cid)


def contextual_text(
    content: Column,
    file_path: Column | None = None,
    language: Column | None = None,
    class_name: Column | None = None,
    function_name: Column | None = None,
    imports: Column | None = None,
    docstring: Column | None = None,
    max_imports: int | None = None,
    max_summary: int | None = None,
) -> Column:
    """Content under a one-line header ``File: … | Lang: … | Class: … | Fn: … | Uses: … | Desc: …``; all imports and the whole summary unless limited."""
    parts = []
    if file_path is not None:
        seg = F.split(file_path, "/")
        short = F.when(F.size(seg) > 2, F.array_join(F.slice(seg, -2, 2), "/")).otherwise(file_path)
        parts.append(F.when(~file_path.isin("", ".", "/"), F.concat(F.lit("File: "), short)))
    if language is not None:
        parts.append(F.when(~language.isin("", "text", "unknown"), F.concat(F.lit("Lang: "), language)))
    if class_name is not None:
        parts.append(F.when(class_name != "", F.concat(F.lit("Class: "), class_name)))
    if function_name is not None:
        parts.append(F.when(function_name != "", F.concat(F.lit("Fn: "), function_name)))
    if imports is not None:
        parts.append(F.when(F.size(imports) > 0, F.concat(F.lit("Uses: "), F.array_join(_first(imports, max_imports), ", "))))
    if docstring is not None:
        parts.append(F.when(F.trim(docstring) != "", F.concat(F.lit("Desc: "), summary_line(docstring, max_summary))))
    header = F.concat_ws(" | ", *parts)
    return F.when(header != "", F.concat(header, F.lit("\n---\n"), content)).otherwise(content)


def bracket_text(
    content: Column,
    class_name: Column | None = None,
    imports: Column | None = None,
    docstring: Column | None = None,
    calls: Column | None = None,
    max_names: int | None = None,
    max_summary: int | None = None,
) -> Column:
    """The bracket form: ``[class …]``, ``[imports: …]``, summary, ``[calls: …]``, content on lines of their own; all names and the whole summary unless limited."""
    listed = lambda c: F.array_join(_first(c, max_names), ", ")
    parts = []
    if class_name is not None:
        parts.append(F.when(class_name != "", F.format_string("[class %s]", class_name)))
    if imports is not None:
        parts.append(F.when(F.size(imports) > 0, F.format_string("[imports: %s]", listed(imports))))
    if docstring is not None:
        parts.append(F.when(F.trim(docstring) != "", summary_line(docstring, max_summary)))
    if calls is not None:
        parts.append(F.when(F.size(calls) > 0, F.format_string("[calls: %s]", listed(calls))))
    return F.concat_ws("\n", *parts, content)


def _first(values: Column, n: int | None) -> Column:
    return values if n is None else F.slice(values, 1, n)


def summary_line(docstring: Column, limit: int | None = None) -> Column:
    """A docstring without blanks around it, cut after ``limit`` characters."""
    body = F.trim(docstring)
    if limit is None:
        return body
    cut = F.concat(F.rtrim(F.substring(body, 1, limit)), F.lit("..."))
    return F.when(F.length(body) > limit, cut).otherwise(body)


def chunk_hierarchy(chunks: DataFrame) -> DataFrame:
    """Parent and depth per chunk: a method's parent is its class in the same file,
    any other non-module chunk hangs below the file's module chunk.

    Child lists are the inverse of this table (``groupBy(parent_id)``), kept as rows.
    """
    classes = (
        chunks.filter(F.col("chunk_type") == "class")
        .groupBy("file_path", F.col("class_name").alias("_class"))
        .agg(F.min("chunk_id").alias("_class_id"))
    )
    modules = (
        chunks.filter(F.col("chunk_type").isin("module", "imports"))
        .groupBy("file_path")
        .agg(F.min("chunk_id").alias("_module_id"))
    )
    is_method = F.col("chunk_type") == "method"
    out = (
        chunks.withColumn("_class", F.when(is_method, F.col("class_name")))
        .join(classes, ["file_path", "_class"], "left")
        .join(modules, "file_path", "left")
    )
    is_module = F.col("chunk_type").isin("module", "imports")
    parent = F.when(is_module, F.lit(None)).otherwise(F.coalesce("_class_id", "_module_id"))
    depth = F.when(is_module, 0).when(F.col("_class_id").isNotNull(), 2).otherwise(1)
    return out.select(*chunks.columns, parent.alias("parent_id"), depth.alias("depth"))
