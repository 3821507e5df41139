"""Entity graph: building, hop loops, trees, cycles, components.

Tables: nodes(id, kind, name, file_path, …) and edges(src, dst, rel, …). Every
hop is one join for all start nodes at once; loop state is checkpointed per
round, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count as count_up

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions import text as tx
from siftwell.operators.names import substring_pairs
from siftwell.runtime import cut_lineage, drop_written, fixed_table, number_in_group, running

# Names too common to stand for an entity, and those never matched by substring in a look-up.
GENERIC_ENTITIES = [
    "main", "run", "test", "get", "set", "init", "__init__", "__main__", "setup", "config", "name", "value", "data", "result",
    "results", "item", "items", "key", "keys", "args", "kwargs", "self", "cls", "a", "b", "c", "d", "e", "f", "i", "j", "k", "n",
    "x", "y", "z", "id", "db", "fn", "cb", "err", "msg", "req", "res", "ctx", "env", "add", "delete", "remove", "update",
    "create", "read", "write", "load", "save", "parse", "process", "handle", "execute", "file", "path", "module", "class",
    "function", "method", "list", "dict", "string", "int", "bool", "none", "tests", "fixture", "mock",
]
GENERIC_LOOKUPS = [
    "search", "main", "test", "config", "get", "set", "run", "init", "data", "name", "value", "key", "add", "delete", "update",
    "create", "read", "write", "load", "save", "process", "handle",
]

# File suffix to language.
SUFFIX_LANGUAGE = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".rs": "rust", ".go": "go", ".java": "java", ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp", ".cc": "cpp",
    ".cxx": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
    ".r": "r", ".m": "objective-c", ".lua": "lua", ".pl": "perl", ".sh": "shell", ".bash": "shell", ".zsh": "shell",
}

LCA_WEIGHT = 0.15
# Rounds after which the tables of a loop are written as one, so that plans stay of bounded size.
FOLD_ROUNDS = 6
# Rows of a line up to which it is walked by doubled jumps; a longer one is shortened first.
LINE_ROWS = 500_000


# ---------------------------------------------------------------- building


def is_generic(name: Column) -> Column:
    return (
        name.isNull() | (F.length(name) <= 2) | F.lower(name).isin(GENERIC_ENTITIES)
        | (F.startswith(name, F.lit("_")) & ~F.startswith(name, F.lit("__")))
    )


def build_entities(chunks: DataFrame) -> DataFrame:
    """Entity rows of chunks; generic and private names are skipped."""
    return chunks.filter(~is_generic(F.col("name"))).select(
        F.col("chunk_id").alias("id"), F.col("chunk_type").alias("kind"), "name", "class_name", "file_path"
    )


def listed(chunks: DataFrame, column: str) -> DataFrame:
    """(chunk_id, class_name, target) rows of an array column of the chunk table."""
    return chunks.select("chunk_id", "class_name", F.explode(column).alias("target"))


def resolve_entities(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """(src, dst) of name references that mean exactly one entity.

    ``self.x`` / ``cls.x`` go by class membership, then the full name, then the
    last dotted segment; a name held by several entities resolves to none. The
    references are reduced to distinct (class, name) pairs before any join, so a
    name called everywhere is looked up once per class.
    """
    unique = entities.groupBy("name").agg(F.count("*").alias("_n"), F.min("id").alias("_id")).filter("_n = 1").select("name", "_id")
    members = entities.filter(F.col("class_name").isNotNull()).groupBy("class_name", "name").agg(F.max("id").alias("_member"))
    asked = refs.select("class_name", "target").distinct()
    parts = F.split("target", r"\.", 2)
    scoped = F.when((F.size(parts) == 2) & parts[0].isin("self", "cls"), parts[1])
    found = (
        asked.withColumn("_scoped", scoped).withColumn("_short", F.when(F.contains("target", F.lit(".")), F.substring_index("target", ".", -1)))
        .join(members.select(F.col("class_name").alias("_c"), F.col("name").alias("_m"), "_member"), (F.col("class_name") == F.col("_c")) & (F.col("_scoped") == F.col("_m")), "left")
        .join(unique.select(F.col("name").alias("_f"), F.col("_id").alias("_full")), F.col("target") == F.col("_f"), "left")
        .join(unique.select(F.col("name").alias("_s"), F.col("_id").alias("_last")), F.col("_short") == F.col("_s"), "left")
        .select("class_name", "target", F.coalesce("_member", "_full", "_last").alias("dst"))
        .filter(F.col("dst").isNotNull())
    )
    r, f = refs.alias("r"), found.alias("f")
    return r.join(f, F.col("r.class_name").eqNullSafe(F.col("f.class_name")) & (F.col("r.target") == F.col("f.target"))).select(
        F.col("r.chunk_id").alias("src"), F.col("f.dst").alias("dst")
    )


def import_edges(imports: DataFrame) -> DataFrame:
    """(src, ``module:x``) per import; relative imports are skipped, dotted ones keep the first part."""
    return imports.filter(~F.startswith("target", F.lit("."))).select(
        F.col("chunk_id").alias("src"), F.concat(F.lit("module:"), F.substring_index("target", ".", 1)).alias("dst")
    ).distinct()


def build_edges(entities: DataFrame, calls: DataFrame, imports: DataFrame, inherits: DataFrame, parents: DataFrame) -> DataFrame:
    """(src, dst, rel) from reference rows; sources that are no entity keep only their imports."""
    known = entities.select(F.col("id").alias("src"))

    def tagged(df: DataFrame, rel: str) -> DataFrame:
        return df.select("src", "dst", F.lit(rel).alias("rel")).distinct()

    own = lambda df: df.join(known, "src", "left_semi")
    contains = parents.select(F.col("parent_id").alias("src"), F.col("chunk_id").alias("dst"))
    return (
        tagged(own(resolve_entities(calls, entities)), "CALLS")
        .unionByName(tagged(import_edges(imports), "IMPORTS"))
        .unionByName(tagged(own(resolve_entities(inherits, entities)), "INHERITS"))
        .unionByName(tagged(contains, "CONTAINS"))
    )


def upsert_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge by key, new rows winning (of several the smallest); edges without both ends are dropped."""
    kept = nodes.join(new_nodes.select("id"), "id", "left_anti")
    all_nodes = kept.unionByName(_smallest(new_nodes, ["id"]))
    key = ["src", "dst", "rel"]
    kept_edges = edges.join(new_edges.select(*key), key, "left_anti")
    all_edges = kept_edges.unionByName(_smallest(new_edges, key))
    ids = all_nodes.select("id")
    return all_nodes, _with_both_ends(all_edges, ids)


def _smallest(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key, the smallest by its other columns in their order."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    return df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def _first_per(df: DataFrame, group: list[str], order: list[Column | str], limit: int | None) -> DataFrame:
    """The first ``limit`` rows of each group, all of them without a limit."""
    if limit is None:
        return df
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def _with_both_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph without the nodes of some files and without every edge that touches them."""
    gone = nodes.join(files.select("file_path"), "file_path", "left_semi").select("id")
    left = nodes.join(files.select("file_path"), "file_path", "left_anti")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left, kept


def incremental_graph(nodes: DataFrame, edges: DataFrame, changed: DataFrame, fresh_nodes: DataFrame, fresh_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace the graph part of changed files (column ``file_path``) by freshly built rows."""
    n, e = delete_files(nodes, edges, changed)
    return upsert_graph(n, e, fresh_nodes, fresh_edges)


def kg_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, key, n): nodes per kind and edges per relation."""
    a = nodes.groupBy(F.col("kind").alias("key")).agg(F.count("*").alias("n")).select(F.lit("node").alias("section"), "key", "n")
    b = edges.groupBy(F.col("rel").alias("key")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("section"), "key", "n")
    return a.unionByName(b)


def part_of_edges(nodes: DataFrame, project_id: str) -> DataFrame:
    """Every entity → project, and entity → language by file suffix."""
    lang = fixed_table(nodes.sparkSession, list(SUFFIX_LANGUAGE.items()), "suffix string, language string")
    part = nodes.select(F.col("id").alias("src"), F.lit(project_id).alias("dst"), F.lit("PART_OF").alias("rel"))
    written = (
        nodes.select(F.col("id").alias("src"), tx.suffix(F.col("file_path")).alias("suffix")).join(F.broadcast(lang), "suffix")
        .select("src", F.concat(F.lit("lang:"), "language").alias("dst"), F.lit("WRITTEN_IN").alias("rel"))
    )
    return part.unionByName(written)


def framework_edges(dependencies: DataFrame, known: DataFrame, project_id: str) -> DataFrame:
    """Manifest rows (language, package, version) that name a known framework → USES_FRAMEWORK, FRAMEWORK_FOR."""
    hit = dependencies.join(known, ["language", "package"]).select("language", "framework").distinct()
    fid = F.concat(F.lit("framework:"), "framework")
    uses = hit.select(F.lit(project_id).alias("src"), fid.alias("dst"), F.lit("USES_FRAMEWORK").alias("rel"))
    belongs = hit.select(fid.alias("src"), F.concat(F.lit("lang:"), "language").alias("dst"), F.lit("FRAMEWORK_FOR").alias("rel"))
    return uses.unionByName(belongs).distinct()


def person_id(email: Column) -> Column:
    return F.concat(F.lit("person:"), F.substring(F.sha2(email.cast("binary"), 256), 1, 16))


def authorship(commit_files: DataFrame, entities: DataFrame, per_file: int | None = None) -> DataFrame:
    """(person, entity, rel, ts): the earliest author of a file AUTHORED, later ones MODIFIED; all entities of a file, or its first ``per_file`` by id."""
    first = commit_files.groupBy("path", person_id(F.col("author").cast("string")).alias("person")).agg(F.min("ts").alias("ts"))
    founder = first.groupBy("path").agg(F.min(F.struct("ts", "person")).alias("_f"))
    ranked = first.join(founder, "path").withColumn("rel", F.when(F.col("person") == F.col("_f.person"), "AUTHORED").otherwise("MODIFIED"))
    ents = _first_per(entities, ["file_path"], ["id"], per_file).select("id", F.col("file_path").alias("path"))
    return ranked.join(ents, "path").select("person", F.col("id").alias("entity"), "rel", "ts")


def commit_edges(commit_files: DataFrame, entities: DataFrame) -> DataFrame:
    """MODIFIES edges commit → entity with added and deleted lines, for every commit."""
    per = commit_files.groupBy("sha", "path").agg(F.sum("insertions").alias("lines_added"), F.sum("deletions").alias("lines_deleted"))
    return per.join(entities.select("id", F.col("file_path").alias("path")), "path").select(
        F.col("sha").alias("src"), F.col("id").alias("dst"), "lines_added", "lines_deleted"
    )


# ---------------------------------------------------------------- look-ups


def find_entity(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(query_name, id): the exact name, else the smallest id whose name contains it (never for generic names)."""
    exact = names.join(nodes, F.col("query_name") == F.col("name")).groupBy("query_name").agg(F.min("id").alias("_exact"))
    rest = names.join(exact, "query_name", "left_anti").filter(~F.lower("query_name").isin(GENERIC_LOOKUPS))
    part = substring_pairs(
        nodes.select(F.col("id").alias("text_id"), F.col("name").alias("text")), rest.select(F.col("query_name").alias("needle"))
    ).groupBy(F.col("needle").alias("query_name")).agg(F.min("text_id").alias("_part"))
    return (
        names.join(exact, "query_name", "left").join(part, "query_name", "left")
        .select("query_name", F.coalesce("_exact", "_part").alias("id")).filter(F.col("id").isNotNull())
    )


def undirected(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").unionByName(back).distinct()


def hops(edges: DataFrame, starts: DataFrame, max_hops: int | None, per_start: int | None = None) -> DataFrame:
    """(start, node, depth): nodes reached along (src, dst) within ``max_hops`` (None: to the end).

    Each round joins the frontier to the edges, drops what was seen, and is
    checkpointed. ``per_start`` bounds the nodes of a start, whole levels first,
    smallest ids within the level that passes the bound.
    """
    e = edges.select("src", "dst").distinct()
    seen = cut_lineage(starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    frontier, depth = seen, 0
    while max_hops is None or depth < max_hops:
        depth += 1
        step = (
            frontier.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
            .join(seen.select("start", "node"), ["start", "node"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        if per_start is not None:
            used = seen.groupBy("start").agg((F.count("*") - 1).alias("_used"))
            w = Window.partitionBy("start").orderBy("node")
            step = (
                step.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_start)
                .join(used, "start").filter(F.col("_r") + F.col("_used") <= per_start).drop("_r", "_used")
            )
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % FOLD_ROUNDS == 0:
            seen = cut_lineage(seen)
    return seen


# Rows that one part of a class of alike starts may give.
PART_ROWS = 250_000


def _alike(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, like): for each start with edges the smallest start that leads to the same nodes, by number and three sums of hashes of them (192 bits)."""
    wide = lambda salt: F.sum(F.xxhash64(F.lit(salt), "dst").cast("decimal(38,0)"))
    facts = starts.select("start").distinct().join(edges, F.col("start") == F.col("src")).groupBy("start").agg(
        F.count("*").alias("_n"), wide(1).alias("_a"), wide(2).alias("_b"), wide(3).alias("_c")
    )
    same = ["_n", "_a", "_b", "_c"]
    return facts.join(facts.groupBy(*same).agg(F.min("start").alias("like")), same).select("start", "like")


def find_related(edges: DataFrame, starts: DataFrame, max_hops: int = 2, limit: int | None = None) -> DataFrame:
    """(start, node, depth): distinct other nodes within some hops in any direction; all, or the first ``limit`` by depth and id.

    Starts with the same neighbours reach the same nodes, so each such class is walked once; its nodes are then given to its
    starts, in parts of PART_ROWS rows.
    """
    e = cut_lineage(undirected(edges))
    members = cut_lineage(_alike(starts, e))
    first = members.select("like").distinct().join(e, F.col("like") == F.col("src"))
    seen = frontier = cut_lineage(first.select("like", F.col("dst").alias("node"), F.lit(1).alias("depth")))
    for depth in range(2, max_hops + 1):
        step = frontier.join(e, F.col("node") == F.col("src")).select("like", F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(step.join(seen.select("like", "node"), ["like", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    sizes = members.groupBy("like").agg(F.count("*").alias("_starts")).join(seen.groupBy("like").agg(F.count("*").alias("_nodes")), "like")
    sizes = cut_lineage(sizes.select("like", F.ceil(F.col("_starts") * F.col("_nodes") / PART_ROWS).cast("int").alias("_parts")))
    tasks = min(20_000, sizes.agg(F.coalesce(F.sum("_parts"), F.lit(0))).first()[0] // 4 + 1)
    dealt = members.join(sizes, "like").select("like", "start", F.pmod(F.xxhash64("start"), F.col("_parts")).cast("int").alias("_part"))
    spread = seen.join(sizes, "like").select("like", "node", "depth", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    found = dealt.repartition(tasks, "like", "_part").join(spread, ["like", "_part"]).filter("node <> start").select("start", "node", "depth")
    return _first_per(found, ["start"], ["depth", "node"], limit)


def time_decay(last_modified: Column, as_of: Column, half_life_days: float) -> Column:
    """0.5^(age / half-life); a missing date counts as new, a future one too."""
    age = F.greatest(F.lit(0), F.datediff(as_of, last_modified))
    return F.when(last_modified.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), age / half_life_days))


def find_by_tags(tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Sections that have all the tags."""
    return (
        tags.filter(F.col("tag").isin(wanted)).groupBy("section").agg(F.countDistinct("tag").alias("_n"))
        .filter(F.col("_n") == len(set(wanted))).select("section")
    )


def call_graph(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, direction): direct callees and callers."""
    e = edges.select("src", "dst")
    out = starts.join(e, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit("calls").alias("direction"))
    back = starts.join(e, F.col("start") == F.col("dst")).select("start", F.col("src").alias("node"), F.lit("called_by").alias("direction"))
    return out.unionByName(back).distinct()


def trace_flow(edges: DataFrame, starts: DataFrame, depth: int | None = 3, direction: str = "outgoing", max_nodes: int | None = None) -> DataFrame:
    """(start, node, depth): breadth-first trace, to the end if ``depth`` is None; with ``max_nodes`` whole levels first, then the smallest ids."""
    e = edges.select("src", "dst")
    if direction == "incoming":
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    elif direction == "both":
        e = undirected(e)
    return hops(e, starts, None if depth is None else max(depth, 1), max_nodes)


def trace_edges(edges: DataFrame, traced: DataFrame) -> DataFrame:
    """(start, src, dst): edges between traced nodes of one start."""
    a = traced.select("start", F.col("node").alias("src"))
    b = traced.select("start", F.col("node").alias("dst"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, ["start", "dst"]).select("start", "src", "dst")


def trace_paths(edges: DataFrame, starts: DataFrame, depth: int = 3, limit: int | None = None) -> DataFrame:
    """(start, path): maximal walks without repeats, as deep as asked; all, or the first ``limit`` per start by text."""
    e = edges.select("src", "dst").distinct()
    open_ = cut_lineage(starts.select("start", F.array("start").alias("path"), F.col("start").alias("node")))
    done = None
    for level in range(max(depth, 1)):
        grown = open_.join(e, F.col("node") == F.col("src"), "left").withColumn(
            "_ok", F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst"))
        )
        longer = grown.filter("_ok").select("start", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"))
        longer = cut_lineage(longer)
        prefixes = longer.select("start", F.slice("path", 1, level + 1).alias("path")).distinct()
        ended = open_.select("start", "path").join(prefixes, ["start", "path"], "left_anti").filter(F.size("path") > 1)
        done = ended if done is None else done.unionByName(ended)
        open_ = longer
    done = done.unionByName(open_.select("start", "path"))
    return _first_per(done.select("start", F.array_join("path", ">").alias("path")), ["start"], ["path"], limit)


def inheritance_tree(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, relation): all transitive parents and children."""
    up = hops(edges, starts, None).filter("depth > 0").select("start", "node", F.lit("parent").alias("relation"))
    rev = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    down = hops(rev, starts, None).filter("depth > 0").select("start", "node", F.lit("child").alias("relation"))
    return up.unionByName(down)


def tree_paths(edges: DataFrame) -> DataFrame:
    """(node, path from root, depth) of a containment forest given as (src parent, dst child).

    A node with several parents has its shortest path, the smallest of equal ones; a cycle
    is entered once, and one that no root leads to has no paths.
    """
    e = edges.select("src", "dst").distinct()
    roots = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_anti")
    level = cut_lineage(roots.select("node", F.array("node").alias("path"), F.lit(0).alias("depth")))
    out, depth = level, 0
    while True:
        depth += 1
        level = cut_lineage(
            level.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
            .join(out.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        )
        if level.isEmpty():
            return out
        out = out.unionByName(level)
        if depth % FOLD_ROUNDS == 0:
            out = cut_lineage(out)


@dataclass(frozen=True)
class TreeLabels:
    """labels(node, parent, first, last, depth) of a forest: a node is below another if its ``first`` lies between the other's first and last.

    ``jumps`` holds (node, above) tables of the ancestors 1, 2, 4, … levels up.
    """

    labels: DataFrame
    jumps: list[DataFrame]


def _tour_ranks(steps: DataFrame) -> DataFrame:
    """(element, last, rank, fall) of lists given as (element, next, weight): how many elements and what weight follow up to the list's end, by doubling the step.

    Elements of a ring have no end and are left out.
    """
    size = steps.count()
    state = cut_lineage(steps.select("element", "next", F.lit(1).cast("long").alias("rank"), F.col("weight").cast("long").alias("fall"), F.col("element").alias("last")))
    for _ in range(max(1, size).bit_length() + 1):
        if not state.filter(F.col("next").isNotNull()).limit(1).count():
            break
        ahead = state.select(F.col("element").alias("next"), F.col("next").alias("_next"), F.col("rank").alias("_rank"), F.col("fall").alias("_fall"), F.col("last").alias("_last"))
        grown = cut_lineage(
            state.join(ahead, "next", "left").select(
                "element", F.col("_next").alias("next"), (F.col("rank") + F.coalesce("_rank", F.lit(0))).alias("rank"),
                (F.col("fall") + F.coalesce("_fall", F.lit(0))).alias("fall"), F.coalesce("_last", "last").alias("last"),
            )
        )
        drop_written(state)
        state = grown
    return state.filter(F.col("next").isNull()).select("element", "last", "rank", "fall")


def tree_labels(edges: DataFrame) -> TreeLabels:
    """Interval labels and ancestor jumps of a containment forest given as (src parent, dst child), in rounds that grow with the logarithm of its depth.

    The tour of each tree, into a node, through its children and out of it, is a list; its order comes from doubling the step
    (pointer jumping), and one prefix of the trees' sizes sets the trees side by side. A node with several parents hangs below the one its shortest, of
    equal ones smallest, path leads through; a node that no root leads to has no label.
    """
    e = edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct()
    several = e.groupBy("dst").agg(F.count("*").alias("n")).filter("n > 1")
    if several.limit(1).count():
        e = tree_paths(e).filter("depth > 0").select(F.element_at("path", -2).alias("src"), F.col("node").alias("dst"))
    e = cut_lineage(e)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    roots = nodes.join(e.select(F.col("dst").alias("node")), "node", "left_anti")
    kids = number_in_group(e, ["src"], ["dst"], "nth")
    kids = cut_lineage(kids.select("src", "dst", "nth"))
    into, out = (lambda c: F.struct(c.alias("node"), F.lit(0).alias("out"))), (lambda c: F.struct(c.alias("node"), F.lit(1).alias("out")))
    first = kids.filter("nth = 1").select(F.col("src").alias("node"), F.col("dst").alias("_kid"))
    enter = nodes.join(first, "node", "left").select(
        into(F.col("node")).alias("element"), F.when(F.col("_kid").isNull(), out(F.col("node"))).otherwise(into(F.col("_kid"))).alias("next"), F.lit(1).alias("weight")
    )
    after = kids.select("src", (F.col("nth") - 1).alias("nth"), F.col("dst").alias("_beside"))
    leave = kids.join(after, ["src", "nth"], "left").select(
        out(F.col("dst")).alias("element"), F.when(F.col("_beside").isNull(), out(F.col("src"))).otherwise(into(F.col("_beside"))).alias("next"), F.lit(-1).alias("weight")
    )
    end = roots.select(out(F.col("node")).alias("element"), F.lit(None).cast(enter.schema["next"].dataType).alias("next"), F.lit(-1).alias("weight"))
    ranks = cut_lineage(_tour_ranks(enter.unionByName(leave).unionByName(end)))
    trees = ranks.filter("element.out = 0").select(F.col("last.node").alias("root"), F.col("element.node").alias("node"), "rank", F.col("fall").alias("_rest"))
    sizes = trees.groupBy("root").agg(F.max("rank").alias("size"))
    starts = running(sizes, [], ["root"], F.col("size"), "sum", "_before", inclusive=False)
    leaving = ranks.filter("element.out = 1").select(F.col("element.node").alias("node"), F.col("rank").alias("_out"))
    placed = trees.join(starts, "root").join(leaving, "node").join(e.select(F.col("src").alias("parent"), F.col("dst").alias("node")), "node", "left")
    labels = cut_lineage(
        placed.select(
            "node", "parent", (F.col("_before") + F.col("size") - F.col("rank")).alias("first"), (F.col("_before") + F.col("size") - F.col("_out")).alias("last"),
            (-F.col("_rest")).cast("int").alias("depth"),
        )
    )
    deepest = labels.agg(F.max("depth")).first()[0] or 0
    jump = cut_lineage(labels.filter(F.col("parent").isNotNull()).select("node", F.col("parent").alias("above")))
    jumps = [jump]
    while 1 << len(jumps) <= deepest:
        further = jump.select(F.col("node").alias("above"), F.col("above").alias("_above"))
        jump = cut_lineage(jump.join(further, "above").select("node", F.col("_above").alias("above")))
        jumps.append(jump)
    return TreeLabels(labels, jumps)


def descendants(tree: TreeLabels, pairs: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose b is a or below it."""
    la = tree.labels.select(F.col("node").alias("a"), F.col("first").alias("_fa"), F.col("last").alias("_la"))
    lb = tree.labels.select(F.col("node").alias("b"), F.col("first").alias("_fb"))
    return pairs.join(la, "a").join(lb, "b").filter(F.col("_fb").between(F.col("_fa"), F.col("_la"))).select(*pairs.columns)


def lca_score(tree: TreeLabels | DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, lca, penalty, resonance) of node pairs in a forest (``TreeLabels``, or its edges).

    penalty = Δdepth_a + Δdepth_b + ½·|depth_a − depth_b|; resonance = 1 − penalty / (2·max depth),
    floored at 0; nodes of different trees score 0. The common ancestor is found by climbing from a in falling powers of
    two as long as b is not below, then one level more. Pairs with a node outside the forest are left out.
    """
    if isinstance(tree, DataFrame):
        tree = tree_labels(tree)
    labels = tree.labels
    baseline = max(1.0, 2.0 * (labels.agg(F.max("depth")).first()[0] or 0))
    la = labels.select(F.col("node").alias("a"), F.col("first").alias("_fa"), F.col("last").alias("_la"), F.col("depth").alias("_da"))
    lb = labels.select(F.col("node").alias("b"), F.col("first").alias("_fb"), F.col("depth").alias("_db"))
    state = cut_lineage(pairs.select("a", "b").distinct().join(la, "a").join(lb, "b").withColumn("_at", F.col("a")))
    over = lambda first, last: F.col("_fb").between(F.col(first), F.col(last))
    climbing = state.filter(~over("_fa", "_la"))
    for jump in reversed(tree.jumps):
        reach = jump.join(labels.select(F.col("node").alias("above"), F.col("first").alias("_f"), F.col("last").alias("_l")), "above").withColumnRenamed("node", "_at")
        moved = climbing.join(reach, "_at", "left")
        stay = F.col("above").isNull() | over("_f", "_l")
        climbing = cut_lineage(moved.select(*[c for c in climbing.columns if c != "_at"], F.when(stay, F.col("_at")).otherwise(F.col("above")).alias("_at")))
    up = labels.select(F.col("node").alias("_at"), F.col("parent").alias("lca"))
    met = climbing.join(up, "_at", "left").unionByName(state.filter(over("_fa", "_la")).withColumn("lca", F.col("a")), allowMissingColumns=True)
    depth = labels.select(F.col("node").alias("lca"), F.col("depth").alias("_dl"))
    out = met.join(depth, "lca", "left")
    penalty = (F.col("_da") - F.col("_dl")) + (F.col("_db") - F.col("_dl")) + 0.5 * F.abs(F.col("_da") - F.col("_db"))
    related = F.col("lca").isNotNull()
    return pairs.join(
        out.select(
            "a", "b", "lca", F.when(related, penalty).alias("penalty"),
            F.round(F.when(related, F.greatest(F.lit(0.0), 1 - penalty / baseline)).otherwise(0.0), 6).alias("resonance"),
        ), ["a", "b"],
    ).select("a", "b", "lca", "penalty", "resonance")


def kg_query(edges: DataFrame, containment: DataFrame | TreeLabels, starts: DataFrame, relation: str, limit: int | None = None) -> DataFrame:
    """(start, node, final_score, rank): neighbours by relation, ranked by 1 + weight · tree closeness; all, or the best ``limit``.

    ``containment``: the edges of the containment forest, or its labels made once for many calls.
    """
    pick = lambda rel: edges.filter(F.col("rel") == rel)
    if relation in ("calls", "called_by"):
        found = call_graph(pick("CALLS"), starts).filter(F.col("direction") == relation).select("start", "node")
    elif relation in ("inherits", "inherited_by"):
        side = "parent" if relation == "inherits" else "child"
        found = inheritance_tree(pick("INHERITS"), starts).filter(F.col("relation") == side).select("start", "node")
    else:
        near = relation in ("imports", "imported_by", "contains", "contained_by")
        found = find_related(edges, starts, 1 if near else 2).select("start", "node")
    pairs = found.select(F.col("start").alias("a"), F.col("node").alias("b")).distinct()
    scores = lca_score(containment, pairs).select(F.col("a").alias("start"), F.col("b").alias("node"), "resonance")
    final = F.round(1 + LCA_WEIGHT * F.coalesce("resonance", F.lit(0.0)), 6)
    scored = found.join(scores, ["start", "node"], "left").withColumn("final_score", final)
    if limit is None:
        ranked = number_in_group(scored.withColumn("_worse", -F.col("final_score")), ["start"], ["_worse", "node"], "rank")
        return ranked.select("start", "node", "final_score", F.col("rank").cast("int").alias("rank"))
    w = Window.partitionBy("start").orderBy(F.col("final_score").desc(), "node")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("start", "node", "final_score", "rank")


def doc_references(edges: DataFrame, sections: DataFrame, targets: DataFrame) -> DataFrame:
    """Sections that REFERENCE or DOCUMENT an entity, in file and line order."""
    return (
        edges.filter(F.col("rel").isin("REFERENCES", "DOCUMENTS")).join(targets, F.col("dst") == F.col("id"))
        .join(sections, F.col("src") == F.col("section_id")).select("name", "section_id", "file_path", "start_line", "rel")
        .orderBy("name", "file_path", "start_line")
    )


def _line_jumps(step: DataFrame) -> list[DataFrame]:
    """(src, dst) tables of the nodes 1, 2, 4, … steps along ``step``, which is written and has one row a node."""
    jumps, size = [step], step.count()
    while len(jumps) <= size.bit_length():
        further = step.select(F.col("src").alias("dst"), F.col("dst").alias("_far"))
        step = cut_lineage(step.join(further, "dst").select("src", F.col("_far").alias("dst")))
        if step.isEmpty():
            break
        jumps.append(step)
    return jumps


def _shortened(step: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """``step`` (src, dst) of one row a node, written, shortened to LINE_ROWS rows, and what each level left out: [(out, level)].

    A node leaves if its coin, a hash of it and the level, shows 0 and that of the node it leads to shows 1, so what it leads to stays and about a quarter
    leaves at a time. ``out`` (node, over) holds those that leave and where they lead, ``level`` (src, dst, via) the others: a node that led to one that leaves
    now leads over it, and ``via`` names it. All levels together hold a few times the rows of the first.
    """
    levels = []
    while step.count() > LINE_ROWS:
        coin = lambda c: F.xxhash64(F.lit(len(levels)), F.col(c).cast("string")).bitwiseAND(F.lit(1))
        leaves = (coin("src") == 0) & (coin("dst") == 1)
        out = step.filter(leaves).select(F.col("src").alias("node"), F.col("dst").alias("over"))
        kept = step.filter(~leaves).join(out, F.col("dst") == F.col("node"), "left")
        level = cut_lineage(kept.select("src", F.coalesce("over", "dst").alias("dst"), F.col("node").alias("via")))
        levels.append((out, level))
        step = level.filter("src <> dst").select("src", "dst")
    return levels, cut_lineage(step) if levels else step


def _along(fresh: DataFrame, levels: list[tuple[DataFrame, DataFrame]], jumps: list[DataFrame]) -> DataFrame:
    """(start, node): ``fresh`` (start, node), written, and all that its nodes reach along the line of ``jumps`` and the ``levels`` that were left out of it."""
    outside = []
    for out, _ in levels:
        moved = cut_lineage(fresh.join(out, "node", "left").select("start", "node", "over"))
        outside.append(moved.filter("over IS NOT NULL").select("start", "node"))
        fresh = moved.select("start", F.coalesce("over", "node").alias("node")).distinct()
    for jump in jumps:
        further = fresh.join(jump, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"))
        grown = cut_lineage(fresh.unionByName(further).distinct())
        if not levels:
            drop_written(fresh)
        fresh = grown
    for (_, level), own in zip(reversed(levels), reversed(outside), strict=True):
        passed = level.filter("via IS NOT NULL").select(F.col("src").alias("node"), "via")
        between = fresh.join(passed, "node").select("start", F.col("via").alias("node"))
        fresh = fresh.unionByName(cut_lineage(between.unionByName(own).distinct()))
    return fresh


def ancestors(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): every start and all it reaches over (src, dst).

    Along first parents the way is doubled: with jumps of 1, 2, 4, … steps taken one after the other, about log2 of a line's length
    joins reach all of it. A long line is shortened first, so that what is moved grows with its length only, and what was left out of it is put back
    in place. Then the other parents of what is reached are new starting points, until there are none; that is a round for each merge
    that a way must pass. Cycles are fine.
    """
    e = cut_lineage(parents.select("src", "dst").filter(F.col("dst").isNotNull()).distinct())
    step = cut_lineage(e.groupBy("src").agg(F.min("dst").alias("dst")))
    others = cut_lineage(e.join(step, ["src", "dst"], "left_anti"))
    levels, short = _shortened(step)
    jumps = _line_jumps(short)
    fresh = cut_lineage(starts.select("start", F.col("start").alias("node")).distinct())
    seen, rounds = None, 0
    while not fresh.isEmpty():
        fresh = _along(fresh, levels, jumps)
        new = fresh if seen is None else cut_lineage(fresh.join(seen, ["start", "node"], "left_anti"))
        seen, rounds = new if seen is None else seen.unionByName(new), rounds + 1
        if rounds % FOLD_ROUNDS == 0:
            seen = cut_lineage(seen)
        beside = new.join(others, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        fresh = cut_lineage(beside.join(seen, ["start", "node"], "left_anti"))
    return seen if seen is not None else fresh


def entities_at_commit(entities: DataFrame, parents: DataFrame, commits: DataFrame) -> DataFrame:
    """(start commit, entity) for entities whose commit is the asked one or an ancestor of it."""
    e = parents.select(F.col("commit").alias("src"), F.col("parent").alias("dst"))
    closure = ancestors(e, commits).select("start", F.col("node").alias("commit"))
    return entities.join(closure, "commit").select("start", "id", "commit")


def callers_at_commit(edges: DataFrame, entities: DataFrame, parents: DataFrame, asked: DataFrame) -> DataFrame:
    """(start, callee_name, caller, caller_name, commit) of the calls that stood as of a commit.

    ``asked`` holds start (a commit) and callee_name; a call counts when its caller's commit is the asked one or an ancestor
    of it. ``entities``: id, name, commit; an entity without a commit is no caller.
    """
    e = parents.select(F.col("commit").alias("src"), F.col("parent").alias("dst"))
    closure = ancestors(e, asked.select("start")).select("start", F.col("node").alias("commit"))
    callees = entities.select(F.col("id").alias("dst"), F.col("name").alias("callee_name")).join(asked.select("callee_name").distinct(), "callee_name", "left_semi")
    callers = entities.filter(F.col("commit").isNotNull()).select(F.col("id").alias("src"), F.col("name").alias("caller_name"), "commit")
    calls = edges.select("src", "dst").distinct().join(callees, "dst").join(callers, "src").select("callee_name", F.col("src").alias("caller"), "caller_name", "commit").distinct()
    return asked.distinct().join(calls, "callee_name").join(closure, ["start", "commit"], "left_semi").select("start", "callee_name", "caller", "caller_name", "commit")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes reached from any root (one visited set for all roots)."""
    e = edges.select("src", "dst").distinct()
    seen = cut_lineage(roots.select("node").distinct())
    frontier, rounds = seen, 0
    while True:
        rounds += 1
        frontier = cut_lineage(
            frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        )
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if rounds % FOLD_ROUNDS == 0:
            seen = cut_lineage(seen)


CONFIDENCE_ORDER = {"low": 1, "medium": 2, "high": 3}


def reachability(functions: DataFrame, edges: DataFrame, roots: DataFrame, minimum: str = "low", excluded: list[str] | None = None) -> DataFrame:
    """Functions no root reaches, with confidence: decorated low, ``_x`` high, else medium."""
    name = F.col("name")
    dead = functions.join(reachable(edges, roots).withColumnRenamed("node", "id"), "id", "left_anti").filter(
        F.col("kind").isin("function", "method") & ~name.rlike("^__.*__$")
    )
    dec = F.col("decorators")
    prop = F.exists(dec, lambda x: x.rlike(r"@property|@cached_property|@functools\.cached_property|\.setter|\.deleter"))
    dead = dead.filter(~F.coalesce(prop, F.lit(False)))
    for p in excluded or []:
        dead = dead.filter(~F.contains("file_path", F.lit(p)))
    conf = F.when(F.size(dec) > 0, "low").when(F.startswith(name, F.lit("_")), "high").otherwise("medium")
    level = F.when(conf == "low", 1).when(conf == "medium", 2).otherwise(3)
    return dead.withColumn("confidence", conf).filter(level >= CONFIDENCE_ORDER[minimum])


# Decorators that mark entry points.
CLI_DECORATORS = ["command", "group", "callback", "click.command", "click.group", "app.command", "typer.command"]
CLI_METHODS = ["command", "callback", "group"]
ROUTE_METHODS = ["get", "post", "put", "delete", "patch", "options", "head", "route", "websocket", "api_route"]


def entry_points(functions: DataFrame) -> DataFrame:
    """(id, entry_type, confidence): main calls, CLI and route decorators, tests, exports, public functions."""
    called = lambda d: F.regexp_replace(F.regexp_replace(d, "^@", ""), r"\(.*$", "")
    last = lambda d: F.substring_index(called(d), ".", -1)
    cli = F.exists("decorators", lambda d: called(d).isin(CLI_DECORATORS) | (F.contains(called(d), F.lit(".")) & last(d).isin(CLI_METHODS)))
    route = F.exists("decorators", lambda d: last(d).isin(ROUTE_METHODS))
    fixture = F.exists("decorators", lambda d: last(d) == "fixture")
    name = F.col("name")
    kind = (
        F.when(F.col("in_main"), "main").when(cli, "cli").when(route, "route").when(F.startswith(name, F.lit("test_")) | fixture, "test")
        .when(F.col("exported"), "export").when(~F.startswith(name, F.lit("_")) & (F.col("kind") == "function"), "public")
    )
    return functions.withColumn("entry_type", kind).filter(F.col("entry_type").isNotNull()).select(
        "id", "entry_type", F.when(F.col("entry_type") == "public", 0.7).otherwise(1.0).alias("confidence")
    )


def import_graph(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(module, importer, internal): distinct import rows, flagged where the module is one of the analysed files."""
    pairs = imports.select(F.col("target").alias("module"), F.col("file_path").alias("importer")).distinct()
    own = files.select(F.col("module"), F.lit(True).alias("_own")).distinct()
    return pairs.join(own, "module", "left").select("module", "importer", F.coalesce("_own", F.lit(False)).alias("internal"))


def _contracted(live: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(edges, chains, rings): ``live`` with every node of one edge in and one out taken out of its line.

    Such nodes follow each other in lines from a head to a tail, which are found by doubling the step; an edge
    from head to tail takes a line's place. chains(node, head, tail); a line without ends is a ring(node, component).
    """
    out = live.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("tail")).filter("n = 1").select(F.col("src").alias("node"), "tail")
    back = live.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("head")).filter("n = 1").select(F.col("dst").alias("node"), "head")
    line = cut_lineage(out.join(back, "node").withColumn("low", F.col("node")))
    size = line.count()
    if not size:
        return live, None, None
    for _ in range(size.bit_length() + 1):
        ahead = line.select(F.col("node").alias("tail"), F.col("tail").alias("_tail"), F.col("low").alias("_low"))
        behind = line.select(F.col("node").alias("head"), F.col("head").alias("_head"))
        stepped = line.join(ahead, "tail", "left").join(behind, "head", "left")
        nxt = cut_lineage(stepped.select("node", F.coalesce("_tail", "tail").alias("tail"), F.coalesce("_head", "head").alias("head"), F.least("low", "_low").alias("low"), F.col("_tail").isNotNull().alias("_open")))
        open_ = nxt.filter("_open").limit(1).count()
        drop_written(line)
        line = nxt.drop("_open")
        if not open_:
            break
    inner = line.select("node")
    whole = line.join(inner.select(F.col("node").alias("tail")), "tail", "left_semi")
    chains = cut_lineage(line.join(inner.select(F.col("node").alias("tail")), "tail", "left_anti").select("node", "head", "tail"))
    rings = cut_lineage(whole.select("node", F.col("low").alias("component")))
    rest = live.join(inner.select(F.col("node").alias("src")), "src", "left_anti").join(inner.select(F.col("node").alias("dst")), "dst", "left_anti")
    edges = rest.select("src", "dst").unionByName(chains.filter("head <> tail").select(F.col("head").alias("src"), F.col("tail").alias("dst"))).distinct()
    return cut_lineage(edges), chains, rings


def _both_ways(live: DataFrame) -> DataFrame:
    """Edges whose ends have an edge in and one out."""
    into, out = live.select(F.col("dst").alias("src")).distinct(), live.select(F.col("src").alias("dst")).distinct()
    return cut_lineage(live.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))


def _coloured(live: DataFrame) -> DataFrame:
    """(node, colour): the largest node that reaches each node; colours are also taken over from the colour's own node, which shortens long ways."""
    colours = cut_lineage(live.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
    while True:
        said = live.join(colours.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_in"))
        own = colours.select(F.col("node").alias("colour"), F.col("colour").alias("_far"))
        best = F.greatest("colour", "_in", "_far")
        nxt = cut_lineage(colours.join(said, "node", "left").join(own, "colour", "left").select("node", best.alias("colour"), (best > F.col("colour")).alias("_new")))
        more = nxt.filter("_new").limit(1).count()
        drop_written(colours)
        colours = nxt.drop("_new")
        if not more:
            return colours


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the strongly connected component of every node of (src, dst), named by its smallest node.

    Lines of nodes with one edge in and one out are replaced by an edge, nodes that no cycle passes are taken away, and of what is left the
    components are those that reach their colour's largest node and are reached by it; the rest goes on by colour. A node on
    a replaced line belongs to its ends' component if they share one. Each round is written once.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).filter(F.col("node").isNotNull()).distinct()
    live = cut_lineage(edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct())
    found, lines = [], []
    while True:
        size = live.count()
        while size:
            live, chains, rings = _contracted(live)
            if chains is not None:
                lines.append(chains)
                found.append(rings)
            live = _both_ways(live)
            before, size = size, live.count()
            if size == before:
                break
        if not size:
            break
        colours = _coloured(live)
        pair = live.join(colours.select(F.col("node").alias("src"), "colour"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("_to")), "dst")
        within = cut_lineage(pair.filter(F.col("colour") == F.col("_to")).select("src", "dst", "colour"))
        roots = colours.filter(F.col("node") == F.col("colour")).select("node")
        back = reachable(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots)
        own = cut_lineage(back.join(colours, "node").select("node", F.col("colour").alias("component")))
        found.append(own)
        gone = own.select("node")
        live = cut_lineage(within.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    none = nodes.select("node", F.col("node").alias("component")).limit(0)
    named = cut_lineage(nodes.join(reduce(DataFrame.unionByName, found, none), "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    for chains in reversed(lines):
        head = named.select(F.col("node").alias("head"), F.col("component").alias("_head"))
        tail = named.select(F.col("node").alias("tail"), F.col("component").alias("_tail"))
        joined = chains.join(head, "head").join(tail, "tail").filter(F.col("_head") == F.col("_tail")).select("node", F.col("_head").alias("_line"))
        named = cut_lineage(named.join(joined, "node", "left").select("node", F.coalesce("_line", "component").alias("component")))
    smallest = named.groupBy("component").agg(F.min("node").alias("_least"))
    return named.join(smallest, "component").select("node", F.col("_least").alias("component"))


def within_components(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) whose ends are in one strongly connected component: the edges that cycles pass, loops included."""
    named = strong_components(edges)
    e = edges.select("src", "dst").distinct()
    src, dst = named.select(F.col("node").alias("src"), F.col("component").alias("_src")), named.select(F.col("node").alias("dst"), F.col("component").alias("_dst"))
    return e.join(src, "src").join(dst, "dst").filter(F.col("_src") == F.col("_dst")).select("src", "dst")


def cycles(edges: DataFrame, max_length: int | None = None, self_loops: bool = True) -> DataFrame:
    """(cycle, length): every simple cycle, or those up to a length, starting at its smallest node.

    Walks stay in their strongly connected component and only visit nodes larger than their
    start, so each cycle is found once and no rotation has to be removed. A dense
    component has very many simple cycles; ``max_length`` is for such graphs.
    """
    e = cut_lineage(within_components(edges))
    loops = e.filter(F.col("src") == F.col("dst")).select(F.array("src").alias("path"))
    e = e.filter(F.col("src") != F.col("dst"))
    open_ = cut_lineage(e.filter(F.col("src") < F.col("dst")).select(F.col("src").alias("first"), F.array("src", "dst").alias("path"), F.col("dst").alias("node")))
    found = [loops] if self_loops else []
    for _ in count_up(2) if max_length is None else range(2, max_length + 1):
        step = open_.join(e, F.col("node") == F.col("src"))
        found.append(step.filter(F.col("dst") == F.col("first")).select("path"))
        open_ = cut_lineage(
            step.filter((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst")))
            .select("first", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"))
        )
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).select(F.array_join("path", ">").alias("cycle"), F.size("path").alias("length"))


def components(members: DataFrame, group: str, item: str, attribute: str) -> DataFrame:
    """(group, item, label): items of a group joined through shared attributes, label = smallest item.

    Labels flow item → attribute → item (never item pairs) with pointer jumping,
    so a shared attribute of n items costs n rows and few rounds are needed.
    """
    rows = cut_lineage(members.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(attribute).alias("a")).distinct())
    labels = cut_lineage(rows.select("g", "i", F.col("i").alias("label")).distinct())
    while True:
        by_attr = rows.join(labels, ["g", "i"]).groupBy("g", "a").agg(F.min("label").alias("la"))
        low = rows.join(by_attr, ["g", "a"]).groupBy("g", "i").agg(F.min("la").alias("low"))
        jump = labels.select("g", F.col("i").alias("low"), F.col("label").alias("jumped"))
        nxt = cut_lineage(
            labels.join(low, ["g", "i"], "left").join(jump, ["g", "low"], "left")
            .select("g", "i", "label", F.least("label", "low", "jumped").alias("next"))
        )
        changed = not nxt.filter(F.col("next") < F.col("label")).isEmpty()
        labels = nxt.select("g", "i", F.col("next").alias("label"))
        if not changed:
            return labels.select(F.col("g").alias(group), F.col("i").alias(item), "label")


def lcom4(members: DataFrame, group: str = "class", item: str = "method", attribute: str = "attribute") -> DataFrame:
    """Connected components of the methods per class."""
    return components(members, group, item, attribute).groupBy(group).agg(F.countDistinct("label").alias("lcom4"))


def sample_subgraph(nodes: DataFrame, edges: DataFrame, top: int = 50, big: int = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a first view: the ``top`` nodes by degree, an aggregate node per kind with more than ``big`` members."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    best = nodes.join(degree, "id").orderBy(F.col("degree").desc(), "id").limit(top).select("id", "kind", "degree", F.lit(1).cast("long").alias("members"))
    groups = nodes.groupBy("kind").agg(F.count("*").alias("members")).filter(F.col("members") > big).select(
        F.concat(F.lit("agg:"), "kind").alias("id"), "kind", F.lit(0).cast("long").alias("degree"), "members"
    )
    view = best.unionByName(groups)
    links = _with_both_ends(edges.select("src", "dst", "rel").distinct(), best.select("id"))
    return view, links


def neighbours(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_per_kind: int | None = None) -> DataFrame:
    """Direct neighbours of start nodes; all, or the first ``max_per_kind`` of each kind by id."""
    near = starts.join(undirected(edges), F.col("start") == F.col("src")).select("start", F.col("dst").alias("id"))
    return _first_per(near.join(nodes.select("id", "kind"), "id"), ["start", "kind"], ["id"], max_per_kind).select("start", "id", "kind")


def module_graph(files: DataFrame, imports: DataFrame, smells: DataFrame, min_group: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a dependency view: directory group and worst severity per file; import count, mutual and circular flag per link (part of a cycle of any length)."""
    rank = F.when(F.col("severity") == "error", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    worst = smells.groupBy("file_path").agg(F.max(rank).alias("_w"))
    folder = F.when(F.contains("file_path", F.lit("/")), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise(F.lit("root"))
    base = files.withColumn("folder", folder)
    sizes = base.groupBy("folder").agg(F.count("*").alias("folder_files"))
    label = F.when(F.col("_w") == 3, "error").when(F.col("_w") == 2, "warning").when(F.col("_w") == 1, "info").otherwise("none")
    nodes = base.join(sizes, "folder").join(worst, "file_path", "left").select(
        "file_path", "folder", (F.col("folder_files") >= min_group).alias("grouped"), label.alias("severity")
    )
    links = imports.groupBy("src", "dst").agg(F.count("*").alias("coupling"))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("_back"))
    round_ = within_components(links).withColumn("_round", F.lit(True))
    links = links.join(back, ["src", "dst"], "left").join(round_, ["src", "dst"], "left").select(
        "src", "dst", "coupling", F.coalesce("_back", F.lit(False)).alias("mutual"), F.coalesce("_round", F.lit(False)).alias("circular")
    )
    return nodes, links
