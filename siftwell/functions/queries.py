"""Analysis of query texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import any_of, contains_any, words

# Synonym groups used to widen a query, one substitution at a time.
SYNONYMS = {
    "auth": ["authentication", "authorize", "login", "session", "credential", "oauth"],
    "delete": ["remove", "destroy", "drop", "purge", "clean", "erase"],
    "create": ["new", "init", "initialize", "build", "make", "generate", "construct"],
    "error": ["exception", "fault", "failure", "crash", "bug", "issue"],
    "config": ["configuration", "settings", "options", "preferences", "env"],
    "db": ["database", "storage", "persistence", "datastore", "repo", "repository"],
    "api": ["endpoint", "route", "handler", "controller", "resource"],
    "test": ["spec", "assertion", "verify", "validate", "check", "expect"],
    "async": ["concurrent", "parallel", "await", "coroutine", "future", "promise"],
    "cache": ["memoize", "store", "buffer", "preload"],
    "parse": ["extract", "tokenize", "analyze", "process", "decode"],
    "render": ["display", "draw", "paint", "show", "present", "view"],
    "fetch": ["get", "retrieve", "load", "download", "pull", "request"],
    "send": ["post", "push", "emit", "dispatch", "publish", "transmit"],
    "log": ["trace", "debug", "print", "output", "record", "audit"],
    "user": ["account", "profile", "member", "identity", "principal"],
    "file": ["document", "path", "stream", "blob", "resource"],
    "search": ["find", "query", "lookup", "filter", "match", "grep"],
    "update": ["modify", "patch", "change", "edit", "mutate", "alter"],
    "serialize": ["encode", "marshal", "dump", "stringify", "format"],
    "deserialize": ["decode", "unmarshal", "load", "parse"],
    "validate": ["check", "verify", "sanitize", "assert", "ensure"],
    "transform": ["convert", "map", "translate", "adapt", "morph"],
    "middleware": ["interceptor", "filter", "hook", "plugin", "handler"],
    "deploy": ["release", "publish", "ship", "rollout", "launch"],
}

# Words appended to a query for each abbreviation or concept in it.
EXPANSIONS = {
    "auth": "authentication authorize login",
    "db": "database data storage",
    "api": "application programming interface endpoint",
    "ui": "user interface frontend view",
    "util": "utility helper function",
    "config": "configuration settings options",
    "async": "asynchronous await promise",
    "sync": "synchronous blocking",
    "func": "function method",
    "var": "variable",
    "param": "parameter argument",
    "init": "initialize setup create",
    "parse": "parsing parser analyze",
    "validate": "validation check verify",
    "handle": "handler process manage",
    "error": "exception failure bug",
    "test": "testing unittest spec",
    "mock": "mocking stub fake",
    "log": "logging logger debug",
    "class": "class object type",
    "method": "method function procedure",
    "property": "property attribute field",
    "import": "import require include",
    "export": "export module public",
    "return": "return yield output",
    "loop": "loop iterate for while",
    "condition": "condition if else branch",
    "array": "array list collection",
    "string": "string text character",
    "number": "number integer float",
    "boolean": "boolean true false",
}

# Technical terms that lower the similarity threshold.
TECHNICAL_TERMS = [
    "javascript", "typescript", "python", "java", "cpp", "rust", "go", "function", "class", "method", "variable", "import",
    "export", "async", "await", "promise", "callback", "api", "database", "parser", "compiler", "interpreter", "syntax",
    "semantic", "mcp", "gateway", "server", "client", "protocol",
]

# Words that mark a package query, and intent words that mark a natural-language query.
PACKAGE_WORDS = ["sdk", "npm", "pip", "pypi", "crate", "package", "library", "lib"]
INTENT_WORDS = [
    "what", "where", "how", "why", "when", "which", "who", "find", "show", "get", "list", "describe", "explain", "return",
    "returns", "purpose", "does", "do", "handle", "handles", "implement", "implements", "used", "use", "fetch", "check",
    "validate", "process", "manage", "create", "build", "compute", "calculate",
]

# Identifier shapes. Word characters are letters and digits of every script.
W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"
DOTTED = rf"{W}[\p{{L}}\p{{N}}_-]*\.[\p{{L}}\p{{N}}_-]+"
CAMEL = rf"(?:^|{NOT_W})(?:[a-z]{W}*[A-Z]|[A-Z][a-z]+[A-Z])"
SCOPED = rf"@{W}[\p{{L}}\p{{N}}_/-]+"
HYPHENATED = rf"{W}+-{W}+-{W}+"
SNAKE = rf"(?:^|{NOT_W})[a-z][a-z0-9]*(?:_[a-z0-9]+)+(?:{NOT_W}|$)"
CAPITALISED = rf"(?:^|{NOT_W})[A-Z][a-zA-Z]*(?:{NOT_W}|$)"
OPERATORS = r"[(){}\[\]=<>!&|+\-*/\\;:@#%^~`]"

# Query types by contained words, first match wins.
QUERY_TYPES = [
    ("function_search", ["function", "method", "def", "func"]),
    ("class_search", ["class", "object", "type"]),
    ("error_handling", ["error", "exception", "bug", "fix"]),
    ("testing", ["test", "spec", "mock"]),
    ("configuration", ["config", "setting", "option"]),
]


def _has_word(ws: Column, vocabulary: list[str]) -> Column:
    return F.arrays_overlap(ws, F.array(*[F.lit(w) for w in vocabulary]))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def adaptive_threshold(text: Column, base: float = 0.2) -> Column:
    """Similarity threshold from the shape of the query; the first rule that fits decides."""
    n = word_count(text)
    low = max(0.01, base - 0.29)
    return (
        F.when((n == 1) | contains_any(F.lower(text), TECHNICAL_TERMS), low)
        .when(n <= 3, max(0.1, base - 0.1))
        .when(n > 6, min(0.8, base + 0.1))
        .when(text.rlike(CAPITALISED) | F.contains(text, F.lit("_")), max(0.05, base - 0.25))
        .when(contains_any(text, ["()", ".", "->", "=>", "::"]), max(0.25, base - 0.1))
        .otherwise(max(0.15, base))
    )


def preprocess_query(text: Column) -> Column:
    """Lower-case words with their expansions, first occurrences only."""
    table = F.map_from_arrays(
        F.array(*[F.lit(k) for k in EXPANSIONS]),
        F.array(*[F.split(F.lit(v), " ") for v in EXPANSIONS.values()]),
    )
    nothing = F.array().cast("array<string>")
    grown = F.transform(words(text), lambda w: F.concat(F.array(w), F.coalesce(F.element_at(table, w), nothing)))
    return F.array_join(F.array_distinct(F.flatten(grown)), " ")


def expand_query(text: Column) -> Column:
    """The query and its variants, one synonym substituted per variant (array, original first)."""
    forward = {k: v for k, v in SYNONYMS.items()}
    backward = {s: k for k, group in SYNONYMS.items() for s in group}
    options = {**{s: [k] for s, k in backward.items() if s not in forward}, **forward}
    table = F.map_from_arrays(
        F.array(*[F.lit(k) for k in options]),
        F.array(*[F.split(F.lit(" ".join(v)), " ") for v in options.values()]),
    )
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    nothing = F.array().cast("array<string>")

    def variants(token: Column, pos: Column) -> Column:
        return F.transform(
            F.coalesce(F.element_at(table, F.lower(token)), nothing),
            lambda s: F.array_join(F.transform(tokens, lambda t, i: F.when(i == pos, s).otherwise(t)), " "),
        )

    return F.array_distinct(F.concat(F.array(text), F.flatten(F.transform(tokens, variants))))


def is_identifier_query(text: Column) -> Column:
    shapes = any_of([text.rlike(p) for p in (DOTTED, CAMEL, SCOPED, HYPHENATED)])
    return shapes | _has_word(words(text), PACKAGE_WORDS)


def is_nl_query(text: Column) -> Column:
    ws = words(text)
    code = text.rlike(OPERATORS) | text.rlike(CAMEL) | text.rlike(SNAKE)
    return ~code & (F.size(ws) > 0) & (_has_word(ws, INTENT_WORDS) | (F.size(ws) >= 4))


def query_type(text: Column) -> Column:
    out = None
    for name, needles in QUERY_TYPES:
        test = contains_any(F.lower(text), needles)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("general")


def confidence(text: Column) -> Column:
    n = word_count(text)
    return F.when((n == 1) | (n > 10), "low").otherwise("high")


# Follow-up terms for a query without results.
RELATED_TERMS = {
    "auth": ["login", "user", "session", "token"],
    "database": ["query", "model", "schema", "connection"],
    "api": ["endpoint", "request", "response", "handler"],
    "test": ["mock", "assert", "spec", "unit"],
    "error": ["exception", "handle", "catch", "debug"],
}


def suggest_without_results(text: Column) -> Column:
    """Suggestions from the query alone: first two related terms of each known word, not asked already, at most five."""
    table = F.map_from_arrays(
        F.array(*[F.lit(k) for k in RELATED_TERMS]),
        F.array(*[F.array(*[F.lit(x) for x in v[:2]]) for v in RELATED_TERMS.values()]),
    )
    ws = words(text)
    nothing = F.array().cast("array<string>")
    found = F.flatten(F.transform(ws, lambda w: F.coalesce(F.element_at(table, w), nothing)))
    return F.slice(F.array_except(F.array_distinct(found), ws), 1, 5)
