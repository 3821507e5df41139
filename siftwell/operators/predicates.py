"""Filters built as Column predicates, so that they reach the scan."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as tx

# What marks a test path and a test name.
TEST_PATH = (
    r"(?i)(^|/)tests?/|(^|/)__tests__/|(^|/)spec/|(^|/)test_[^/]+\.(py|js|ts|rb|go|java|cs|cpp|rs)$"
    r"|(^|/)[^/]+_test\.(py|js|ts|rb|go|java|cs|cpp|rs)$|(^|/)[^/]+\.spec\.(js|ts|jsx|tsx)$|(^|/)[^/]+_spec\.(rb|py)$|(^|/)conftest\.py$"
)
TEST_NAME = r"(?i)^(test_|Test[A-Z]|it_|describe_|should_)"
# Hidden folders that are indexed all the same.
ALLOWED_HIDDEN = [".github", ".gitlab-ci", ".circleci"]
GRADES = ["A", "B", "C", "D", "F"]


def _all(tests: list[Column]) -> Column:
    return reduce(and_, tests, F.lit(True))


def where_filters(df: DataFrame, filters: dict[str, object], where_extra: str | None = None) -> DataFrame:
    """Equality for scalars, membership for lists, nothing for None; all ANDed with a raw fragment."""
    tests = []
    for name, value in filters.items():
        if isinstance(value, (list, tuple, set)):
            tests.append(F.col(name).isin(list(value)))
        elif value is not None:
            tests.append(F.col(name) == F.lit(value))
    if where_extra:
        tests.append(F.expr(where_extra))
    return df.filter(_all(tests))


def query_predicate(filters: dict[str, object]) -> Column:
    """Predicate of the richer dialect: lists, ``'!x'``, ``$eq $ne $gt $gte $lt $lte $in $nin``, ``$and`` / ``$or``."""
    ops = {
        "$eq": lambda c, v: c == F.lit(v),
        "$ne": lambda c, v: c != F.lit(v),
        "$gt": lambda c, v: c > F.lit(v),
        "$gte": lambda c, v: c >= F.lit(v),
        "$lt": lambda c, v: c < F.lit(v),
        "$lte": lambda c, v: c <= F.lit(v),
        "$in": lambda c, v: c.isin(list(v)),
        "$nin": lambda c, v: ~c.isin(list(v)),
    }
    tests = []
    for name, value in filters.items():
        if name == "$and":
            tests.append(_all([query_predicate(f) for f in value]))
        elif name == "$or":
            tests.append(reduce(or_, [query_predicate(f) for f in value], F.lit(False)))
        elif isinstance(value, dict):
            tests += [ops[op](F.col(name), v) for op, v in value.items()]
        elif isinstance(value, list):
            tests.append(F.col(name).isin(value))
        elif isinstance(value, str) and value.startswith("!"):
            tests.append(F.col(name) != F.lit(value[1:]))
        else:
            tests.append(F.col(name) == F.lit(value))
    return _all(tests)


def query_filters(df: DataFrame, filters: dict[str, object] | None) -> DataFrame:
    return df.filter(query_predicate(filters)) if filters else df


def is_test_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/").rlike(TEST_PATH)


def filter_tests_only(df: DataFrame, path: str = "file_path", name: str | None = None) -> DataFrame:
    test = is_test_path(F.col(path))
    if name is not None:
        test = test | F.coalesce(F.col(name).rlike(TEST_NAME), F.lit(False))
    return df.filter(test)


def filter_path_glob(df: DataFrame, pattern: str, path: str = "file_path") -> DataFrame:
    """Whole path or base name matches a shell pattern."""
    rx = tx.glob_regex(pattern)
    return df.filter(F.col(path).rlike(rx) | tx.basename(F.col(path)).rlike(rx))


def grade_set(spec: str) -> list[str]:
    """``'A,C'`` or ``'A-C'`` to grades."""
    allowed: set[str] = set()
    for part in (p.strip().upper() for p in spec.split(",")):
        first, _, last = part.partition("-")
        ends = [x.strip() for x in ([first, last] if last else [first])]
        if all(x in GRADES for x in ends):
            places = sorted(GRADES.index(x) for x in ends)
            allowed |= set(GRADES[places[0] : places[-1] + 1])
    return sorted(allowed)


def filter_quality(df: DataFrame, max_complexity: int | None = None, no_smells: bool = False, grade: str | None = None, min_quality: int | None = None) -> DataFrame:
    """Quality limits; a row without the metric passes."""
    tests = []
    keep = lambda c, test: F.col(c).isNull() | test
    if max_complexity is not None:
        tests.append(keep("cognitive_complexity", F.col("cognitive_complexity") <= max_complexity))
    if no_smells:
        tests.append(keep("smell_count", F.col("smell_count") == 0))
    if grade:
        tests.append(keep("complexity_grade", F.col("complexity_grade").isin(grade_set(grade))))
    if min_quality is not None:
        tests.append(keep("quality_score", F.col("quality_score") >= min_quality))
    return df.filter(_all(tests))


def file_filter(df: DataFrame, ignore_patterns: list[str], force_include: list[str] | None = None, exclude_globs: list[str] | None = None, suffixes: list[str] | None = None, skip_hidden: bool = True, path: str = "file_path") -> DataFrame:
    """Paths to index: forced globs win, then component patterns, path globs, hidden parts and suffixes.

    All component patterns become one regular expression, tested once per component.
    """
    p = F.col(path)
    parts = F.split(p, "/")
    forced = tx.any_of([p.rlike(tx.path_glob_regex(g)) for g in force_include or []])
    ignored = tx.any_of([p.rlike(tx.path_glob_regex(g)) for g in exclude_globs or []])
    if ignore_patterns:
        rx = "^(?s)(?:" + "|".join(tx.glob_regex(g)[5:-1] for g in ignore_patterns) + ")$"
        ignored = ignored | F.exists(parts, lambda x: x.rlike(rx))
    if skip_hidden:
        ignored = ignored | F.exists(parts, lambda x: F.startswith(x, F.lit(".")) & ~x.isin(ALLOWED_HIDDEN))
    keep = forced | ~ignored
    if suffixes:
        keep = keep & tx.suffix(p).isin([s.lower() for s in suffixes])
    return df.filter(keep)
