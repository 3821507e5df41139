"""Code-metric row functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Upper bounds of grades A–D; anything above is F.
COMPLEXITY_GRADES = [("A", 5), ("B", 10), ("C", 20), ("D", 30)]
CHUNK_QUALITY_GRADES = [("A", 5), ("B", 10), ("C", 20), ("D", 50)]
INSTABILITY_GRADES = [("A", 0.2), ("B", 0.4), ("C", 0.6), ("D", 0.8)]
GRADE_POINTS = {"A": 100, "B": 80, "C": 60, "D": 40, "F": 20}

# Smell limits.
LONG_METHOD_LINES = 50
HIGH_COGNITIVE = 15
DEEP_NESTING = 4
MANY_PARAMETERS = 5
HIGH_CYCLOMATIC = 10
GOD_CLASS_METHODS = 20
GOD_CLASS_LINES = 500


def ladder(value: Column, bounds: list[tuple[str, float]], top: str) -> Column:
    """First label whose inclusive upper bound holds ``value``, else ``top``."""
    out = None
    for label, bound in bounds:
        out = F.when(value <= bound, label) if out is None else out.when(value <= bound, label)
    return out.otherwise(top)


def grade(cognitive: Column) -> Column:
    return ladder(cognitive, COMPLEXITY_GRADES, "F")


def stability_grade(instability: Column) -> Column:
    return ladder(instability, INSTABILITY_GRADES, "F")


def stability_category(instability: Column) -> Column:
    return ladder(instability, [("Stable", 0.3), ("Balanced", 0.7)], "Unstable")


def complexity_step(avg: Column, steps: tuple[float, float, float, float]) -> Column:
    """Deduction by average complexity: over 30, 20, 10, 5."""
    return (
        F.when(avg > 30, steps[0]).when(avg > 20, steps[1]).when(avg > 10, steps[2]).when(avg > 5, steps[3]).otherwise(0.0)
    )


def file_health(avg: Column, smells: Column, total_lines: Column, comment_lines: Column) -> Column:
    """Health 0–1: complexity step, 0.05 per smell up to 0.3, 0.1 for an odd comment share."""
    ratio = comment_lines / F.nullif(total_lines, F.lit(0))
    odd = F.when((ratio < 0.1) | (ratio > 0.5), 0.1).otherwise(0.0)
    score = 1.0 - complexity_step(avg, (0.5, 0.3, 0.2, 0.1)) - F.least(F.lit(0.3), smells * 0.05) - odd
    return F.greatest(F.lit(0.0), score)


def project_health(avg: Column, smells: Column) -> Column:
    """Whole-number health 0–100 of a snapshot."""
    score = 100.0 - complexity_step(avg, (50.0, 30.0, 20.0, 10.0)) - F.least(F.lit(30), smells * 5)
    return F.greatest(F.lit(0), F.floor(score).cast("int"))


def smells(cognitive: Column, cyclomatic: Column, nesting: Column, parameters: Column, lines: Column) -> Column:
    """Array of the smells of one function: name, severity, metric_value, threshold."""

    def item(name: str, test: Column, value: Column, limit: int) -> Column:
        return F.when(
            test,
            F.struct(
                F.lit(name).alias("name"),
                F.lit("warning").alias("severity"),
                value.cast("double").alias("metric_value"),
                F.lit(float(limit)).alias("threshold"),
            ),
        )

    return F.array_compact(
        F.array(
            item("Long Method", (lines > LONG_METHOD_LINES) | (cognitive > HIGH_COGNITIVE), F.greatest(lines, cognitive), LONG_METHOD_LINES),
            item("Deep Nesting", nesting > DEEP_NESTING, nesting, DEEP_NESTING),
            item("Long Parameter List", parameters > MANY_PARAMETERS, parameters, MANY_PARAMETERS),
            item("Complex Method", cyclomatic > HIGH_CYCLOMATIC, cyclomatic, HIGH_CYCLOMATIC),
        )
    )


def halstead(n1: Column, n2: Column, big_n1: Column, big_n2: Column) -> dict[str, Column]:
    """Halstead measures from distinct / total operators and operands."""
    vocabulary = n1 + n2
    length = big_n1 + big_n2
    volume = F.when((vocabulary == 0) | (length == 0), 0.0).otherwise(length * F.log2(vocabulary))
    difficulty = F.when((n2 == 0) | (vocabulary == 0) | (length == 0), 0.0).otherwise((n1 / 2) * (big_n2 / n2))
    effort = difficulty * volume
    return {
        "vocabulary": vocabulary,
        "length": length,
        "volume": volume,
        "difficulty": difficulty,
        "effort": effort,
        "time_seconds": effort / 18,
        "estimated_bugs": volume / 3000,
    }


def chunk_smell_count(kind: Column, lines: Column, parameters: Column, nesting: Column, cyclomatic: Column) -> Column:
    """Smells counted in a chunk view: size, parameters, nesting, branches, huge class."""
    tests = [
        lines > 50,
        parameters > 5,
        nesting > 4,
        cyclomatic > 10,
        (kind == "class") & (lines > 500),
    ]
    return sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))


def effective_complexity(cyclomatic: Column, complexity: Column, lines: Column) -> Column:
    """Cyclomatic if known, else the stored score, else one point per five lines (at least one)."""
    rough = F.greatest(F.lit(1.0), lines / 5)
    stored = F.when(F.coalesce(complexity, F.lit(0.0)) == 0, rough).otherwise(complexity)
    return F.coalesce(cyclomatic.cast("double"), stored)


def chunk_quality(effective: Column, smell_count: Column) -> Column:
    base = F.greatest(F.lit(0.0), 1.0 - F.least(effective / 50.0, F.lit(1.0)))
    return F.round(F.greatest(F.lit(0.0), base - smell_count * 0.1), 2)


def chunk_grade(effective: Column) -> Column:
    return ladder(effective, CHUNK_QUALITY_GRADES, "F")


def quality_score(grade_col: Column, smell_count: Column) -> Column:
    """0–100 from a grade, ten points off per smell, twenty more when there is none; null without a grade."""
    base = F.lit(0)
    for g, points in GRADE_POINTS.items():
        base = F.when(grade_col == g, points).otherwise(base)
    n = F.coalesce(smell_count, F.lit(0))
    raw = base - n * 10 + F.when(n == 0, 20).otherwise(0)
    return F.when(grade_col.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), raw)))


def threshold_position(value: Column, threshold: Column) -> dict[str, Column]:
    """Share of a threshold in percent, its class and severity."""
    pct = F.when(threshold > 0, value / F.nullif(threshold, F.lit(0.0)) * 100).otherwise(0.0)
    label = (
        F.when(pct < 50, "well_below").when(pct < 100, "below").when(pct <= 110, "at_threshold").when(pct <= 150, "above").otherwise("well_above")
    )
    severity = F.when(pct < 100, "info").when(pct <= 150, "warning").otherwise("error")
    return {"percentage": pct, "comparison": label, "severity": severity}


def percent_change(old: Column, new: Column) -> Column:
    """Change in percent; from zero it counts as 100 % up (or down)."""
    return F.when(old == 0, F.when(new > 0, 100.0).when(new < 0, -100.0).otherwise(0.0)).otherwise((new - old) / old * 100)


