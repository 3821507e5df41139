"""Mixing sources to target weights: token weights raked to several marginals, then a sample by calibrated chances."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.llm.common import lower_ascii, set_aside
from siftwell.runtime import cut_lineage

#: What a missing source or language counts as.
MISSING = "(none)"
#: Exponent of the tokens of a value whose targets are not given: below 1, large values give way to small ones.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Share of all tokens that the sample should hold, rounds of raking, and the seed of the draw.
SHARE, ROUNDS, SEED = 0.5, 12, 9

Targets = Mapping[str, float | Mapping[str, float]]


def topic_of(text: Column) -> Column:
    """A coarse topic by what a text holds: licence terms, tables, contacts, else prose; ``(none)`` if it is null."""
    low = lower_ascii(text)
    kind = F.when(F.contains(low, F.lit("licen")), "licence").when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("@")), "contact")
    return F.when(text.isNull(), MISSING).otherwise(kind.otherwise("prose"))


def tokens_of(text: Column) -> Column:
    """Words between ASCII blanks; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def chance_of(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id and the seed only."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def _targets(cells: DataFrame, name: str, wanted: float | Mapping[str, float], goal: float) -> DataFrame:
    """(name, goal of name): the tokens wanted of each value; given shares are scaled to the values that occur."""
    if isinstance(wanted, Mapping):
        known = [v for k, x in wanted.items() for v in (F.lit(k), F.lit(float(x)))]
        amount = F.coalesce(F.create_map(*known)[F.col(name)], F.lit(0.0)) if known else F.lit(0.0)
        values = cells.groupBy(name).agg(F.sum("tokens").alias("_t")).withColumn("_a", F.when(F.col("_t") > 0, amount).otherwise(0.0))
    else:
        values = cells.groupBy(name).agg(F.sum("tokens").alias("_t")).withColumn("_a", F.pow(F.col("_t"), F.lit(float(wanted))))
        values = values.withColumn("_a", F.when(F.col("_t") > 0, F.col("_a")).otherwise(0.0))
    everything = values.agg(F.sum("_a")).first()[0] or 1.0
    return values.select(name, (F.col("_a") / everything * goal).alias(f"goal_{name}"))


def rake(cells: DataFrame, targets: Targets, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (one column per name in ``targets``, and tokens) with ``weight``, the tokens to take of each.

    Iterative proportional fitting with a bound: each round scales the weights to the
    goals of one marginal after the other and then holds every cell to the tokens that it
    has. The cells are small sums, written once a round. A value without tokens or
    without a goal gets weight 0; goals that the bounds don't allow are met as far as they do.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goal = float(total) * share
    with_goals = cells
    for name, wanted in targets.items():
        with_goals = with_goals.join(_targets(cells, name, wanted, goal), name)
    current = cut_lineage(with_goals.withColumn("weight", F.col("tokens") * F.lit(float(share))))
    for _ in range(rounds):
        for name in targets:
            own = F.sum("weight").over(Window.partitionBy(name))
            current = current.withColumn("weight", F.when(own > 0, F.col("weight") * F.col(f"goal_{name}") / own).otherwise(0.0))
        current = cut_lineage(current.withColumn("weight", F.least("weight", F.col("tokens").cast("double"))))
    return current


def mix(docs: DataFrame, targets: Targets = POWERS, share: float = SHARE, rounds: int = ROUNDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", topic: Column | None = None) -> DataFrame:
    """``docs`` with topic, tokens, probability and kept.

    ``targets`` gives, for source, lang and topic (or any other columns), an exponent for
    tempered shares or a share per value. Documents are summed to cells before any
    shuffle, the cells raked, and a document is kept by a hash of its id with the chance
    weight / tokens of its cell (1 in a cell without tokens). Missing values are a value of their own, null
    texts have no tokens, rows that share an id share its draw, an empty table gives no rows, and
    columns named like the added ones are replaced. Beside the cells, nothing is shuffled unless the
    cells outgrow a broadcast.
    """
    marked = docs.withColumns({"topic": topic if topic is not None else topic_of(F.col(text)), "tokens": tokens_of(F.col(text))})
    keys = {f"_key_{name}": F.coalesce(F.col(name).cast("string"), F.lit(MISSING)) for name in targets}
    marked = marked.withColumns(keys)
    cells = cut_lineage(marked.groupBy(*[F.col(k).alias(k.removeprefix("_key_")) for k in keys]).agg(F.sum("tokens").alias("tokens")))
    raked = rake(cells, targets, share, rounds).select(*[F.col(name).alias(f"_key_{name}") for name in targets], F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0).alias("probability"))
    found = marked.drop("probability", "kept").join(raked, list(keys)).withColumn("kept", chance_of(F.col(doc_id), seed) < F.col("probability"))
    return found.drop(*keys)


def sample(docs: DataFrame, targets: Targets = POWERS, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that ``mix`` keeps, with the columns of ``docs``."""
    rows, back = set_aside(docs, [doc_id, text, *(name for name in targets if name != "topic")])
    return mix(rows, targets, doc_id=doc_id, text=text, **options).where("kept").select(*back)
