"""Toxicity grades by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import map_texts, set_aside, small_batches
from siftwell.llm.decontaminate import words_of
from siftwell.runtime import cut_lineage

#: Severity grades: 0 is clean, the others split toxic documents by how much of the telling features they hold.
GRADES = 4
#: Features that a model may have, and the least deviation (in standard errors) that a feature needs.
MAX_FEATURES, LEAST_Z = 4096, 4.0
#: Penalty of the square of the strongest feature's weight; a feature tied less firmly pays more.
PENALTY = 0.02
#: Labelled documents on which the weights are fitted: about so many.
TRAINING_ROWS = 20_000
#: Expected chance of being above grade 0 from which a document counts as toxic.
CUT = 0.5
_GRAMS = (4, 5)
_CACHE = 200_000


def word_features(word: bytes) -> set[str]:
    """A word and its runs of characters, word ends marked."""
    text = f"^{word.decode(errors='replace')}$"
    return {text[i : i + n] for n in _GRAMS for i in range(len(text) - n + 1)} | {text}


class Cache:
    """Features of words (or their numbers in ``only``), dropped as a whole when there are too many words."""

    def __init__(self, only: dict[str, int] | None = None):
        self.only, self.known = only, {}

    def __getitem__(self, word: bytes) -> list:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= _CACHE:
                self.known.clear()
            names = word_features(word)
            found = sorted(names) if self.only is None else [self.only[f] for f in names if f in self.only]
            self.known[word] = found
        return found


def _word_counts(data: bytes | None) -> Counter:
    counts: Counter = Counter()
    for block in words_of(data):
        counts.update(block)
    return counts


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean): labelled texts of each kind that have the feature. ``rows``: toxic, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sums = Cache(), (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list({*sums[0], *sums[1]})
            out = pa.RecordBatch.from_pydict({"feature": pa.array(keys, pa.string()), "toxic": pa.array([sums[1][k] for k in keys], pa.int64()), "clean": pa.array([sums[0][k] for k in keys], pa.int64())})
            for s in sums:
                s.clear()
            return out

        for batch in batches:
            for toxic, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                sums[toxic].update({f for w in _word_counts(data.as_py()) for f in cache[w]})
                if len(sums[0]) + len(sums[1]) > 400_000:
                    yield flush()
        yield flush()

    small_batches(rows)
    return rows.select("toxic", "text").mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass
class Model:
    """Weights shared by all thresholds; ``thresholds`` rise, one for each step between grades."""

    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, np.inf))
    cache: Cache | None = field(default=None, compare=False)

    def words(self) -> Cache:
        """The features of the words met so far, kept as long as the task's process."""
        if self.cache is None:
            self.cache = Cache(self.features)
        return self.cache


def features_of(cache: Cache, data: bytes | None) -> tuple[list[int], list[float]]:
    """Numbers of the model's features in a text, and log(1 + occurrences) of each."""
    found: dict[int, int] = {}
    for word, n in _word_counts(data).items():
        for f in cache[word]:
            found[f] = found.get(f, 0) + n
    return list(found), [float(np.log1p(n)) for n in found.values()]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, penalty: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights w and rising thresholds t of P(grade > k) = sigmoid(w.x - t_k), by penalised likelihood (a penalty per feature).

    The thresholds are a first one and positive steps (their logarithms are fitted), so
    they stay ordered. Adam steps over the whole sample, summed without its order mattering.
    """
    n, n_features, steps = len(grades), len(penalty), GRADES - 2
    above = np.array([max(0.5, (grades > k).sum()) for k in range(GRADES - 1)])
    start = np.log(np.maximum(n - above, 0.5) / above)
    theta = np.concatenate([np.zeros(n_features), [start[0]], np.log(np.maximum(np.diff(start), 0.1))])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        w, t = theta[:n_features], theta[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(theta[n_features + 1 :]))])
        score = np.bincount(rows, weights=values * w[columns], minlength=n)
        edges = _sigmoid(score[:, None] - np.concatenate([[-np.inf], t, [np.inf]]))
        upper, lower = edges[np.arange(n), grades], edges[np.arange(n), grades + 1]
        chance = np.maximum(upper - lower, 1e-12)
        up, low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        by_threshold = np.array([up[grades == k + 1].sum() - low[grades == k].sum() for k in range(GRADES - 1)])
        slope = np.concatenate([
            np.bincount(columns, weights=values * (low - up)[rows], minlength=n_features) + penalty * w,
            [by_threshold.sum()],
            [by_threshold[k + 1 :].sum() * np.exp(theta[n_features + 1 + k]) for k in range(steps)],
        ])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta - 0.1 * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
    return theta[:n_features], theta[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(theta[n_features + 1 :]))])


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", training_rows: int = TRAINING_ROWS) -> Model:
    """Model from documents with a toxic label of 0 or 1 (others, null ids and null texts teach nothing).

    The model is fitted on about ``training_rows`` labelled documents, taken by hashed id
    (all if there are no more), so that their ids can be broadcast and no text is shuffled. The features
    are the MAX_FEATURES most tied to the label of those at least LEAST_Z standard errors over
    chance, in three texts or more. Toxic documents are graded 1 to GRADES - 1 by the quantiles
    of how much of such features they hold. A document labelled both ways is toxic. Without both kinds of
    label the model finds nothing toxic.
    """
    marks = labels.where(F.col(toxic).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(toxic).cast("int").alias("toxic"))
    share = min(1.0, training_rows / max(1, marks.count()))
    taken = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    known = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(taken), "_id")
    known = cut_lineage(known)
    both = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not both["toxic"] or both["n"] == both["toxic"]:
        return Model()
    share = both["toxic"] / both["n"]
    seen = F.col("toxic") + F.col("clean")
    tied = feature_counts(known).where(seen >= 3).withColumn("z", (F.col("toxic") - seen * share) / F.sqrt(seen * share * (1 - share))).where(F.col("z") >= LEAST_Z)
    chosen = tied.orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).select("feature", "z").collect()
    if not chosen:
        return Model()
    only, strength = {r["feature"]: i for i, r in enumerate(chosen)}, np.array([r["z"] for r in chosen])
    shared = docs.sparkSession.sparkContext.broadcast(Model(only))

    def found(texts: list[bytes | None]) -> tuple[list, ...]:
        rows = [features_of(shared.value.words(), t) for t in texts]
        return [r[0] for r in rows], [r[1] for r in rows]

    table = map_texts(known, "text", ("_id", "toxic"), "at array<int>, x array<double>", found).toArrow().sort_by([("_id", "ascending")])
    sizes = table.column("at").combine_chunks().value_lengths().to_numpy()
    rows = np.repeat(np.arange(len(sizes)), sizes)
    columns, values = table.column("at").combine_chunks().flatten().to_numpy(), table.column("x").combine_chunks().flatten().to_numpy()
    is_toxic = table.column("toxic").to_numpy()
    amount = np.bincount(rows, weights=np.expm1(values) * strength[columns], minlength=len(sizes))
    bounds = np.quantile(amount[is_toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1)) if is_toxic.any() else np.zeros(GRADES - 2)
    grades = np.where(is_toxic == 1, 1 + np.searchsorted(bounds, amount, "left"), 0)
    weights, thresholds = fit(rows, columns, values, grades, PENALTY * (strength.max() / strength) ** 2)
    return Model(only, weights, thresholds)


def severity(model: Model, data: bytes | None) -> tuple[float, int, float]:
    """Expected grade, likeliest grade, and the chance of being above grade 0 of a text."""
    at, values = features_of(model.words(), data)
    score = float(np.dot(model.weights[at], values)) if at else 0.0
    above = _sigmoid(score - model.thresholds)
    return float(above.sum()), int(np.argmax(-np.diff(np.concatenate([[1.0], above, [0.0]])))), float(above[0])


def grade(docs: DataFrame, model: Model, keep: tuple[str, ...] | list[str] = ("doc_id",), text: str = "text", cut: float = CUT) -> DataFrame:
    """Columns ``keep`` with severity (expected grade), grade (likeliest), toxic_chance and toxic (chance of ``cut`` or more).

    Null and empty texts have no features; nor has any text under a model that learned
    nothing, whose severity is 0. Repeated rows are repeated, an empty table gives no rows,
    kept columns named like the added ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(texts: list[bytes | None]) -> tuple[list, ...]:
        rows = [severity(shared.value, t) for t in texts]
        return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[2] >= cut for r in rows]

    return map_texts(docs, text, list(keep), "severity double, grade int, toxic_chance double, toxic boolean", found)


def remove_toxic(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` without those that ``grade`` calls toxic."""
    rows, back = set_aside(docs, [text])
    return grade(rows, model, rows.columns, text, cut).where("not toxic").select(*back)
