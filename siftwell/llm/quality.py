"""Quality scores from weak labels: overlapping heuristics, their accuracies by EM, and a hashed linear scorer."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from siftwell.llm.common import bounded_sample, map_texts, word_blocks
from siftwell.runtime import cut_lineage

#: Buckets of the hashed features.
BUCKETS = 1 << 14
#: Documents on which the scorer is fitted: about so many.
TRAINING_ROWS = 20_000
#: Score from which a document is kept.
CUT = 0.5
GOOD, BAD, NONE = 1, 0, -1

#: Labellers that call a text bad if a measure is beyond a limit and have no vote otherwise.
FAULTS = (("symbols", 0.08), ("odd_words", 0.3), ("capitals", 0.3), ("echoes", 0.15), ("repeats", 0.85), ("top_word", 0.5), ("sentence", 60))
#: Labellers that call a text good if all their measures are within limits and have no vote otherwise.
MERITS = (
    (("symbols", 0.04), ("odd_words", 0.15)),
    (("echoes", 0.02), ("repeats", 0.5), ("top_word", 0.3)),
    (("capitals", 0.12), ("sentence", 40)),
)
N_LABELLERS = len(FAULTS) + len(MERITS)
_ODD = re.compile(rb"[^\w\s.,;:?\"'()\x80-\xff-]")


@lru_cache(maxsize=200_000)
def shape(word: bytes) -> str:
    """A word with its runs of letters and digits as signs: a, Aa, A, 9; marks stay, runs of one mark are one."""
    text = word.decode(errors="replace")
    text = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a", text)
    return re.sub(r"([^\w])\1+", r"\1+", re.sub(r"\d+", "9", text))


@lru_cache(maxsize=200_000)
def _bucket(name: str) -> int:
    return xxhash.xxh64_intdigest(name) % BUCKETS


def measures(data: bytes | None) -> tuple[dict[str, float], dict[int, float]]:
    """What the labellers read of a text, and its hashed features (shares of shapes, pairs of shapes and coarse measures)."""
    text = data or b""
    words: Counter = Counter()
    pairs: list[np.ndarray] = []
    shapes: Counter = Counter()
    total = echoes = n_pairs = ends = 0
    last: bytes | None = None
    for block in word_blocks(text):
        words.update(block)
        total += len(block)
        chain = block if last is None else [last, *block]
        echoes += sum(map(bytes.__eq__, chain, chain[1:]))
        n_pairs += len(chain) - 1
        pairs.append(np.unique(np.fromiter(map(hash, zip(chain, chain[1:])), np.int64, max(len(chain) - 1, 0))))
        last = chain[-1] if chain else last
    for word, n in words.items():
        shapes[shape(word)] += n
        ends += n * word.endswith((b".", b"!", b"?"))
    letters = sum(map(len, words)) if total else 0
    capitals = sum(n for s, n in shapes.items() if s.startswith("A") and not s.startswith("Aa"))
    odd = sum(n for s, n in shapes.items() if s.strip("Aa9.,;:?'\"()-+ÄÖÜ") != "" or not any(c in "Aa9" for c in s))
    n = max(total, 1)
    values = {
        "symbols": len(_ODD.findall(text)) / max(len(text), 1),
        "capitals": capitals / n,
        "echoes": echoes / max(n_pairs, 1),
        "repeats": 1 - len(np.unique(np.concatenate(pairs))) / n_pairs if n_pairs else 0.0,
        "top_word": max(words.values(), default=0) / n if total >= 20 else 0.0,
        "words": total,
        "sentence": total / max(ends, 1),
        "odd_words": odd / n,
    }
    features: dict[int, float] = {}
    for name, share in [*((f"s:{s}", c / n) for s, c in shapes.items()), *((f"m:{k}:{min(9, int(10 * v))}", 1.0) for k, v in values.items() if k not in ("words", "sentence"))]:
        at = _bucket(name)
        features[at] = features.get(at, 0.0) + share
    features[_bucket(f"w:{min(total, 1 << 20).bit_length()}")] = 1.0
    features[_bucket(f"e:{int(values['sentence']).bit_length()}")] = 1.0
    return values, features


def votes_of(values: dict[str, float]) -> list[int]:
    """One vote per labeller: GOOD, BAD or NONE."""
    faults = [BAD if values[name] > limit else NONE for name, limit in FAULTS]
    return faults + [GOOD if values["words"] and all(values[name] <= limit for name, limit in parts) else NONE for parts in MERITS]


#: Chances of a missing, a bad and a good vote on bad and on good documents from which the estimation starts.
START = ((0.6, 0.3, 0.1), (0.38, 0.02, 0.6))


@dataclass
class LabelModel:
    """Share of good documents, and the chance of each vote (NONE, BAD, GOOD) of each labeller on bad and on good ones."""

    prior: float = 0.5
    chance: np.ndarray = field(default_factory=lambda: np.repeat(np.array(START)[:, None, :], N_LABELLERS, axis=1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance that a document with these votes (one row each) is good."""
        ratio = np.log(self.chance[1] / self.chance[0])
        return _sigmoid(np.log(self.prior / (1 - self.prior)) + ratio[np.arange(N_LABELLERS), votes - NONE].sum(axis=1))

    @property
    def accuracy(self) -> np.ndarray:
        """Chance that a vote of each labeller is right, where it votes."""
        right = self.prior * self.chance[1, :, 2] + (1 - self.prior) * self.chance[0, :, 1]
        return right / (right + self.prior * self.chance[1, :, 1] + (1 - self.prior) * self.chance[0, :, 2])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_labels(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and how many documents have each.

    Votes are taken as independent given the truth, and a missing vote is an outcome like
    the others. The start says which side is good; ten imagined documents of each kind,
    spread like it, keep chances off 0.
    """
    model = LabelModel()
    start = model.chance
    for _ in range(rounds if counts.sum() else 0):
        good = model.posterior(votes)
        chance = np.empty_like(start)
        for y, share in ((1, good), (0, 1 - good)):
            weight = counts * share
            cast = np.stack([(weight[:, None] * (votes == v)).sum(axis=0) for v in (NONE, BAD, GOOD)], axis=1)
            chance[y] = (cast + 10 * start[y]) / (weight.sum() + 10)
        done = np.abs(chance - model.chance).max() < 1e-9
        model = LabelModel(float(np.clip((counts * good).sum() / counts.sum(), 0.01, 0.99)), chance)
        if done:
            break
    return model


def fit_scorer(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, target: np.ndarray, penalty: float = 0.5, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights and intercept for chances as targets; Adam over the whole sample."""
    theta = np.zeros(BUCKETS + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        miss = _sigmoid(np.bincount(rows, weights=values * theta[columns], minlength=len(target)) + theta[-1]) - target
        slope = np.concatenate([np.bincount(columns, weights=values * miss[rows], minlength=BUCKETS) + penalty * theta[:-1], [miss.sum()]])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta - 0.05 * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
    return theta[:-1], float(theta[-1])


@dataclass
class Model:
    labels: LabelModel
    weights: np.ndarray
    intercept: float


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` with votes, and the hashed features of each text (at, x)."""

    def found(texts: list[bytes | None]) -> tuple[list, ...]:
        rows = [measures(t) for t in texts]
        return [votes_of(v) for v, _ in rows], [list(f) for _, f in rows], [list(f.values()) for _, f in rows]

    return map_texts(docs, text, list(keep), "votes array<int>, at array<int>, x array<double>", found)


def learn(rows: DataFrame, training_rows: int = TRAINING_ROWS) -> Model:
    """Label model from the vote patterns of all measured rows, and the scorer from about ``training_rows`` of them.

    The patterns that come to the driver are at most two to the power of the number of labellers.
    """
    patterns = rows.groupBy("votes").count().collect()
    votes = np.array([r["votes"] for r in patterns]).reshape(-1, N_LABELLERS)
    order = np.lexsort(votes.T)
    labels = fit_labels(votes[order], np.array([r["count"] for r in patterns], float)[order])
    table = bounded_sample(rows.select("votes", "at", "x"), training_rows).toArrow()
    if not len(table):
        return Model(labels, np.zeros(BUCKETS), 0.0)
    at = table.column("at").combine_chunks()
    sizes = at.value_lengths().to_numpy()
    target = labels.posterior(table.column("votes").combine_chunks().flatten().to_numpy().reshape(-1, N_LABELLERS))
    return Model(labels, *fit_scorer(np.repeat(np.arange(len(sizes)), sizes), at.flatten().to_numpy(), table.column("x").combine_chunks().flatten().to_numpy(), target))


def score(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", cut: float = CUT, training_rows: int = TRAINING_ROWS) -> tuple[DataFrame, Model]:
    """Columns ``keep`` with weak_label (chance of being good by the votes), quality (the scorer's) and kept, and the model.

    Texts are measured once, without any label, and only their features are kept for the
    two passes. A null text is an empty one; repeated rows weigh as often as they occur;
    an empty table gives no rows and an untrained model; kept columns named like the
    added ones are replaced.
    """
    names = [c for c in keep if c not in ("votes", "at", "x", "weak_label", "quality", "kept")]
    rows = cut_lineage(measured(docs, tuple(names), text))
    model = learn(rows, training_rows)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema), "weak_label double, quality double, kept boolean"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            votes, at, x = (batch.column(c) for c in ("votes", "at", "x"))
            owner = np.repeat(np.arange(len(batch)), at.value_lengths().to_numpy(zero_copy_only=False))
            total = np.bincount(owner, weights=x.flatten().to_numpy() * m.weights[at.flatten().to_numpy()], minlength=len(batch))
            quality = _sigmoid(total + m.intercept)
            weak = m.labels.posterior(votes.flatten().to_numpy().reshape(-1, N_LABELLERS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(weak), pa.array(quality), pa.array(quality >= cut)], [*names, "weak_label", "quality", "kept"])

    return rows.mapInArrow(judge, schema), model
