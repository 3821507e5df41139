"""Language identification by interpolated Kneser-Ney models over characters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import bounded_sample, map_texts, small_batches
from siftwell.runtime import cut_lineage, drop_written, number_in_group

ORDER = 3
#: Share of the calibration documents that must be accepted.
ACCEPT = 0.995
#: Characters of a text that are counted at a time.
BLOCK = 1 << 18
UNKNOWN = "und"
_WIDTH = 21  # bits of a code point; ORDER of them fit into 63 bits


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letters_of(before: np.ndarray, text: str, last: bool) -> np.ndarray:
    """``before`` and the code points of the text, with one blank for each run of other characters, and one behind the ``last`` part."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.concatenate([before, np.where(_letters()[codes], codes, 32), np.full(int(last), 32)])
    return codes[(codes != 32) | np.concatenate([[True], codes[:-1] != 32])]


def grams_of(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed n-grams of ORDER characters of a UTF-8 text in lower case, sorted, and how often each occurs.

    The text has a blank at either end and in place of other characters. It is taken in parts, of which each goes on from the last characters of
    the one before. A text without letters has none.
    """
    text = (data or b"").decode(errors="replace").lower()
    keys, counts, tail = [], [], np.full(1, 32)
    for i in range(0, len(text), BLOCK):
        codes = letters_of(tail, text[i : i + BLOCK], i + BLOCK >= len(text))
        tail = codes[-ORDER + 1 :]
        if len(codes) >= ORDER:
            packed = sum(codes[j : len(codes) - ORDER + 1 + j] << (_WIDTH * (ORDER - 1 - j)) for j in range(ORDER))
            k, c = np.unique(packed, return_counts=True)
            keys.append(k)
            counts.append(c)
    if len(keys) <= 1:
        return (keys[0], counts[0]) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return _added(np.concatenate(keys), np.concatenate(counts))


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all texts; each task adds up its own n-grams before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                keys, counts = _added(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(keys), pa.string()), "gram": keys, "n": counts})
            held.clear()

        size = 0
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                grams = grams_of(data.as_py())
                held.setdefault(name, []).append(grams)
                size += len(grams[0])
                if size > 2_000_000:
                    yield from sums()
                    size = 0
        yield from sums()

    small_batches(docs)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Sorted n-grams with a probability per language (one column each), and contexts with their back-off weights."""

    grams: np.ndarray
    probs: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


@dataclass
class Model:
    languages: list[str]
    levels: list[Level] = field(default_factory=list)
    base: float = 1.0
    scale: float = 1.0
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))
    floor: float = 0.0


def _suffix(grams: np.ndarray, n: int) -> np.ndarray:
    return grams & ((1 << (_WIDTH * n)) - 1)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key, -1 where it is missing."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _probabilities(model: Model, grams: np.ndarray, n: int) -> np.ndarray:
    """Interpolated probability of the last character of each n-gram, per language."""
    if n == 0:
        return np.full((len(grams), len(model.languages)), model.base)
    level = model.levels[n - 1]
    at = _find(level.grams, grams)
    out = level.probs[at] if len(level.grams) else np.zeros((len(grams), len(model.languages)))
    missing = np.flatnonzero(at < 0)
    if len(missing):
        place = _find(level.contexts, grams[missing] >> _WIDTH)
        weight = np.where(place[:, None] >= 0, level.weights[place], 1.0) if len(level.contexts) else 1.0
        out[missing] = weight * _probabilities(model, _suffix(grams[missing], n - 1), n - 1)
    return out


def train(counts: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Kneser-Ney model of (language, packed n-grams, counts); the lower orders count distinct characters before an n-gram.

    The discount of an order is n1 / (n1 + 2 n2). An n-gram that a language lacks has
    the back-off weight of its context times the next lower order; the lowest order is
    mixed with a uniform share for every character that any language has, and one more.
    """
    counts = sorted(counts, key=lambda x: x[0])
    model = Model([name for name, _, _ in counts])
    chars = np.unique(np.concatenate([_suffix(g, 1) for _, g, _ in counts])) if counts else np.zeros(0)
    model.base = 1.0 / (len(chars) + 1)
    for n in range(1, ORDER + 1):
        tables = [(g, c) if n == ORDER else np.unique(_suffix(np.unique(_suffix(g, n + 1)), n), return_counts=True) for _, g, c in counts]
        grams = np.unique(np.concatenate([g for g, _ in tables])) if tables else np.zeros(0, np.int64)
        contexts, of = np.unique(grams >> _WIDTH, return_inverse=True)
        probs, weights = np.empty((len(grams), len(tables))), np.ones((len(contexts), len(tables)))
        lower = _probabilities(model, _suffix(grams, n - 1), n - 1)
        for k, (own, c) in enumerate(tables):
            full = np.zeros(len(grams))
            full[np.searchsorted(grams, own)] = c
            once, twice = (full == 1).sum(), (full == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total = np.bincount(of, weights=full, minlength=len(contexts))
            kinds = np.bincount(of, weights=full > 0, minlength=len(contexts))
            weights[:, k] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            probs[:, k] = np.maximum(full - discount, 0) / np.maximum(total[of], 1) + weights[of, k] * lower[:, k]
        model.levels.append(Level(grams, probs, contexts, weights))
    return model


def entropies(model: Model, data: bytes | None) -> np.ndarray | None:
    """Bits per character of a text under each language; None without letters."""
    grams, counts = grams_of(data)
    if not len(grams) or not model.languages:
        return None
    return counts @ -np.log2(_probabilities(model, grams, ORDER)) / counts.sum()


def _scores(scale: float, bits: np.ndarray) -> np.ndarray:
    """Share of each language when one bit per character less makes it exp(scale) times as likely."""
    weight = np.exp(-scale * (bits - bits.min(axis=-1, keepdims=True)))
    return weight / weight.sum(axis=-1, keepdims=True)


def _quantiles(values: DataFrame, shares: dict[int, float]) -> dict[int, float]:
    """Exact quantile of the ``value`` of each group ``of`` at its share, between the two nearest places in order, which are all that is fetched."""
    sizes = {r["of"]: r["n"] for r in values.groupBy("of").agg(F.count("*").alias("n")).collect()}
    at = {k: shares[k] * (n - 1) for k, n in sizes.items()}
    places = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, [int(at[k]) + 1, min(int(at[k]) + 2, n)])])
    ranked = number_in_group(values.withColumn("nth", F.monotonically_increasing_id()), ["of"], ["value", "nth"], "place")
    found: dict[int, list[tuple[int, float]]] = {}
    for r in ranked.where(F.array_contains(F.try_element_at(places, F.col("of")), F.col("place").cast("int"))).collect():
        found.setdefault(r["of"], []).append((r["place"], r["value"]))
    return {k: float(np.interp(at[k] + 1, *zip(*sorted(rows), strict=True))) for k, rows in found.items()}


def calibrate(model: Model, docs: DataFrame) -> Model:
    """Set the scale that makes the true languages of all rows of ``docs`` (lang, text) most likely, and the limits that accept ACCEPT of them.

    Bits per character are measured in one pass and written; losses are added up by Spark, limits are places in its order.
    """
    model.limits = np.full(len(model.languages), np.inf)
    if not model.languages:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(texts: list[bytes | None]) -> tuple[list, ...]:
        return ([None if bits is None else bits.tolist() for bits in (entropies(shared.value, t) for t in texts)],)

    truth = F.array_position(F.array(*map(F.lit, model.languages)), F.col("lang")).cast("int") - 1
    rows = cut_lineage(map_texts(docs, "text", ("lang",), "bits array<double>", measured).where("bits is not null").select(truth.alias("truth"), "bits"))
    least, own = F.array_min("bits"), F.get("bits", F.col("truth"))
    total = lambda scale: F.aggregate("bits", F.lit(0.0), lambda acc, b: acc + F.exp(-scale * (b - least)))
    scales = [2.0**i for i in range(-2, 7)]
    losses = [F.avg(-F.log(F.greatest(F.exp(-s * (own - least)) / total(s), F.lit(1e-12)))) for s in scales]
    means = rows.agg(*losses).first()
    if means[0] is None:
        return model
    model.scale = scales[int(np.argmin(means))]
    values = F.array(F.struct(F.col("truth").alias("of"), own.alias("value")), F.struct(F.lit(-1).alias("of"), (1 / total(model.scale)).alias("value")))
    limits = _quantiles(rows.select(F.inline(values)), {-1: 1 - ACCEPT, **dict.fromkeys(range(len(model.languages)), ACCEPT)})
    model.floor = limits.pop(-1)
    for k, limit in limits.items():
        model.limits[k] = limit
    drop_written(rows)
    return model


def predict(model: Model, data: bytes | None) -> tuple[str, float, bool]:
    """Language of a text, its score and whether it is rejected as unlike all languages."""
    bits = entropies(model, data)
    if bits is None:
        return UNKNOWN, 0.0, True
    best = int(np.argmin(bits))
    score = float(_scores(model.scale, bits)[best])
    return model.languages[best], score, bool(bits[best] > model.limits[best] or score < model.floor)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", max_grams: int | None = None, calibration_rows: int | None = None) -> Model:
    """Model of all labelled texts of ``docs``, calibrated on all of them; only its n-gram table comes to the driver.

    All n-grams are kept; if there are more than ``max_grams`` rows of them (None: no limit), nothing is learned
    and a ValueError says so. With ``calibration_rows`` scores and limits are set on about so many rows of any length. Null languages and null
    texts teach nothing, repeated rows count each time, of several names of a language each is a language, an
    empty table gives a model that knows none, and other columns are ignored.
    """
    counts = cut_lineage(gram_counts(docs, text, lang))
    if max_grams is not None and (total := counts.count()) > max_grams:
        raise ValueError(f"{total} n-grams of all languages, more than max_grams={max_grams}")
    table = counts.toArrow()
    langs = table.column("lang").combine_chunks().dictionary_encode()
    of, grams, numbers = langs.indices.to_numpy(zero_copy_only=False), table.column("gram").to_numpy(), table.column("n").to_numpy()
    parts = []
    for k, name in enumerate(langs.dictionary.to_pylist()):
        mine = np.flatnonzero(of == k)
        mine = mine[np.argsort(grams[mine])]
        parts.append((name, grams[mine], numbers[mine]))
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = usable.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return calibrate(train(parts), rows if calibration_rows is None else bounded_sample(rows, calibration_rows))


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` with lang_pred, score (0 to 1) and rejected.

    A null text or one without letters is ``und`` with score 0 and rejected; so is every text if
    nothing was learned. ``rejected`` also marks texts that fit their language worse than
    the calibration allows; their best language is still given. The prediction sees nothing but the text, which is read in parts however
    long it is; repeated rows are repeated, kept columns named like the added ones are replaced, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(texts: list[bytes | None]) -> tuple[list, ...]:
        rows = [predict(shared.value, t) for t in texts]
        return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

    return map_texts(docs, text, keep, "lang_pred string, score double, rejected boolean", found)
