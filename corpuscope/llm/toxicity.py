"""Toxicity scores from a counterfactual-regularised classifier.

A logistic regression over the words of a text and their beginnings (4 to 7 characters), each counted as present or absent. Training takes
labelled texts; in every labelled sentence that names a group, the identity term is swapped for another of its kind, and once for none, and the
squared changes of the score are added to the loss. Neither a mention of a group nor which one it is then moves the score much, whatever the labels say.

Feature counts are made by Spark over the training texts; the most telling features and the training rows' feature numbers, both of
bounded size (``FEATURES``, ``SAMPLE``), are fitted on the driver, and the weights are shipped to score all texts.

Cases: a null or empty text has no features and gets the score of the prior; rows whose label is null or that have no text row are not learned
from; a document with several labels counts as toxic if any says so; equal rows get equal scores; without any training row every
score is low and nothing is rejected; a null doc_id is not held out. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.base import map_text, row_key

#: bounds of the fit: labelled rows (the lowest hashes of doc_id) and features
SAMPLE, FEATURES = 20_000, 6_000
#: a feature needs so many rows, and log odds so many standard errors from none
LEAST_ROWS, LEAST_TOLD = 4, 2.5
RIDGE, SWAP_PENALTY, STEPS, RATE = 1e-4, 5.0, 300, 0.5
FOLDS = 5
BEGINNINGS = (4, 5, 6, 7)

# --- fixed values: identity terms by kind, the members of a kind can stand for each other -------
IDENTITY = (
    ("woman", "man", "girl", "boy"), ("women", "men", "girls", "boys"), ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "straight", "bisexual", "queer"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("black", "white", "asian", "latino", "african"),
    ("immigrant", "refugee", "native", "foreigner"), ("immigrants", "refugees", "natives", "foreigners"), ("disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden"), ("schwule", "lesben"), ("ausländer", "einwanderer", "flüchtlinge"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres", "niñas", "niños"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "refugiados", "extranjeros"),
)
# ------------------------------------------------------------------------------------------------
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def other_term(identity: tuple[tuple[str, ...], ...] = IDENTITY) -> dict[str, str]:
    return {term: kind[(i + 1) % len(kind)] for kind in identity for i, term in enumerate(kind)}


def word_features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in BEGINNINGS if len(word) >= k)]


def features(text: str | None) -> set[str]:
    return {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}


def swapped(text: str | None, other: dict[str, str]) -> list[tuple[list[str], list[str]]]:
    """Per sentence with identity terms and each of its twins (swapped, or without them): the features it has and the twin has not, and the reverse."""
    out = []
    for sentence in _SENTENCE.findall((text or "").lower()):
        words = _WORD.findall(sentence)
        if not other.keys().isdisjoint(words):
            own, *twins = ({f for w in ws for f in word_features(w)} for ws in (words, [other.get(w, w) for w in words], [w for w in words if w not in other]))
            out.extend((sorted(own - twin), sorted(twin - own)) for twin in twins)
    return out


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


class Model:
    """Weights by feature; ``known`` remembers the weighted features of words."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def score(self, text: str | None) -> float:
        hit: set[str] = set()
        known = self.known
        for word in set(_WORD.findall((text or "").lower())):
            found = known.get(word)
            if found is None:
                if len(known) > 500_000:
                    known.clear()
                found = known[word] = tuple(f for f in word_features(word) if f in self.weights)
            if found:
                hit.update(found)
        total = self.bias + math.fsum(self.weights[f] for f in hit)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "known": {}}


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``toxic``, ``text`` of at most ``sample`` labelled ids outside the held-out fold."""
    usable = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"]))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # bounded by ``sample``
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])


def fit(docs: DataFrame, labels: DataFrame, identity: tuple[tuple[str, ...], ...] = IDENTITY, sample: int = SAMPLE, count: int = FEATURES,
        penalty: float = SWAP_PENALTY) -> Model:
    other = other_term(identity)
    rows = training_rows(docs, labels, sample)
    parts = map_text(rows, "text", "found array<string>, swaps array<struct<own:array<string>,twin:array<string>>>", lambda texts: [
        (sorted(features(t)), [{"own": a, "twin": b} for a, b in swapped(t, other)]) for t in texts]).persist()
    try:
        totals = {r["toxic"]: r["n"] for r in parts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        toxic, clean = totals.get(1, 0), totals.get(0, 0)
        if not toxic or not clean:
            return Model({}, -10.0)
        each = parts.select("toxic", F.explode("found").alias("feature")).groupBy("feature").agg(
            F.sum("toxic").alias("a"), F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS)
        a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
        odds = F.log(a / (toxic + 1 - a)) - F.log(b / (clean + 1 - b))
        best = each.withColumn("told", F.abs(odds) / F.sqrt(1 / a + 1 / b)).where(F.col("told") >= LEAST_TOLD).orderBy(F.desc("told"), "feature").limit(count)
        names = sorted({r["feature"] for r in best.select("feature").collect()} | {f for w in other for f in word_features(w)})
        number = {f: i for i, f in enumerate(names)}
        shared = docs.sparkSession.sparkContext.broadcast(number)
        coded = map_text(parts, "found", "x array<int>", lambda lists: [(sorted(shared.value[f] for f in fs if f in shared.value),) for fs in lists])
        kept = coded.select("doc_id", "toxic", "x", F.transform("swaps", lambda s: s["own"]).alias("own"),
                            F.transform("swaps", lambda s: s["twin"]).alias("twin")).collect()
        shared.destroy()
    finally:
        parts.unpersist()
    kept.sort(key=lambda r: (r["doc_id"], r["toxic"], r["x"]))
    deltas = []
    for r in kept:
        for own, twin in zip(r["own"], r["twin"], strict=True):
            deltas.append(([number[f] for f in own if f in number], [number[f] for f in twin if f in number]))
    weights, bias = descend([r["x"] for r in kept], np.array([r["toxic"] for r in kept], float), deltas, len(names), penalty)
    return Model({f: float(w) for f, w in zip(names, weights, strict=True) if w}, bias)


def descend(rows: list[list[int]], y: np.ndarray, deltas: list[tuple[list[int], list[int]]], width: int, penalty: float) -> tuple[np.ndarray, float]:
    """Adagrad on mean log loss + ridge + ``penalty`` x mean squared score change of the swaps."""
    flat = lambda parts: (np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.array([j for p in parts for j in p], np.int64))
    at, col = flat(rows)
    own_at, own = flat([d[0] for d in deltas])
    twin_at, twin = flat([d[1] for d in deltas])
    w, n = np.zeros(width), len(y)
    bias = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    seen, seen_bias = np.full(width, 1e-8), 1e-8
    for _ in range(STEPS):
        total = np.bincount(at, w[col], n) + bias
        wrong = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - y) / n
        slope = np.bincount(col, wrong[at], width) + RIDGE * w
        if deltas:
            change = (np.bincount(own_at, w[own], len(deltas)) - np.bincount(twin_at, w[twin], len(deltas))) * (2 * penalty / len(deltas))
            slope += np.bincount(own, change[own_at], width) - np.bincount(twin, change[twin_at], width)
        seen += slope * slope
        seen_bias += wrong.sum() ** 2
        w -= RATE * slope / np.sqrt(seen)
        bias -= RATE * wrong.sum() / math.sqrt(seen_bias)
    return w, float(bias)


def with_scores(rows: DataFrame, column: str, model: Model) -> DataFrame:
    """``rows`` with ``score`` in place of the text ``column``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights and those of the identity terms
    return map_text(rows, column, "score double", lambda texts: [(shared.value.score(t),) for t in texts])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: ``doc_id``, ``text_hash``, ``held_out``, ``score`` and ``predicted``."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), row_key(docs)["text_hash"].alias("text_hash"), docs["text"].cast("string").alias("text"))
    return with_scores(rows, "text", model).select(
        "doc_id", "text_hash", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
