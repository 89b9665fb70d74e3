"""Toxicity: a linear classifier on character n-grams with naive Bayes scaling.

A document's features are the distinct character n-grams (4 to 6 code points,
white space as one space, lower case) of its whole text, hashed to BUCKETS.
Each is scaled by its naive Bayes log-count ratio between the labels, and by one
over the root of the text's length, before logistic regression learns its
weight; both labels weigh as much as the root of their share. The FEATURES
n-grams that speak most for label 1 take part: those of LEAST documents with it
or more, by their ratio times the root of these documents' number.

Defined results: null and empty texts have no n-grams and get the score of the
bias alone; without labels of both kinds every score is the share of label 1,
or 0.5 without any; repeated rows are scored one by one; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .sample import bucket, labelled

SIZES, BITS, FEATURES = (4, 5, 6), 20, 16384
BUCKETS = 1 << BITS
#: Documents to learn from at most; documents with label 1 that an n-gram needs; characters below which texts count as equally long.
LEARN_ROWS, LEAST, SHORT = 8000, 3, 100
#: Characters that are looked at together.
BLOCK = 1 << 18
THRESHOLD = 0.7


def cleaned(text: str) -> str:
    """Lower case, with one space between words and on either side."""
    return " " + " ".join(text.lower().split()) + " "


def pieces(texts: list[str]):
    """Groups of about BLOCK characters, as lists of (text's number, piece): a longer text is cut into overlapping pieces, which have all its n-grams."""
    group, size = [], 0
    for k, t in enumerate(texts):
        for i in range(0, max(1, len(t) - SIZES[-1] + 1), BLOCK):
            piece = t[i : i + BLOCK + SIZES[-1] - 1]
            if group and size + len(piece) > BLOCK:
                yield group
                group, size = [], 0
            group.append((k, piece))
            size += len(piece)
    if group:
        yield group


def grams(group: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every n-gram of pieces of cleaned texts, one array each."""
    points = np.frombuffer("".join(p for _, p in group).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = np.array([len(p) for _, p in group], np.int64)
    owner = np.repeat(np.array([k for k, _ in group], np.int64), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))  # characters from here to the piece's end
    h = np.zeros(len(points), np.uint64)
    found, whose = [], []
    mult = np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, SIZES[-1] + 1):
        h = h[: max(0, len(points) - n + 1)] * mult + points[n - 1 :] + np.uint64(n)
        if n in SIZES:
            ok = left[: len(h)] >= n
            mixed = (h ^ (h >> np.uint64(29))) * mult
            found.append((mixed >> np.uint64(64 - BITS)).astype(np.int32)[ok])
            whose.append(owner[: len(h)][ok])
    return np.concatenate(whose), np.concatenate(found)


def features(text: str) -> tuple[np.ndarray, int]:
    """The distinct buckets of a text's n-grams, and its length."""
    text = cleaned(text)
    found = [np.unique(grams(g)[1]) for g in pieces([text])]
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0], len(text)


def by_length(size: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(size, SHORT))


def choose(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that speak most for label 1, and their log-count ratios, from each bucket's documents of either kind; one is added to each count."""
    ratio = np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))
    strength = np.where(toxic >= min(LEAST, n_toxic), np.maximum(ratio, 0) * np.sqrt(toxic), 0)
    chosen = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
    return chosen, ratio[chosen]


def members(chosen: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS, bool)
    out[chosen] = True
    return out


class Linear:
    def __init__(self) -> None:
        self.weight, self.bias, self.prior, self.unit, self.trained = np.zeros(BUCKETS, np.float32), 0.0, 0.5, 1.0, False

    def fit(self, texts: list[str], labels: np.ndarray) -> "Linear":
        both, y = [features(t) for t in texts], np.asarray(labels, np.float64)
        kinds = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
        for (f, _), label in zip(both, y):
            kinds[int(label)][f] += 1
        chosen, scale = choose(kinds[1], kinds[0], y.sum(), (1 - y).sum())
        known = members(chosen)
        return self.learn([f[known[f]] for f, _ in both], np.array([n for _, n in both]), y, chosen, scale)

    def learn(self, found: list[np.ndarray], size: np.ndarray, labels: np.ndarray, chosen: np.ndarray, scale: np.ndarray, rounds: int = 150, penalty: float = 1.0) -> "Linear":
        """found: those of the chosen buckets that each document has; size: the documents' lengths."""
        y = np.asarray(labels, np.float64)
        self.prior = float(y.mean()) if len(y) else 0.5
        if len(y) == 0 or y.min() == y.max():
            return self
        self.unit = float(by_length(size).mean())
        doc, col = np.repeat(np.arange(len(y)), [len(f) for f in found]), np.searchsorted(chosen, np.concatenate(found))
        value = scale[col] * (by_length(size) / self.unit)[doc]
        heavy = np.where(y > 0, np.sqrt((1 - y).sum() / y.sum()), 1.0)
        heavy /= heavy.mean()
        # Adam on the mean logistic loss with a ridge penalty
        w, b = np.zeros(len(chosen)), np.zeros(())
        m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
        for t in range(1, rounds + 1):
            z = np.bincount(doc, value * w[col], len(y)) + b
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * heavy
            grad = np.append(np.bincount(col, value * error[doc], len(chosen)) + penalty * w, error.sum()) / len(y)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            move = 0.02 * (1 - 0.9 * t / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
            w, b = w - move[:-1], b - move[-1]
        self.weight[chosen] = w * scale
        self.known = members(chosen)
        self.bias, self.trained = float(b), True
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), self.prior)
        clean, both = [cleaned(t) for t in texts], [np.zeros(0, np.int64)]
        for group in pieces(clean):
            owner, found = grams(group)
            own = self.known[found]
            both.append(np.unique(owner[own] * BUCKETS + found[own]))
        pair = np.unique(np.concatenate(both))  # each n-gram once per text
        z = np.bincount(pair // BUCKETS, self.weight[pair % BUCKETS], len(texts)) * by_length(np.array([len(t) for t in clean])) / self.unit + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", rows: int = LEARN_ROWS) -> Linear:
    """Learn from at most ``rows`` labelled documents, of each the whole text."""

    def count(batches):
        kinds, n = np.zeros((2, BUCKETS), np.int32), [0, 0]
        for b in batches:
            for text, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                kinds[label][features(text)[0]] += 1
                n[label] += 1
        yield pa.RecordBatch.from_arrays([pa.array([n[0]], pa.int64()), pa.array([n[1]], pa.int64()), pa.array([kinds.tobytes()], pa.binary())], ["clean", "toxic", "kinds"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = stage(lambda: labelled(docs, labels, label, learn, rows).select("doc_id", "text", "label").repartition(4, "doc_id"))
    kinds, n = np.zeros((2, BUCKETS)), np.zeros(2)
    for r in sample.mapInArrow(count, "clean long, toxic long, kinds binary").toLocalIterator():  # four rows of two counters per bucket
        kinds += np.frombuffer(bytes(r.kinds), np.int32).reshape(2, BUCKETS)
        n += r.clean, r.toxic
    chosen, scale = choose(kinds[1], kinds[0], n[1], n[0])

    def own(batches):
        known = members(chosen)
        for b in batches:
            both = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([n for _, n in both], pa.int64()), pa.array([f[known[f]].astype(np.int32).tobytes() for f, _ in both], pa.binary())], ["doc_id", "label", "size", "found"])

    found = sample.mapInArrow(own, f"doc_id {kind}, label int, size long, found binary").toArrow().sort_by("doc_id")
    return Linear().learn([np.frombuffer(x.as_py(), np.int32) for x in found.column("found")], found.column("size").to_numpy(), found.column("label").to_numpy(), chosen, scale)


def score(docs: DataFrame, model: Linear) -> DataFrame:
    """doc_id and score of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score([t or "" for t in b.column(1).to_pylist()]), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = bucket(F.col("doc_id"), 3) == 1
    model = fit(docs, table(spark, sf_dir, "labels"), ~held)
    return score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
