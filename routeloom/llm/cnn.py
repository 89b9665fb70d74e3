"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes slide over the whole UTF-8 text. Their activations are
max-pooled in chunks of 2 * STEP bytes that overlap by half; the chunks' pooled
vectors are combined over the document by mean, maximum and minimum, and two
small layers make one probability of them. The network is trained here, by
Adam, on a sample of at most LEARN_ROWS labelled documents. Training and scoring
read whole texts.

Defined results: null and empty texts count as one chunk of padding and get
that chunk's score; without labels of both kinds every score is the share of
label 1 among them, or 0.5 without any; repeated rows are scored one by one;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table
from .sample import bucket, labelled

#: Filters, their width in bytes, half a chunk, hidden units.
FILTERS, WIDTH, STEP, HIDDEN = 16, 5, 256, 16
#: Documents to learn from at most.
LEARN_ROWS = 4000
#: Bytes that are looked at together when scoring.
BLOCK = 1 << 20
#: Bytes whose activations are held at a time, a multiple of STEP.
PIECE = 1 << 14
THRESHOLD = 0.3
#: Steps that a small sample is repeated for.
LEAST_STEPS = 300


def _pad(raw: bytes) -> bytes:
    """To whole steps, one at least, with zeros at both ends: a filter never sees two texts."""
    raw = b"\0" * (WIDTH - 1) + raw
    return raw.ljust(-(-(len(raw) + WIDTH - 1) // STEP) * STEP, b"\0")


def _activations(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Every filter at every byte; the last WIDTH-1 bytes see zeros beyond the end."""
    x = np.concatenate([x, np.zeros(WIDTH - 1, np.uint8)])
    n = len(x) - WIDTH + 1
    out = w[0][x[:n]]
    for j in range(1, WIDTH):
        out += w[j][x[j : j + n]]
    return out


def _pool(chunk: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean, maximum and minimum of the chunks of each document; first: where each begins."""
    count = np.diff(np.append(first, len(chunk)))[:, None]
    return np.concatenate([np.add.reduceat(chunk, first) / count, np.maximum.reduceat(chunk, first), np.minimum.reduceat(chunk, first)], axis=1)


def _chunks(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Maximum over each step and the next one of the same document."""
    after = np.append(steps[1:], steps[-1:], axis=0)
    last = np.append(first[1:], len(steps)) - 1
    after[last] = steps[last]
    return np.maximum(steps, after)


class Network:
    def __init__(self, prior: float = 0.5, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.prior, self.trained, self.pairs = prior, False, None
        self.p = {
            "w": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "h": rng.normal(0, 1 / np.sqrt(3 * FILTERS), (3 * FILTERS, HIDDEN)).astype(np.float32),
            "c": np.zeros(HIDDEN, np.float32),
            "o": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32),
            "d": np.zeros(1, np.float32),
        }

    def _head(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(z @ self.p["h"] + self.p["c"], 0)
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.p["o"] + self.p["d"][0], -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 of each whole text, in blocks of bounded size."""
        if not self.trained:
            return np.full(len(texts), self.prior)
        out, group, size = [], [], 0
        for raw in [*texts, None]:
            if group and (raw is None or size + len(raw) > BLOCK):
                out.append(self._score(group))
                group, size = [], 0
            if raw is not None:
                group.append(_pad(raw))
                size += len(group[-1])
        return np.concatenate(out) if out else np.zeros(0)

    def _score(self, padded: list[bytes]) -> np.ndarray:
        w = self.p["w"]
        if self.pairs is None:  # two bytes at a time: a sum of two look-ups each
            self.pairs = [(w[j][:, None] + w[j + 1][None]).reshape(1 << 16, FILTERS) for j in range(0, WIDTH - 1, 2)]
        x = np.frombuffer(b"".join(padded) + b"\0" * (WIDTH - 1), np.uint8)
        steps = np.empty(((len(x) - WIDTH + 1) // STEP, FILTERS), np.float32)
        act, more = (np.empty((PIECE, FILTERS), np.float32) for _ in range(2))
        for a in range(0, len(x) - WIDTH + 1, PIECE):
            c = x[a : a + PIECE + WIDTH - 1].astype(np.intp)
            n, both = len(c) - WIDTH + 1, (c[:-1] << 8) | c[1:]
            for k, pair in enumerate(self.pairs):
                np.take(pair, both[2 * k : 2 * k + n], axis=0, out=(more if k else act)[:n], mode="clip")
                if k:
                    act[:n] += more[:n]
            if WIDTH % 2:
                np.take(w[-1], c[WIDTH - 1 : WIDTH - 1 + n], axis=0, out=more[:n], mode="clip")
                act[:n] += more[:n]
            top, half = act[:n].reshape(-1, STEP, FILTERS), STEP
            while half > 16:
                half //= 2
                top = np.maximum(top[:, :half], top[:, half : 2 * half])
            steps[a // STEP : (a + n) // STEP] = top.max(axis=1)
        steps = np.maximum(steps + self.p["b"], 0)
        first = np.concatenate([[0], np.cumsum([len(p) // STEP for p in padded])[:-1]]).astype(np.int64)
        return self._head(_pool(_chunks(steps, first), first))[1].astype(np.float64)

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 32, seed: int = 11) -> "Network":
        y = np.asarray(labels, np.float32)
        if len(y) == 0 or y.min() == y.max():
            self.prior = float(y.mean()) if len(y) else 0.5
            return self
        epochs = max(epochs, -(-LEAST_STEPS * batch // len(y)))
        rng, padded = np.random.default_rng(seed), [_pad(t) for t in texts]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        t, total = 0, epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                some = order[i : i + batch]
                grads = self._gradients([padded[k] for k in some], y[some])
                t += 1
                rate = 0.01 * (1 - 0.9 * t / total)
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        self.trained = True
        return self

    def _gradients(self, padded: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        p, x = self.p, np.frombuffer(b"".join(padded), np.uint8)
        where, raw = np.empty((len(x) // STEP, FILTERS), np.int64), np.empty((len(x) // STEP, FILTERS), p["w"].dtype)
        for a in range(0, len(x), PIECE):  # of activations, only the largest of a step is kept
            ahead = x[a : a + PIECE + WIDTH - 1]
            act = _activations(p["w"], ahead)[: len(x[a : a + PIECE])].reshape(-1, STEP, FILTERS)
            own = slice(a // STEP, a // STEP + len(act))
            where[own] = act.argmax(axis=1)
            raw[own] = np.take_along_axis(act, where[own][:, None], 1)[:, 0] + p["b"]
        steps = np.maximum(raw, 0)
        first = np.concatenate([[0], np.cumsum([len(b) // STEP for b in padded])[:-1]]).astype(np.int64)
        doc = np.repeat(np.arange(len(padded)), [len(b) // STEP for b in padded])
        chunk = _chunks(steps, first)
        z = _pool(chunk, first)
        hidden, prob = self._head(z)
        dz_out = (prob - y) / len(y)
        grads = {"o": hidden.T @ dz_out, "d": dz_out.sum(keepdims=True)}
        dh = np.outer(dz_out, p["o"]) * (hidden > 0)
        grads |= {"h": z.T @ dh, "c": dh.sum(0)}
        dz = dh @ p["h"].T
        mean, top, low = dz[:, :FILTERS], dz[:, FILTERS : 2 * FILTERS], dz[:, 2 * FILTERS :]
        count = np.bincount(doc)[:, None]
        dchunk = (mean / count)[doc]
        for part, extreme in ((top, z[:, FILTERS : 2 * FILTERS]), (low, z[:, 2 * FILTERS :])):
            same = chunk == extreme[doc]
            dchunk += part[doc] * same / np.maximum(np.add.reduceat(same.astype(np.float32), first), 1)[doc]
        # a chunk hands its gradient to whichever of its two steps was larger
        dsteps = np.zeros_like(steps)
        own = steps >= chunk
        dsteps += dchunk * own
        dsteps[1:] += (dchunk * ~own)[:-1]
        dsteps *= raw > 0
        at = where + np.arange(len(steps))[:, None] * STEP
        longer = np.concatenate([x, np.zeros(WIDTH - 1, np.uint8)])
        column = np.broadcast_to(np.arange(FILTERS), at.shape)
        dw = np.zeros_like(p["w"])
        for j in range(WIDTH):
            dw[j] = np.bincount((longer[at + j].astype(np.int64) * FILTERS + column).ravel(), weights=dsteps.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
        return {k: g.astype(np.float32) for k, g in (grads | {"w": dw, "b": dsteps.sum(0)}).items()}


def fit(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", rows: int = LEARN_ROWS) -> Network:
    """Learn from at most ``rows`` labelled documents, of each the whole text."""
    found = labelled(docs, labels, label, learn, rows).select("doc_id", F.col("text").cast("binary").alias("raw"), "label").collect()  # rows documents at most
    found.sort(key=lambda r: r.doc_id)
    return Network().fit([bytes(r.raw) for r in found], np.array([r.label for r in found]))


def score(docs: DataFrame, model: Network) -> DataFrame:
    """doc_id and score of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(texts), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def accept(docs: DataFrame, model: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in b.column(at).to_pylist()]
            kept = b.filter(pa.array(model.score(texts) >= threshold))
            del texts, b
            give_back()
            yield kept

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = bucket(F.col("doc_id"), 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels"), ~held)
    return score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
