"""LM scoring: stupid-backoff scores of whole documents by the rest of the corpus.

A word scores c(g w) / c(g) with the longest context g, of up to ORDER - 1 words,
after which the rest of the corpus has it, times BACKOFF for every word that the
context is shorter than it could be; without context c(w) / N; and BACKOFF / N
where the rest of the corpus has no such word. Counts are those of all documents
less the document's own, so that a text is not its own model; N is at least 1.

Words meet as partial counts per batch. The HEAD most frequent words, a fixed
number, are broadcast and become numbers; an n-gram of up to three of them is a
64-bit key, any other a 64-bit hash. Documents become blocks of numbers, written
once. Every block sends its distinct n-grams, with how often it has them, to the
n-gram tables, which are partitioned by hash; they sum the counts and answer
every block, which joins the answers to its exploded n-grams and sums the
scores of each document.

Defined results: a null or empty text has no words, a log score of 0 and a null
mean; rows are documents of their own, also where ids repeat or are null (ids of
any type); further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import by_part, kind_of, pack, pack_sorted, sliced, summed, unpack, unpack_sorted
from .common import collect_garbage, stage, table
from .hashing import BASES, U, Words, left, mixed

BACKOFF, ORDER = 0.4, 3
#: Words that are broadcast (a power of two); words of the corpus per part of an n-gram table.
HEAD, LOAD = 1 << 20, 3_000_000
BITS = 20


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c): how often each word (its hash) occurs in the corpus."""

    def run(batches):
        hasher = Words(1)
        for _, b in sliced(batches, 0):
            h, _ = hasher.words(b.column(0))
            w, c = np.unique(h[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c, pa.int64())], ["w", "c"])

    return docs.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Head:
    """The most frequent words, numbered from the most frequent on: sorted hashes with their numbers, and counts by number."""

    def __init__(self, w: np.ndarray, c: np.ndarray, total: int) -> None:
        self.total, self.c, self.by_number = total, c, w
        self.number = np.argsort(w)
        self.w = w[self.number]

    def place(self, h: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where it is none of these."""
        if not len(self.w):
            return np.full(len(h), -1, np.int64)
        i = np.minimum(np.searchsorted(self.w, h), len(self.w) - 1)
        return np.where(self.w[i] == h, self.number[i], -1)


def _numbered(docs: DataFrame, shared) -> DataFrame:
    """(block, ids, sizes, words, rare): blocks of documents, each word as its number; numbers from HEAD on stand for the block's rare words, whose hashes it keeps."""

    def run(batches):
        hasher, head = Words(1), shared.value
        for block, b in sliced(batches):
            h, size = hasher.words(b.column(1))
            known, where = np.unique(h[0], return_inverse=True)
            number = head.place(known)
            lone = np.flatnonzero(number < 0)
            number[lone] = HEAD + np.arange(len(lone))
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            binary = [pa.array([x], pa.binary()) for x in (pack(size), pack(number[where].astype(np.uint32)), known[lone].tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), ids, *binary], ["block", "ids", "sizes", "words", "rare"])

    kind = kind_of(docs)
    return docs.select("doc_id", "text").mapInArrow(run, f"block long, ids array<{kind}>, sizes binary, words binary, rare binary")


class Grams:
    """The n-grams of a block."""

    def __init__(self, head: Head, sizes: bytes, words: bytes, rare: bytes) -> None:
        self.size, self.word = unpack(sizes, np.int64), unpack(words, np.uint32).astype(np.int64)
        self.rare = np.frombuffer(rare, U)
        self.head, self.ahead = head, left(self.size)
        self.row = np.repeat(np.arange(len(self.size)), self.size)

    def hashes(self) -> np.ndarray:
        every = np.concatenate([self.head.by_number, np.zeros(HEAD - len(self.head.w), U), self.rare])
        return every[self.word]

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the n-grams that a table counts begin, and their keys. Of single words, only rare ones."""
        if n == 1:
            at = np.flatnonzero(self.word >= HEAD)
            return at, self.rare[self.word[at] - HEAD] | U(1 << 63)
        at = np.flatnonzero(self.ahead >= n)
        if n <= 3:
            key, lone = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
            for j in range(n):
                w = self.word[at + j]
                key = key << BITS | w
                lone |= w >= HEAD
            key = key.view(U)
        else:
            key, lone = np.zeros(len(at), U), np.ones(len(at), bool)
        if lone.any():
            h, x = self.hashes(), np.zeros(int(lone.sum()), U)
            for j in range(n):
                x = x * BASES[0] + h[at[lone] + j]
            key[lone] = mixed(x) | U(1 << 63)
        return at, key


def _asked(blocks: DataFrame, shared, order: int, parts: int) -> DataFrame:
    """(n, part, block, keys, counts): distinct n-grams of each block and how often it has them."""

    def run(batches):
        for b in batches:
            for block, sizes, words, rare in zip(*(b.column(i).to_pylist() for i in range(4))):
                grams = Grams(shared.value, sizes, words, rare)
                for n in range(1, order + 1):
                    keys, counts = np.unique(grams.keys(n)[1], return_counts=True)
                    place, edge = by_part(keys, parts)
                    keys, counts = keys[place], counts[place].astype(np.uint32)
                    full = np.flatnonzero(np.diff(edge)).tolist()
                    cut = [slice(edge[p], edge[p + 1]) for p in full]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array([pack_sorted(keys[c]) for c in cut], pa.binary()), pa.array([pack(counts[c]) for c in cut], pa.binary())],
                        ["n", "part", "block", "keys", "counts"],
                    )

    return blocks.select("block", "sizes", "words", "rare").mapInArrow(run, "n int, part int, block long, keys binary, counts binary")


def _answered(asked: DataFrame) -> DataFrame:
    """(block, n, part, counts): how often the corpus has the n-grams, in the order in which a block asks for them."""

    def run(rows: pa.Table) -> pa.Table:
        counts = summed([unpack_sorted(x) for x in rows["keys"].to_pylist()], [unpack(x, np.uint32).astype(np.int64) for x in rows["counts"].to_pylist()])
        return pa.table([rows["block"], rows["n"], rows["part"], pa.array([pack(c) for c in counts], pa.binary())], ["block", "n", "part", "counts"])

    return asked.groupBy("n", "part").applyInArrow(run, "block long, n int, part int, counts binary")


def _rest(key: np.ndarray, row: np.ndarray, corpus) -> np.ndarray:
    """Of every n-gram, how often the corpus has it outside its document. ``corpus`` gives the counts of the sorted distinct keys."""
    order = np.argsort(key, kind="stable")  # keeps the documents of equal keys together
    k, r = key[order], row[order]
    if not len(k):
        return np.zeros(0, np.int64)
    new = np.append(True, k[1:] != k[:-1])
    first = np.flatnonzero(new | np.append(True, r[1:] != r[:-1]))
    own = np.repeat(np.diff(np.append(first, len(k))), np.diff(np.append(first, len(k))))
    out = np.empty(len(k), np.int64)
    out[order] = corpus(k[new])[np.cumsum(new) - 1] - own
    return out


def _log_scores(grams: Grams, counted: dict[int, np.ndarray], order: int, parts: int) -> np.ndarray:
    """The log score of each document of a block; ``counted`` has, by n, the tables' answers part by part."""
    head, words = grams.head, len(grams.word)
    rest = np.zeros((order + 1, words), np.int64)  # by the place of the last word

    def answers(n: int):
        def of(keys: np.ndarray) -> np.ndarray:
            out = np.empty(len(keys), np.int64)
            out[by_part(keys, parts)[0]] = counted[n]
            return out

        return of

    common = np.flatnonzero(grams.word < HEAD)
    rest[1, common] = _rest(grams.word[common].view(U), grams.row[common], lambda k: head.c[k.astype(np.int64)])
    for n in range(1, order + 1):
        at, key = grams.keys(n)
        rest[n, at + n - 1] = _rest(key, grams.row[at], answers(n))
    others = np.maximum(head.total - grams.size, 1)[grams.row]
    possible = np.minimum(np.arange(words) - (np.cumsum(grams.size) - grams.size)[grams.row] + 1, order)
    value = np.log(BACKOFF) * possible - np.log(others)
    for n in range(1, order + 1):
        seen = np.flatnonzero(rest[n] > 0)
        given = others[seen] if n == 1 else rest[n - 1, seen - 1]
        value[seen] = np.log(rest[n, seen] / given) + np.log(BACKOFF) * (possible[seen] - n)
    return np.bincount(grams.row, value, len(grams.size))


def score(docs: DataFrame, head_words: int = HEAD, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score and mean_score (per word) of each row."""
    words = stage(lambda: word_counts(docs))
    total = words.agg(F.sum("c")).first()[0] or 0
    top = words.orderBy(F.desc("c"), "w").limit(min(head_words, HEAD)).toArrow()  # HEAD rows at most
    head = Head(top.column("w").to_numpy().view(U), top.column("c").to_numpy(), int(total))
    del top, words  # their table is given back
    collect_garbage(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(head)
    parts = max(64, int(total) // LOAD + 1)
    blocks = stage(lambda: _numbered(docs, shared))
    answers = _answered(_asked(blocks, shared, order, parts))
    kind = kind_of(docs)
    both = blocks.selectExpr("block", "0 AS n", "0 AS part", "ids", "sizes", "words", "rare").unionByName(
        answers.selectExpr("block", "n", "part", f"CAST(NULL AS array<{kind}>) AS ids", "counts AS sizes", "CAST(NULL AS binary) AS words", "CAST(NULL AS binary) AS rare")
    )

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n", "ascending"), ("part", "ascending")])
        own, counted = rows.slice(0, 1).to_pydict(), {n: [np.zeros(0, np.int64)] for n in range(1, order + 1)}
        for n, raw in zip(rows["n"].to_pylist()[1:], rows["sizes"].to_pylist()[1:]):
            counted[n].append(unpack(raw, np.int64))
        grams = Grams(shared.value, own["sizes"][0], own["words"][0], own["rare"][0])
        scores = _log_scores(grams, {n: np.concatenate(x) for n, x in counted.items()}, order, parts)
        ids = rows["ids"].combine_chunks()
        return pa.table([ids.slice(0, 1).flatten(), pa.array(grams.size), pa.array(scores)], ["doc_id", "n_words", "s"])

    out = both.groupBy("block").applyInArrow(run, f"doc_id {kind}, n_words long, s double")
    return out.select("doc_id", "n_words", F.round("s", 6).alias("log_score"), F.when(F.col("n_words") > 0, F.round(F.col("s") / F.col("n_words"), 6)).alias("mean_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (
  SELECT doc_id, i, w[i] AS w3, CASE WHEN i > 1 THEN w[i - 1] END AS w2, CASE WHEN i > 2 THEN w[i - 2] END AS w1
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT count(*) AS n FROM t),
own AS (SELECT doc_id, count(*) AS k FROM t GROUP BY doc_id),
d1 AS (SELECT doc_id, w3, count(*) AS c FROM t GROUP BY ALL),
c1 AS (SELECT w3, sum(c) AS c FROM d1 GROUP BY ALL),
d2 AS (SELECT doc_id, w2, w3, count(*) AS c FROM t WHERE i > 1 GROUP BY ALL),
c2 AS (SELECT w2, w3, sum(c) AS c FROM d2 GROUP BY ALL),
d3 AS (SELECT doc_id, w1, w2, w3, count(*) AS c FROM t WHERE i > 2 GROUP BY ALL),
c3 AS (SELECT w1, w2, w3, sum(c) AS c FROM d3 GROUP BY ALL),
r1 AS (SELECT doc_id, w3, c1.c - d1.c AS c FROM d1 JOIN c1 USING (w3)),
r2 AS (SELECT doc_id, w2, w3, c2.c - d2.c AS c FROM d2 JOIN c2 USING (w2, w3)),
r3 AS (SELECT doc_id, w1, w2, w3, c3.c - d3.c AS c FROM d3 JOIN c3 USING (w1, w2, w3)),
v AS (
  SELECT t.doc_id, greatest(n.n - own.k, 1) AS n, own.k, least(i, 3) AS possible, r3.c AS c3, r2.c AS c2, r1.c AS c1, g2.c AS g2, g1.c AS g1
  FROM t CROSS JOIN n JOIN own USING (doc_id) JOIN r1 ON r1.doc_id = t.doc_id AND r1.w3 = t.w3
  LEFT JOIN r2 ON r2.doc_id = t.doc_id AND r2.w2 = t.w2 AND r2.w3 = t.w3
  LEFT JOIN r3 ON r3.doc_id = t.doc_id AND r3.w1 = t.w1 AND r3.w2 = t.w2 AND r3.w3 = t.w3
  LEFT JOIN r2 g2 ON g2.doc_id = t.doc_id AND g2.w2 = t.w1 AND g2.w3 = t.w2
  LEFT JOIN r1 g1 ON g1.doc_id = t.doc_id AND g1.w3 = t.w2),
s AS (
  SELECT doc_id, any_value(k) AS k, sum(CASE
    WHEN c3 > 0 THEN ln(c3 / g2)
    WHEN c2 > 0 THEN ln(c2 / g1) + (possible - 2) * ln(0.4::DOUBLE)
    WHEN c1 > 0 THEN ln(c1 / n) + (possible - 1) * ln(0.4::DOUBLE)
    ELSE possible * ln(0.4::DOUBLE) - ln(n) END) AS s FROM v GROUP BY doc_id)
SELECT doc_id, coalesce(k, 0)::BIGINT AS n_words, round(coalesce(s, 0::DOUBLE), 6) AS log_score, round(s / k, 6) AS mean_score
FROM d LEFT JOIN s USING (doc_id)
"""
