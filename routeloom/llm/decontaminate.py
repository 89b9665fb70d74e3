"""Benchmark decontamination: windows of documents that repeat a benchmark item.

A window has as many words as an item (the whole document, where that is
shorter) and may begin at any word. At similarity 0.8 the windows' shingles that
occur in items of that length number needed() or more, so only such places are
looked at, without loss. SimHash fingerprints of the windows are looked up among the items' by blocks: 64 bits in RADIUS + 1
blocks, one of which is equal in any two fingerprints within RADIUS. What is
found so is verified by the exact similarity of the weighted shingles:
100 * sum of the smaller counts >= 80 * sum of the larger counts, over shingles
of five lower-cased words (the whole sequence, where there are fewer).

Two texts of similarity 0.8 differ in 9.5 of 64 bits on average, with a
standard deviation of 2.8; RADIUS is 3.5 deviations beyond.

Defined results: null and empty texts and items without words match nothing;
of equally similar windows the first of the document is reported; repeated rows are one match; null ids are kept as they are; further columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, stage, table, words

SHINGLE, PERCENT, RADIUS, BITS = 5, 80, 19, 64
#: Shingles of items that are broadcast at most; beyond, both sides are shuffled.
BROADCAST_SHINGLES = 500_000
#: Documents with places to look at that are broadcast at most.
BROADCAST_ROWS = 300_000
#: Tasks that items are dealt to.
TASKS = 32


def _hash(w: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(w, at + j) for j in range(k)])


def _lower(text: Column) -> Column:
    """lower_ascii() of a text; one without other characters is lower-cased by Spark's lower(), which then does the same several times faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(lower_ascii(text))


def hashes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, t, size, p, h): hashes of all runs of k words of each text, and where they begin; t is the text's hash, size its words.

    Words are split once: a filter on them would be moved below and split them again. Runs are hashed row by row in generated code.
    """
    d = docs.select("doc_id", F.xxhash64("text").alias("t"), words(_lower(F.col("text"))).alias("w"))
    d = d.select("doc_id", "t", "w", F.explode(F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k))).alias("p"))
    return d.select("doc_id", "t", F.size("w").alias("size"), "p", _hash(F.col("w"), F.col("p"), k).alias("h"))


def shingles(w: Column) -> Column:
    """Texts of the shingles of an array of words, in order."""
    n = F.size(w)
    k = F.least(n, F.lit(SHINGLE))
    return F.transform(F.sequence(F.lit(1), F.greatest(n - k, F.lit(0)) + 1), lambda i: F.concat_ws(" ", F.slice(w, i, k)))


def counted(s: Column) -> Column:
    """A multiset as a set: every element with how many equal ones come before it."""
    s = F.array_sort(s)
    return F.transform(s, lambda x, i: F.concat_ws(" ", x, (i + 1 - F.array_position(s, x)).cast("string")))


def simhash(s: Column) -> Column:
    """64-bit SimHash of an array of shingles, each weighted by how often it occurs."""
    hashes = F.transform(s, lambda x: F.xxhash64(x))
    votes = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)).cast("int") * 2 - 1))
    return F.aggregate(votes, F.lit(0).cast("long"), lambda a, v: F.call_function("shiftleft", a, F.lit(1)) + F.when(v > 0, 1).otherwise(0).cast("long"))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """Array of (block, its bits): radius + 1 blocks of nearly equal size."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("b"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (z - a)) - 1)).alias("v")) for i, (a, z) in enumerate(zip(edges, edges[1:]))])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", words(lower_ascii(F.col("text"))).alias("iw")).where(F.size("iw") > 0).withColumn("n", F.size("iw")).withColumn("k", F.least(F.size("iw"), F.lit(SHINGLE)))


def needed(own: Column, other: Column, percent: int) -> Column:
    """Shingles that multisets of own and other shingles have in common at least, if their similarity is percent."""
    return F.ceil((own + other) * percent / (100 + percent)).cast("int")


def starts(places: Column, need: Column, span: Column, last: Column) -> Column:
    """All f up to ``last`` for which ``need`` or more of the sorted places lie from f to f + span - 1, in order and once each."""
    block = F.sequence(F.lit(0), F.size(places) - need)

    def of(i: Column) -> Column:
        low = F.greatest(F.lit(0), F.get(places, i + need - 1) - span + 1, F.coalesce(F.get(places, i - 1) + 1, F.lit(0)))
        high = F.least(F.get(places, i), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.when(F.size(places) >= need, F.flatten(F.transform(block, of)))


def windows(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, t, size, first, n, w): windows of n words of which enough shingles occur in items of n words; t is the text's hash, size its words."""
    d = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    at = items.select("n", "k", "iw", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("q"))
    sizes = sorted(r.k for r in items.select("k").distinct().collect())  # 1 to SHINGLE
    found = None
    for k in sizes:
        index = at.where(F.col("k") == k).select(_hash(F.col("iw"), F.col("q"), k).alias("h"), "n").distinct()
        small = index.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES
        hit = hashes(docs, k).join(F.broadcast(index) if small else index, "h")
        own, other = F.least(F.col("n"), F.col("size")) - k + 1, F.col("n") - k + 1
        hit = hit.groupBy("doc_id", "t", "size", "n").agg(F.array_sort(F.collect_set("p")).alias("ps")).withColumn("need", needed(own, other, percent))
        firsts = starts(F.col("ps"), F.col("need"), own, F.greatest(F.lit(0), F.col("size") - F.col("n")))
        hit = hit.select("doc_id", "t", "size", "n", firsts.alias("firsts")).where(F.size("firsts") > 0)
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return d.where(F.lit(False)).select("doc_id", "t", F.lit(0).alias("size"), F.lit(0).alias("first"), F.lit(0).alias("n"), words(F.col("text")).alias("w"))
    found = stage(lambda: found.select(F.col("doc_id").alias("i"), F.col("t").alias("j"), "size", "n", "firsts"))
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # light rows first; once the places are known, the words of those texts alone
    d = d.join(F.broadcast(found) if few else found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("j")))
    d = d.select("doc_id", "t", "size", "n", words(_lower(F.col("text"))).alias("w"), "firsts").select("doc_id", "t", "size", "n", "w", F.explode("firsts").alias("first"))
    return d.select("doc_id", "t", "size", "first", "n", F.slice("w", F.col("first") + 1, F.col("n")).alias("w"))


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, first, n_words, n_common, n_all): the most similar window of each document with each item it repeats."""
    # items are few rows of much work each; cut, or filters on what is made of them would be moved below and make it again in one task
    known = stage(lambda: _items(benchmark).repartition(TASKS, "item_id").withColumn("s", shingles(F.col("iw"))).withColumn("g", simhash(F.col("s"))).withColumn("c", counted(F.col("s"))))
    items = known.select("item_id", "iw", "n", "k")
    marked = stage(lambda: windows(docs, items, percent).drop("t").withColumn("s", shingles(F.col("w"))).withColumn("f", simhash(F.col("s"))))
    probe = marked.select("n", "f", F.explode(blocks(F.col("f"), radius)).alias("x")).select("n", "f", "x.*").distinct()
    index = known.select("item_id", "n", "g", F.explode(blocks(F.col("g"), radius)).alias("x")).select("item_id", "n", "g", "x.*")
    near = probe.join(index, ["n", "b", "v"]).where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius).select("n", "f", "item_id").distinct()
    exact = known.select(F.col("item_id").alias("i"), "c")
    pair = marked.select("doc_id", "first", "n", "f", counted(F.col("s")).alias("a")).join(near, ["n", "f"]).join(exact, F.col("item_id").eqNullSafe(F.col("i")))
    common = F.size(F.array_intersect("a", "c")).cast("long")
    pair = pair.select("doc_id", "item_id", "first", F.col("n").alias("n_words"), common.alias("n_common"), (F.size("a") + F.size("c")).cast("long").alias("both"))
    pair = pair.withColumn("n_all", F.col("both") - F.col("n_common")).where(F.col("n_common") * 100 >= F.col("n_all") * percent)
    best = F.max_by(F.struct("first", "n_words", "n_common", "n_all"), F.struct(F.col("n_common") / F.col("n_all"), -F.col("first"))).alias("x")
    return pair.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("x.first").cast("long").alias("first"), F.col("x.n_words").cast("long").alias("n_words"), "x.n_common", "x.n_all")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that repeat no item, with all their columns."""
    # rows are told apart by id and text, since null ids and shared ids have several texts
    key = F.struct("doc_id", F.xxhash64("text").alias("t"))
    hit = matches(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("hit")).distinct()
    own = F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("t"))
    return docs.join(hit, own.eqNullSafe(hit["hit"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Windows at every start in the documents that share enough shingles with items of a length, with their exact similarity, without fingerprints.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS iw FROM benchmark),
bn AS (SELECT item_id, iw, len(iw) AS n, least(len(iw), 5) AS k FROM b WHERE len(iw) > 0),
ish AS (SELECT item_id, n, k, q, array_to_string(iw[q + 1:q + k], ' ') AS s FROM (SELECT *, unnest(range(0, n - k + 1)) AS q FROM bn)),
dsh AS (
  SELECT doc_id, w, k, p, array_to_string(w[p + 1:p + k], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM bn) WHERE len(w) >= k)),
hit AS (SELECT doc_id, n, k, any_value(w) AS w, count(DISTINCT p) AS c FROM dsh JOIN ish USING (k, s) GROUP BY doc_id, n, k),
places AS (SELECT doc_id, n, w, unnest(range(0, greatest(0, len(w) - n) + 1)) AS f FROM hit WHERE 180 * c >= 80 * (least(n, len(w)) - k + 1 + n - k + 1)),
win AS (SELECT doc_id, n, f, w[f + 1:f + n] AS x FROM places),
ws AS (
  SELECT doc_id, n, f, s, count(*) AS c
  FROM (SELECT doc_id, n, f, array_to_string(x[i:i + least(len(x), 5) - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, len(x) - least(len(x), 5) + 2)) AS i FROM win)) GROUP BY ALL),
ic AS (SELECT item_id, n, s, count(*) AS c FROM ish GROUP BY ALL),
wt AS (SELECT doc_id, n, f, sum(c) AS t FROM ws GROUP BY ALL),
it AS (SELECT item_id, n, sum(c) AS t FROM ic GROUP BY ALL),
pair AS (SELECT doc_id, n, f, item_id, sum(least(ws.c, ic.c)) AS m FROM ws JOIN ic USING (n, s) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, n, f, m::BIGINT AS m, (wt.t + it.t - m)::BIGINT AS u FROM pair JOIN wt USING (doc_id, n, f) JOIN it USING (item_id, n)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY m / u DESC, f) AS r FROM sim WHERE 100 * m >= 80 * u)
SELECT doc_id, item_id, f::BIGINT AS first, n::BIGINT AS n_words, m AS n_common, u AS n_all FROM best WHERE r = 1
"""
