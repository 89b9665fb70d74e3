"""Quality rules: a ledger of failure bits and measurements, with versioned policies.

Every rule is evaluated once per document. A failed rule sets its bit in
``fails``; the measurements stay beside it. A policy is a mask of rules: a
document passes when it fails none of them, so a new policy version or an
ablation (a policy without one of its rules) needs only bitwise aggregation of
the ledger and no second look at the texts.

Defined results: a null or empty text has no words, measurements of 0 and
fails rule few_words; repeated rows and null ids are rows of their own;
further columns are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: name: what a failing document's measurements fulfil. A rule's bit is its place here; rules are only ever added at the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > 2 * n_words",
    "long_words": "word_chars > 40 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines AND n_lines >= 4",
    "shouting": "10 * n_shouts > 3 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Versions of the verdict; the last one is in force.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "many_symbols", "long_words", "repeated_lines"),
    "v2": (*BASE, "many_symbols", "long_words", "short_words", "repeated_lines", "shouting"),
}


def mask(policy: str | tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def _windows(w: Column) -> Column:
    """64-bit hashes of the windows of WINDOW words; within one text, unequal ones practically never collide."""
    n = F.size(w)
    starts = F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1)))
    return F.when(n > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the measurements of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), words(text).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, "\x20\x09\x0a\x0b\x0c\x0d", "")) > 0)
    d = d.select("doc_id", "_t", "_w", F.size("_w").cast("long").alias("n_words"), lines.alias("_l"), _windows(F.col("_w")).alias("_h"))
    # most texts have no window twice; only the others are sorted
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs))
    s = F.col("_s")
    twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"]))
    d = d.withColumn("_p", F.when(s.isNotNull(), F.array_sort(F.transform(twice, lambda x: x["i"]))))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    t = F.col("_t")
    return d.select(
        "doc_id",
        "n_words",
        F.length(F.translate(t, "\x20\x09\x0a\x0b\x0c\x0d", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias("n_shouts"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``fails``, the bitmask of failed rules."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    return measure(docs, id_col, text_col).withColumn("fails", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def verdict(led: DataFrame, policy: str | tuple[str, ...] | None = None) -> Column:
    """Whether a row of the ledger passes a policy (the last one unless named)."""
    return F.col("fails").bitwiseAND(F.lit(mask(policy or list(POLICIES)[-1]))) == 0


def ablations(led: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, fail it alone, and pass without it.

    Ledger rows meet as counts of equal bitmasks first, of which there are at
    most two to the number of rules.
    """
    whole = mask(policy)
    counts = led.groupBy(F.col("fails").bitwiseAND(F.lit(whole)).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[policy]])
    n = F.col("n")
    return (
        counts.select("f", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("f").bitwiseAND(F.col("r.bit")) != 0, n).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("f") == F.col("r.bit"), n).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("f").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, n).otherwise(0)).alias("n_kept_without"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(table(spark, sf_dir, "documents"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~verdict(led, "base")).alias("base_failed"), verdict(led).alias("kept"), "n_lines", "n_shouts", "fails")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT r, s FROM win GROUP BY r, s HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT win.r, unnest(range(i, i + 5)) AS p FROM win JOIN rep USING (r, s)) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_shouts
  FROM d LEFT JOIN cov USING (r)),
f AS (
  SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > 2 * n_words)::BIGINT
    + 8 * (word_chars > 40 * n_words)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT
    + 32 * (2 * n_dup_lines > n_lines AND n_lines >= 4)::BIGINT + 64 * (10 * n_shouts > 3 * n_words)::BIGINT)::BIGINT AS fails
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fails & 3) <> 0 AS base_failed, fails = 0 AS kept, n_lines, n_shouts, fails
FROM f
"""
