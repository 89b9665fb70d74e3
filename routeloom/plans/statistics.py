"""Paired statistics of two arms, sweeps and accuracy reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking
from ..operators import stats as S
from ..session import table
from ..sources import projections as P
from .networks import _ARMS, arms
from .registry import query
from .relational import _SOFTMAX

_BOTH = "coalesce(a_solved, true) AS a, b_solved AS b"


def _pairs(spark, sf_dir):
    return arms(spark, sf_dir).withColumn("a", F.coalesce("a_solved", F.lit(True))).withColumn("b", F.col("b_solved"))


@query(_ARMS + f", x AS (SELECT {_BOTH} FROM arms) SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM x")
def contingency_mcnemar(spark, sf_dir):
    return S.contingency(_pairs(spark, sf_dir), "a", "b")


@query(_ARMS + """, x AS (SELECT o % 8 + 3 AS k, a_steps::DOUBLE AS x, b_steps::DOUBLE AS gold FROM arms)
SELECT k, round(avg(abs(x - gold)), 6) AS mae, round(sqrt(avg(pow(x - gold, 2))), 6) AS rmse, round(avg((x = gold)::INTEGER), 6) AS agreement, round(avg(x), 6) AS mean_x, round(median(x), 6) AS median_x FROM x GROUP BY k""")
def paired_errors(spark, sf_dir):
    x = arms(spark, sf_dir).select((F.col("o") % 8 + 3).alias("k"), F.col("a_steps").cast("double").alias("x"), F.col("b_steps").cast("double").alias("gold"))
    d = S.paired_errors(x, "k", "x", "gold")
    return d.select("k", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


_RANKS = """, x AS (SELECT c_acctbal AS x, (c_custkey * 37 % 101)::DOUBLE + c_acctbal / 1000 AS y FROM customer),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM x)"""


@query("WITH one AS (SELECT 1)" + _RANKS + " SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r")
def pearson_spearman(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("x"), ((F.col("c_custkey") * 37 % 101).cast("double") + F.col("c_acctbal") / 1000).alias("y"))
    return S.correlations(x, "x", "y").select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("""
WITH x AS (SELECT c_custkey AS k, c_acctbal AS x, (c_custkey * 37 % 101)::DOUBLE AS y FROM customer),
r AS (SELECT k, x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry, count(*) OVER () AS n FROM x)
SELECT k, round(abs(rx - ry) / n, 6) AS gap FROM r ORDER BY abs(rx - ry) / n DESC, k LIMIT 6""")
def percentile_gap(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 37 % 101).cast("double").alias("y"))
    return S.percentile_gap(x, "x", "y", 6, "k").select("k", F.round("gap", 6).alias("gap"))


def _series() -> str:
    """The polynomial of the error function's fit in e, as SQL."""
    out = f"{S.ERFC[-1]}::DOUBLE"
    for c in reversed(S.ERFC[:-1]):
        out = f"({c}::DOUBLE + e * {out})"
    return out


@query(_ARMS + """, d AS (SELECT (a_steps - b_steps + (o % 5) - 2)::DOUBLE AS d FROM arms), nz AS (SELECT d, abs(d) AS ad FROM d WHERE d <> 0),
r AS (SELECT d, ad, rank() OVER (ORDER BY ad) + (count(*) OVER (PARTITION BY ad) - 1) / 2 AS r FROM nz),
s AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS wp, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS wm FROM r),
t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*) AS c FROM nz GROUP BY ad))
SELECT n, w_plus, w_minus, w, round(z, 6) AS z, round(2 * upper, 6) AS p, round(CASE WHEN z >= 0 THEN upper ELSE 1 - upper END, 6) AS p_greater
FROM (SELECT *, 0.5::DOUBLE * e * exp(-z * z / 2 + """ + _series() + """) AS upper
  FROM (SELECT *, 1 / (1 + abs(z) / sqrt(2) / 2) AS e
    FROM (SELECT n, wp AS w_plus, wm AS w_minus, least(wp, wm) AS w, (wp - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s, t)))""")
def wilcoxon(spark, sf_dir):
    x = arms(spark, sf_dir).select(F.col("a_steps").cast("double").alias("x"), (F.col("b_steps") - (F.col("o") % 5) + 2).cast("double").alias("y"))
    return S.wilcoxon(x, "x", "y").withColumns({c: F.round(c, 6) for c in ("z", "p", "p_greater")})


@query()
def bootstrap_ci(spark, sf_dir):
    """Bounds from hashed Poisson weights; tests hold them against the plain correlation."""
    x = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (F.col("c_acctbal") + F.col("c_custkey") * 37 % 4001).alias("y"))
    return S.bootstrap_ci(x, "c_acctbal", "y", 200)


@query("""
WITH m AS (SELECT d.doc_id, source, TRY_CAST(split_part(d.text, ' ', 2) AS DOUBLE) AS bad, n_chars::DOUBLE AS n, quality FROM documents d JOIN labels USING (doc_id) LEFT JOIN benchmark ON item_id = d.doc_id)
SELECT quality, count(*) AS n, count(bad) AS n_numeric, round(stddev_samp(n), 4) AS sd, min(n) AS low, max(n) AS high FROM m WHERE n IS NOT NULL GROUP BY quality""")
def merge_coerce(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.get(F.split("text", " "), 1).try_cast("double").alias("bad"), F.col("n_chars").cast("double").alias("n"))
    m = d.join(table(spark, sf_dir, "labels"), "doc_id").join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left").dropna(subset=["n"])
    return m.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("n_numeric"), F.round(F.stddev_samp("n"), 4).alias("sd"), F.min("n").alias("low"), F.max("n").alias("high"))


@query(_SOFTMAX + """, f AS (SELECT vec_id, min(rank) FILTER (label = gold) AS first FROM p WHERE rank <= 10 GROUP BY vec_id)
SELECT k::INTEGER AS k, round(avg(coalesce(first <= k, false)::INTEGER), 6) AS accuracy FROM f, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k""")
def topk_accuracy(spark, sf_dir):
    e = P.logits(spark, sf_dir)
    ranked = ranking.top_classes(e, "vec_id", "embedding", 10).join(e.select("vec_id", F.col("label").alias("gold")), "vec_id")
    return S.hits_at(ranked, "vec_id", "rank", F.col("label") == F.col("gold"), [1, 3, 5, 10]).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""
WITH {P.RULES_SQL}, x AS (SELECT product % 10 AS grp, score FROM rules)
SELECT grp, t, round(avg((score < t)::INTEGER), 6) AS below, count(*) FILTER (score >= t) AS n_kept FROM x, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5])::DOUBLE AS t) GROUP BY grp, t""")
def threshold_sweep(spark, sf_dir):
    x = P.rules(spark, sf_dir).select((F.col("product") % 10).alias("grp"), "score")
    return S.threshold_sweep(x, "grp", "score", [0.1, 0.2, 0.3, 0.4, 0.5]).withColumn("below", F.round("below", 6))


@query(f"""
WITH {P.RULES_SQL}, x AS (SELECT product % 10 AS grp, list_sort(list(score)) AS s FROM rules GROUP BY 1)
SELECT grp, s[floor(5 / 100::DOUBLE * (len(s) - 1))::BIGINT + 1] AS value FROM x""")
def lower_percentile(spark, sf_dir):
    x = P.rules(spark, sf_dir).select((F.col("product") % 10).alias("grp"), "score")
    return S.lower_percentile(x, "grp", "score", 5.0)


@query(_SOFTMAX + """, f AS (SELECT vec_id, bool_or(rank = 1 AND label = gold) AS x, coalesce(arg_min(label = gold, rank) FILTER ((label * 37 + vec_id) % 101 >= 40), false) AS y FROM p WHERE rank <= 10 GROUP BY vec_id)
SELECT count(*) FILTER (NOT x AND y) AS gained, count(*) FILTER (x AND NOT y) AS lost, count(*) FILTER (x = y) AS same FROM f""")
def gain_loss(spark, sf_dir):
    e = P.logits(spark, sf_dir)
    ranked = ranking.top_classes(e, "vec_id", "embedding", 10).join(e.select("vec_id", F.col("label").alias("gold")), "vec_id")
    first = lambda d: d.groupBy("vec_id").agg(F.min_by(F.col("label") == F.col("gold"), "rank").alias("hit"))
    return S.gains_and_losses(first(ranked), first(ranked.where((F.col("label") * 37 + F.col("vec_id")) % 101 >= 40)), "vec_id", "hit")


@query(f"""
WITH {P.RULES_SQL} SELECT CASE WHEN GROUPING(v) = 1 THEN 'all' ELSE v::VARCHAR END AS variant, count(*) AS n, count(*) FILTER (score >= 0.4::DOUBLE) AS n_kept
FROM (SELECT rule_id % 2 AS v, score FROM rules) GROUP BY ROLLUP (v)""")
def sweep_rollup(spark, sf_dir):
    r = P.rules(spark, sf_dir).select((F.col("rule_id") % 2).alias("v"), "score").rollup("v")
    d = r.agg(F.grouping("v").alias("g"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= 0.4).alias("n_kept"))
    return d.select(F.when(F.col("g") == 1, "all").otherwise(F.col("v").cast("string")).alias("variant"), "n", "n_kept")
