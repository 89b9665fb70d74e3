"""Statistics of paired results: contingency, errors, rank correlations, tests, bootstrap, sweeps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import sum_before


def contingency(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: both, only_a, only_b, neither."""
    x, y = F.col(a), F.col(b)
    return pairs.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def mcnemar_exact(only_a: int, only_b: int) -> float:
    """Two-sided exact p of the discordant pairs."""
    n, k = only_a + only_b, min(only_a, only_b)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def paired_errors(pairs: DataFrame, by: str, x: str, gold: str) -> DataFrame:
    """Per group: MAE, RMSE, share of equal values, mean and median of the estimate."""
    d = F.col(x) - F.col(gold)
    return pairs.groupBy(by).agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg((d == 0).cast("double")).alias("agreement"), F.avg(x).alias("mean_x"), F.median(x).alias("median_x"))


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank of each value, over the distinct values with their counts, range by range."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = sum_before(counts, value, "_c", "_b").select(F.col(value).alias("_v"), (F.col("_b") + (F.col("_c") + 1) / 2).alias(name))
    return df.join(ranks, F.col(value) == F.col("_v")).drop("_v")


def correlations(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson, and Spearman as Pearson of average ranks."""
    return average_rank(average_rank(pairs, x, "_rx"), y, "_ry").agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


#: Fixed values of a Chebyshev fit to the complementary error function (relative error below 1.2e-7), from the constant on.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_tail(z: Column) -> Column:
    """Probability that a standard normal value exceeds z."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    series = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        series = c + t * series
    upper = t * F.exp(-x * x + series) / 2
    return F.when(z >= 0, upper).otherwise(1 - upper)


def wilcoxon(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row: signed-rank sums without zero differences, the normal approximation's z with tie correction, and its p, two-sided and for x greater than y."""
    d = pairs.select((F.col(x) - F.col(y)).alias("d")).where("d <> 0").withColumn("ad", F.abs("d"))
    ranked = average_rank(d, "ad", "r")
    ties = d.groupBy("ad").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.pow("c", 3) - F.col("c")), F.lit(0.0)).alias("ties"))
    sums = ranked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"))
    n = F.col("n")
    wide = n.cast("decimal(12,0)")  # the product passes a long's range from 1.7 million pairs on
    var = (wide * (wide + 1) * (2 * wide + 1)).cast("double") / 24 - F.col("ties") / 48
    out = sums.crossJoin(ties).select("n", "w_plus", "w_minus", F.least("w_plus", "w_minus").alias("w"), F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var)).alias("z"))
    return out.withColumn("p", 2 * normal_tail(F.abs("z"))).withColumn("p_greater", normal_tail(F.col("z")))


def bootstrap_ci(rows: DataFrame, x: str, y: str, resamples: int = 200, seed: int = 0, blocks: int = 8) -> DataFrame:
    """One row: 2.5 and 97.5 percentiles of Pearson's correlation over resamples.

    Every row draws a Poisson(1) weight per resample from a hash of itself, so
    that resamples are sums over rows and nothing is collected.
    """
    u = (F.pmod(F.xxhash64("_id", "_b", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weight, upto = F.lit(0), 0.0
    for k in range(8):
        upto += math.exp(-1) / math.factorial(k)
        weight = weight + F.when(u > upto, 1).otherwise(0)
    d = rows.select(F.xxhash64(*rows.columns).alias("_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    d = d.select("*", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("_b")).withColumn("w", weight.cast("double")).where("w > 0")
    s = d.groupBy("_b").agg(*[F.sum(F.col("w") * e).alias(n) for n, e in (("n", F.lit(1.0)), ("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")), ("sxy", F.col("x") * F.col("y")))])
    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")))
    return s.select(r.alias("r")).agg(F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"))


def percentile_gap(df: DataFrame, x: str, y: str, n: int, key: str) -> DataFrame:
    """The n rows whose percentile ranks of x and y differ the most."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    d = average_rank(average_rank(df, x, "_rx"), y, "_ry").crossJoin(F.broadcast(total))
    d = d.withColumn("gap", F.abs(F.col("_rx") - F.col("_ry")) / F.col("_n")).drop("_rx", "_ry", "_n")
    return d.orderBy(F.desc("gap"), key).limit(n)


def lower_percentile(values: DataFrame, by: str, x: str, q: float) -> DataFrame:
    """Lower nearest-rank percentile: the value at floor(q / 100 * (n - 1)) of the sorted values, by their counts."""
    counts = values.groupBy(by, x).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(by).orderBy(x)
    d = counts.withColumn("_to", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(by)))
    return d.where(F.col("_to") > F.floor(F.lit(q) / 100 * (F.col("_n") - 1))).groupBy(by).agg(F.min(x).alias("value"))


def threshold_sweep(rows: DataFrame, by: str, x: str, thresholds: list[float]) -> DataFrame:
    """Per group and threshold: the share of rows below it."""
    t = F.explode(F.array(*[F.lit(float(v)) for v in thresholds])).alias("t")
    return rows.select(by, x, t).groupBy(by, "t").agg(F.avg((F.col(x) < F.col("t")).cast("double")).alias("below"), F.count_if(F.col(x) >= F.col("t")).alias("n_kept"))


def hits_at(ranked: DataFrame, by: str, rank: str, hit: Column, ks: list[int]) -> DataFrame:
    """Per k: the share of groups with a hit among their first k rows."""
    first = ranked.groupBy(by).agg(F.min(F.when(hit, F.col(rank))).alias("first"))
    k = F.explode(F.array(*[F.lit(v) for v in ks])).alias("k")
    return first.select("first", k).groupBy("k").agg(F.avg(F.coalesce(F.col("first") <= F.col("k"), F.lit(False)).cast("double")).alias("accuracy"))




def gains_and_losses(before: DataFrame, after: DataFrame, key: str, hit: str) -> DataFrame:
    """One row: how many keys a filter turned from wrong to right, from right to wrong, and left alone."""
    d = before.select(key, F.col(hit).alias("x")).join(after.select(key, F.col(hit).alias("y")), key, "left").withColumn("y", F.coalesce("y", F.lit(False)))
    return d.agg(F.count_if(~F.col("x") & F.col("y")).alias("gained"), F.count_if(F.col("x") & ~F.col("y")).alias("lost"), F.count_if(F.col("x") == F.col("y")).alias("same"))
