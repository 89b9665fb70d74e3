"""Synthesizability scores, per-target reports and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score(missing: Column, n_leaves: Column) -> Column:
    """1 / (U + 1) ** U for U missing leaves; 0 without any leaf."""
    u = missing.cast("double")
    return F.when(n_leaves == 0, 0.0).otherwise(1.0 / F.pow(u + 1, u))


def leaf_report(leaves: DataFrame, by: str) -> DataFrame:
    """Per key: leaves, how many are purchasable, U, coverage and score, from rows (by, in_stock)."""
    d = leaves.groupBy(by).agg(F.count(F.lit(1)).alias("num_leaves"), F.sum(F.col("in_stock").cast("long")).alias("num_purchasable"))
    u = F.col("num_leaves") - F.col("num_purchasable")
    return d.withColumn("u", u).withColumn("bb_coverage", F.col("num_purchasable") / F.col("num_leaves")).withColumn("synscore", score(u, F.col("num_leaves")))


def best_report(reports: DataFrame, by: str, route: str) -> DataFrame:
    """Per key the reported route: of solved ones the one with the fewest steps, or else the smallest (U, -coverage, steps)."""
    order = F.struct(F.col("u"), (-F.col("bb_coverage")).alias("c"), F.col("steps"), F.col(route).alias("r"))
    chosen = F.min_by(F.struct(route, "u", "bb_coverage", "steps", "num_leaves"), order).alias("x")
    d = reports.groupBy(by).agg(chosen, F.count_if(F.col("u") == 0).alias("num_routes")).select(by, "x.*", "num_routes")
    solved = F.col("u") == 0
    return d.withColumn("solved", solved).withColumn("min_steps", F.when(solved, F.col("steps"))).withColumn("synscore", score(F.col("u"), F.col("num_leaves"))).drop("steps")


def batch_summary(reports: DataFrame) -> DataFrame:
    """One row over (solved, bb_coverage, elapsed_s, error): rows with an error take no part in any rate."""
    ok = F.col("error").isNull()
    return reports.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("n_evaluated"),
        F.coalesce(F.avg(F.when(ok, F.col("solved").cast("double"))), F.lit(0.0)).alias("solve_rate"),
        F.coalesce(F.avg(F.when(ok, F.col("bb_coverage"))), F.lit(0.0)).alias("mean_bb_coverage"),
        F.coalesce(F.avg(F.when(ok, F.col("elapsed_s"))), F.lit(0.0)).alias("mean_elapsed_s"),
    )


def depth_histogram(reports: DataFrame, depth: str) -> DataFrame:
    return reports.where(F.col(depth).isNotNull()).groupBy(F.col(depth).alias("depth")).agg(F.count(F.lit(1)).alias("n"))


def solve_rate_at(reports: DataFrame, depth: str, max_steps: int) -> DataFrame:
    """Per s of 1..max_steps the share of evaluated rows solved within depth s. Rows meet as a histogram first."""
    hist = reports.groupBy(F.when(F.col("solved"), F.col(depth)).alias("depth")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    steps = F.explode(F.sequence(F.lit(1), F.lit(max_steps))).alias("steps")
    return hist.select("depth", "n", steps).groupBy("steps").agg((F.sum(F.when(F.col("depth") <= F.col("steps"), F.col("n")).otherwise(0)) / total).alias("rate"))


def running_rate(rows: DataFrame, order: list[str], solved: str, part: str) -> DataFrame:
    """Cumulative mean of a flag in order. ``part`` splits the order into consecutive ranges (a day, say): each is summed first, and only these totals are put in one sequence."""
    per = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(solved).cast("long")).alias("_s"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_i", F.count(F.lit(1)).over(w)).withColumn("_k", F.sum(F.col(solved).cast("long")).over(w)).join(F.broadcast(per), part)
    return own.withColumn("rate", (F.col("_k") + F.col("_s0")) / (F.col("_i") + F.col("_n0"))).drop("_i", "_k", "_n0", "_s0")
