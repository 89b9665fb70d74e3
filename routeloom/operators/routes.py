"""Routes through solved networks and what is measured of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .graph import edges
from .ranking import top_k


def size_value(size: Column, in_stock: Column, scale: float = 0.1, free: int = 12) -> Column:
    """Value of an open molecule by its size: nothing in stock or up to ``free`` atoms."""
    return F.when(in_stock, 0.0).otherwise(scale * F.greatest(F.lit(0), size - free))


def cheapest_rules(rules: DataFrame, solved: DataFrame, stock: DataFrame) -> DataFrame:
    """(product, rule_id): the cheapest rule with solved children only of each molecule that is not in stock."""
    flagged = edges(rules).join(solved.select(F.col("k").alias("child"), F.lit(1).alias("hit")).hint("merge"), "child", "left")
    ok = flagged.groupBy("rule_id", "product").agg(F.min(F.coalesce("hit", F.lit(0))).alias("ok"), F.max("score").alias("score")).where("ok = 1")
    ok = ok.join(stock.select(F.col("k").alias("product")).hint("merge"), "product", "left_anti")
    return ok.groupBy("product").agg(F.max_by("rule_id", F.struct("score", (-F.col("rule_id")).alias("n"))).alias("rule_id"))


def walk(best: DataFrame, rules: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, k, rule_id): all steps of each target's route, level by level; a molecule once per target."""
    best = cut(best)
    made = best.withColumnRenamed("product", "k").hint("merge")
    step = cut(edges(rules).join(best.select("rule_id").hint("merge"), "rule_id", "left_semi").select(F.col("product").alias("k"), "child").distinct())
    # only children that have a step of their own
    step = cut(step.join(best.select(F.col("product").alias("child")).hint("merge"), "child", "left_semi")).hint("merge")
    front = out = cut(targets.select("target", F.col("target").alias("k")).join(made, "k").select("target", "k"))
    while True:
        new = front.join(step, "k").select("target", F.col("child").alias("k")).distinct()
        front = cut(new.join(out.hint("merge"), ["target", "k"], "left_anti"))
        if front.limit(1).count() == 0:
            break
        out = out.unionByName(front)
    return out.join(made, "k").select("target", "k", "rule_id")


def metrics(leaves: DataFrame, by: str, step: str) -> DataFrame:
    """Per route: leaves, coverage, steps, product of scores and depth, from rows (by, in_stock, score, step)."""
    return leaves.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_leaves"),
        F.avg(F.col("in_stock").cast("double")).alias("coverage"),
        F.countDistinct(step).alias("steps"),
        F.exp(F.sum(F.log(F.greatest("score", F.lit(1e-12))))).alias("score"),
        F.max(step).cast("long").alias("depth"),
    )


def rank(routes: DataFrame, by: str, tie: str) -> DataFrame:
    """Routes of each group by coverage, then fewest steps, then score; ``tie`` decides the rest."""
    order = [F.desc(F.round("coverage", 9)), F.col("steps"), F.desc(F.round("score", 9)), F.col(tie)]
    return top_k(routes, by, order, 2**31 - 1)
