"""Ranking of predictions: priors, softmax, top-k per group, merging by reactant set, plausibility filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: str | list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Catalyst limits every partition before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def normalised_priors(templates: DataFrame, prior: str = "prior") -> DataFrame:
    """p / sum(p); a missing prior is 1, a sum of 0 counts as 1. The total is one row."""
    filled = templates.withColumn(prior, F.coalesce(F.col(prior), F.lit(1.0)))
    total = filled.agg(F.sum(prior).alias("_total"))
    return filled.crossJoin(F.broadcast(total)).withColumn(prior, F.col(prior) / F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total"))).drop("_total")


def softmax(logits: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    x = F.transform(logits, lambda v: F.exp(v.cast("double") - F.array_max(logits).cast("double")))
    return F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda a, b: a + b))


def top_classes(df: DataFrame, id_col: str, logits: str, k: int) -> DataFrame:
    """(id, label, prob, rank): the k most probable classes per row; ties by label. No shuffle: the array is ranked in its row."""
    total = F.aggregate(F.transform("_e", lambda x: x["e"]), F.lit(0.0), lambda a, b: a + b)
    top = F.array_max(logits).cast("double")
    ranked = F.array_sort(F.transform(F.col(logits), lambda v, i: F.struct((-F.exp(v.cast("double") - top)).alias("n"), i.alias("label"), F.exp(v.cast("double") - top).alias("e"))))
    d = df.select(id_col, ranked.alias("_e")).withColumn("_t", total)
    return d.select(id_col, "_t", F.posexplode(F.slice("_e", 1, k)).alias("_p", "_x")).select(id_col, F.col("_x.label").alias("label"), (F.col("_x.e") / F.col("_t")).alias("prob"), (F.col("_p") + 1).alias("rank"))


def merge_retro(predictions: DataFrame, k: int) -> DataFrame:
    """Per (product, reactant set) the largest (prob, center, label); then the top k by prob, center, label and reactants."""
    best = F.max(F.struct("prob", "center", "label")).alias("x")
    merged = predictions.groupBy("product", "reactants").agg(best).select("product", "reactants", "x.prob", "x.center", "x.label")
    return top_k(merged, "product", [F.desc("prob"), F.desc("center"), F.desc("label"), F.col("reactants")], k)


def decode_forward(predictions: DataFrame, k: int) -> DataFrame:
    """Per (input, product) the largest probability, its first label and how many templates gave it; then the top k."""
    best = F.max(F.struct(F.col("prob"), (-F.col("label")).alias("n"))).alias("x")
    merged = predictions.groupBy("input", "product").agg(best, F.countDistinct("label").alias("n_templates"))
    merged = merged.select("input", "product", F.col("x.prob").alias("prob"), (-F.col("x.n")).alias("label"), "n_templates")
    return top_k(merged, "input", [F.desc("prob"), F.desc("n_templates"), F.col("product")], k)


def plausibility_filter(ranked: DataFrame, by: str, threshold: float = 0.4, min_keep: int = 1, k: int = 50) -> DataFrame:
    """Keep rows with plausibility >= threshold in the model's order; where none survives keep the first min_keep; at most k, ranked anew. A missing score is 0."""
    w = Window.partitionBy(by)
    d = ranked.withColumn("plausibility", F.coalesce("plausibility", F.lit(0.0))).withColumn("_ok", F.col("plausibility") >= threshold)
    d = d.withColumn("_any", F.max("_ok").over(w)).where(F.col("_ok") | (~F.col("_any") & (F.col("rank") <= min_keep)))
    return d.withColumn("new_rank", F.row_number().over(w.orderBy("rank"))).where(F.col("new_rank") <= k).drop("_ok", "_any")
