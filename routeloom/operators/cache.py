"""Materialised expansions: (smiles, top_k, predictions); an entry serves every request that is not wider."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits with their first k predictions, and the distinct requests to expand."""
    joined = requests.join(cache.select("smiles", F.col("top_k").alias("cached_k"), "predictions"), "smiles", "left")
    hit = F.coalesce(F.col("cached_k") >= F.col("k"), F.lit(False))
    hits = joined.where(hit).withColumn("predictions", F.slice("predictions", F.lit(1), F.col("k"))).drop("cached_k")
    misses = joined.where(~hit).groupBy("smiles").agg(F.max("k").alias("k"))
    return hits, misses


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries; of equal keys the widest stays."""
    both = cache.select("smiles", "top_k", "predictions").unionByName(new.select("smiles", "top_k", "predictions"))
    return both.groupBy("smiles").agg(F.max("top_k").alias("top_k"), F.max_by("predictions", "top_k").alias("predictions"))


def read_through(requests: DataFrame, cache: DataFrame, expand: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Answers of all requests, and the cache afterwards. Only misses reach the model, each once."""
    hits, misses = lookup(requests, cache)
    new = expand(misses).select("smiles", "top_k", "predictions")
    late = requests.join(hits.select("smiles", "k").distinct(), ["smiles", "k"], "left_anti").join(new, "smiles")
    late = late.withColumn("predictions", F.slice("predictions", F.lit(1), F.col("k"))).drop("top_k")
    return hits.unionByName(late), upsert(cache, new)


def hit_rate(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: hits, misses and hits / (hits + misses), 0 without requests."""
    joined = requests.join(cache.select("smiles", F.col("top_k").alias("cached_k")), "smiles", "left")
    hit = F.coalesce(F.col("cached_k") >= F.col("k"), F.lit(False))
    d = joined.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))
    return d.withColumn("hit_rate", F.when(F.col("hits") + F.col("misses") == 0, 0.0).otherwise(F.col("hits") / (F.col("hits") + F.col("misses"))))
