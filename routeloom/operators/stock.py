"""Purchasable stock as a relation of keys: membership, set union, exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stock_of(keys: DataFrame, key: str = "k") -> DataFrame:
    """A stock: distinct keys that are not null."""
    return keys.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct()


def union(*stocks: DataFrame) -> DataFrame:
    out = stocks[0]
    for s in stocks[1:]:
        out = out.unionByName(s)
    return out.distinct()


def empty(like: DataFrame) -> DataFrame:
    return like.where(F.lit(False))


def add(stock: DataFrame, keys: DataFrame, key: str = "k") -> DataFrame:
    return union(stock, stock_of(keys, key))


def purchasable(rows: DataFrame, stock: DataFrame, key: str = "k") -> DataFrame:
    """Rows whose key is in stock."""
    return rows.join(stock.select(F.col("k").alias("_s")), F.col(key) == F.col("_s"), "left_semi")


def missing(rows: DataFrame, stock: DataFrame, key: str = "k") -> DataFrame:
    """Rows whose key is not in stock; a null key is not."""
    return rows.join(stock.select(F.col("k").alias("_s")), F.col(key) == F.col("_s"), "left_anti")


def with_flag(rows: DataFrame, stock: DataFrame, key: str = "k", name: str = "in_stock", excluded: Column | None = None) -> DataFrame:
    """Every row with a membership flag; ``excluded`` (the run's own target) never counts as in stock."""
    on = F.col(key) == F.col("_s")
    if excluded is not None:
        on = on & (F.col(key) != excluded)
    return rows.join(stock.select(F.col("k").alias("_s")), on, "left").withColumn(name, F.col("_s").isNotNull()).drop("_s")
