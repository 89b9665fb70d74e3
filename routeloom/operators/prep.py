"""Preparation of data sets: sampling, relabelling, ragged filters, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import sum_before


def mixed(key: Column, seed: int) -> Column:
    """A fixed integer shuffle of a key, the same in every engine."""
    return (key * 7919 + seed * 104729) % 1000003


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, the same for every partitioning."""
    return df.orderBy(mixed(F.col(key), seed), key).limit(n)


def dense_relabel(kept: DataFrame, label: str, name: str = "new_label") -> DataFrame:
    """Old labels in order to 0, 1, 2, ...; counted by sorted ranges, so that no task holds them all."""
    return sum_before(kept.select(label).distinct().withColumn("_one", F.lit(1).cast("long")), label, "_one", name).select(label, name)


def filter_counts(rows: DataFrame, keep: Column) -> DataFrame:
    """One row: rows before and after a filter, and the share that stays."""
    return rows.agg(F.count(F.lit(1)).alias("n_in"), F.count_if(keep).alias("n_kept"), (F.count_if(keep) / F.count(F.lit(1))).alias("share"))


def split(key: Column) -> Column:
    """id modulo 20: 0 is test, 1 validation, the rest train."""
    m = F.pmod(key, F.lit(20))
    return F.when(m == 0, "test").when(m == 1, "valid").otherwise("train")


def target_sample(rows: DataFrame, key: str, fragment: Column, size: Column, identity: Column, low: int, high: int, n: int, seed: int) -> DataFrame:
    """The first n acceptable rows in shuffled order: size within the window, identity not met before."""
    d = rows.withColumn("fragment", fragment).withColumn("size", size).withColumn("identity", identity)
    ok = d.where(F.col("fragment").isNotNull() & F.col("size").between(low, high)).withColumn("_o", mixed(F.col(key), seed))
    first = ok.groupBy("identity").agg(F.min(F.struct("_o", key, "fragment", "size")).alias("x"))
    return first.select(F.col(f"x.{key}").alias(key), "x.fragment", "x.size", F.col("x._o").alias("_o")).orderBy("_o", key).limit(n).drop("_o")


def reject_counts(rows: DataFrame, fragment: Column, size: Column, low: int, high: int) -> DataFrame:
    """One row: how many rows each cause rejects."""
    return rows.agg(F.count_if(fragment.isNull()).alias("n_bad"), F.count_if(size < low).alias("n_small"), F.count_if(size > high).alias("n_large"))
