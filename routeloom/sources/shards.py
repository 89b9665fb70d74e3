"""Ragged arrays packed end to end with pointers, as rows and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import sum_before


def keep_labels(items: DataFrame, label_map: DataFrame, span: int = 4096) -> DataFrame:
    """Items (pos, label, values) of the kept labels (old, new): relabelled, with dense positions and the start of each item's values."""
    kept = items.join(label_map.select(F.col("old").alias("label"), "new"), "label").select("pos", F.col("new").alias("label"), "values", F.size("values").cast("long").alias("n"), F.lit(1).cast("long").alias("one"))
    placed = sum_before(sum_before(kept, "pos", "n", "start"), "pos", "one", "new_pos")
    return placed.select("new_pos", "label", "values", "start")


def lookup_table(labels: DataFrame, label_map: DataFrame) -> DataFrame:
    """(old, new) for every label, -1 for those not kept."""
    return labels.select(F.col("label").alias("old")).distinct().join(label_map, "old", "left").select("old", F.coalesce("new", F.lit(-1)).alias("new"))
