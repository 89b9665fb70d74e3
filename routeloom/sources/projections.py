"""The engine's relations (rules, stock, orders, pools, logits) over the star-schema tables.

Every projection comes as a DataFrame and as the SQL of a common table
expression, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Reaction rules from part: product p from [p div 2, p div 3] or from [p div 5].
RULES_SQL = """rules AS (
  SELECT p_partkey * 2 + v AS rule_id, p_partkey AS product,
         CASE v WHEN 0 THEN [p_partkey // 2, p_partkey // 3] ELSE [p_partkey // 5] END AS reactants,
         ((p_partkey * 7 + v * 13) % 97 + 1) / 100::DOUBLE AS score
  FROM part, (VALUES (0), (1)) t(v) WHERE p_partkey >= 2)"""
STOCK_SQL = "stock AS (SELECT p_partkey AS k FROM part WHERE p_size <= 10)"
#: Line items as leaves of orders, in stock iff the part is.
LEAVES_SQL = f"{STOCK_SQL}, leaves AS (SELECT l_orderkey AS o, l_linenumber AS pos, l_partkey AS k, l_suppkey AS s, (l_partkey IN (SELECT k FROM stock)) AS in_stock FROM lineitem)"
#: Pair reactions of the pool seeded by nations.
PAIR_PRODUCT_SQL = "25 + ((a * 7 + b * 3) % 50)"
PAIR_STEP_SQL = "((a + b) % 50 + 50) / 100::DOUBLE"


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("product")
    t = table(spark, sf_dir, "part").where("p_partkey >= 2").select(F.col("p_partkey").alias("product"), F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    return t.select(
        (p * 2 + F.col("v")).alias("rule_id"),
        "product",
        F.when(F.col("v") == 0, F.array(F.floor(p / 2), F.floor(p / 3))).otherwise(F.array(F.floor(p / 5))).alias("reactants"),
        (((p * 7 + F.col("v") * 13) % 97 + 1) / F.lit(100.0)).alias("score"),
    )


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("k"))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"))
    flag = stock(spark, sf_dir).select("k", F.lit(True).alias("hit"))
    return own.join(flag, "k", "left").select("o", "pos", "k", "s", F.coalesce("hit", F.lit(False)).alias("in_stock"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
