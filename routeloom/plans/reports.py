"""Synthesizability reports of orders and customers, and their aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as R
from ..session import table
from ..sources import projections as P
from .registry import query

_LEAF = f"""
WITH {P.LEAVES_SQL}, r AS (SELECT o_orderkey AS o, o_custkey AS customer, count(k) AS num_leaves, coalesce(sum(in_stock::INTEGER), 0)::BIGINT AS num_purchasable, coalesce(max(pos), 0)::BIGINT AS depth, count(DISTINCT pos) AS steps FROM orders LEFT JOIN leaves ON o = o_orderkey GROUP BY 1, 2),
s AS (SELECT *, num_leaves - num_purchasable AS u, CASE WHEN num_leaves = 0 THEN 0::DOUBLE ELSE 1 / pow(num_leaves - num_purchasable + 1::DOUBLE, num_leaves - num_purchasable) END AS synscore, CASE WHEN num_leaves = 0 THEN 0::DOUBLE ELSE num_purchasable / num_leaves END AS bb_coverage, num_leaves > 0 AND num_leaves = num_purchasable AS solved FROM r)"""


def order_reports(spark, sf_dir):
    """One row per order; orders without lines have no leaves and score 0."""
    per = P.leaves(spark, sf_dir).groupBy("o").agg(F.count(F.lit(1)).alias("num_leaves"), F.sum(F.col("in_stock").cast("long")).alias("num_purchasable"), F.max("pos").cast("long").alias("depth"), F.countDistinct("pos").alias("steps"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("customer"))
    d = o.join(per, "o", "left").fillna(0, ["num_leaves", "num_purchasable", "depth", "steps"])
    u = F.col("num_leaves") - F.col("num_purchasable")
    coverage = F.when(F.col("num_leaves") == 0, 0.0).otherwise(F.col("num_purchasable") / F.col("num_leaves"))
    return d.withColumn("u", u).withColumn("synscore", R.score(u, F.col("num_leaves"))).withColumn("bb_coverage", coverage).withColumn("solved", (F.col("num_leaves") > 0) & (u == 0))


@query(_LEAF + " SELECT o, num_leaves, num_purchasable, u, round(synscore, 9) AS synscore FROM s")
def synscore(spark, sf_dir):
    return order_reports(spark, sf_dir).select("o", "num_leaves", "num_purchasable", "u", F.round("synscore", 9).alias("synscore"))


@query(_LEAF + """, b AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY u, -bb_coverage, steps, o) AS i, count(*) FILTER (u = 0) OVER (PARTITION BY customer) AS num_routes FROM s WHERE num_leaves > 0)
SELECT customer, o AS route, u, round(bb_coverage, 4) AS bb_coverage, num_leaves, num_routes, u = 0 AS solved, CASE WHEN u = 0 THEN steps END AS min_steps, round(synscore, 9) AS synscore FROM b WHERE i = 1""")
def molecule_report(spark, sf_dir):
    r = order_reports(spark, sf_dir).where("num_leaves > 0").withColumnRenamed("o", "route")
    best = R.best_report(r, "customer", "route")
    return best.select("customer", "route", "u", F.round("bb_coverage", 4).alias("bb_coverage"), "num_leaves", "num_routes", "solved", "min_steps", F.round("synscore", 9).alias("synscore"))


_EVENTS = "WITH r AS (SELECT event_id, ts, event_type <> 'error' AS ok, event_type = 'purchase' AS solved, value AS elapsed_s, (event_id % 11) / 10::DOUBLE AS bb_coverage FROM events)"


def event_reports(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", (F.col("event_type") == "purchase").alias("solved"), F.col("value").alias("elapsed_s"), ((F.col("event_id") % 11) / F.lit(10.0)).alias("bb_coverage"), F.when(F.col("event_type") == "error", "failed").alias("error"))


@query(_EVENTS + " SELECT count(*) AS n, count(*) FILTER (ok) AS n_evaluated, round(avg(solved::INTEGER) FILTER (ok), 6) AS solve_rate, round(avg(bb_coverage) FILTER (ok), 6) AS mean_bb_coverage, round(avg(elapsed_s) FILTER (ok), 6) AS mean_elapsed_s FROM r")
def batch_summary(spark, sf_dir):
    d = R.batch_summary(event_reports(spark, sf_dir))
    return d.select("n", "n_evaluated", *[F.round(c, 6).alias(c) for c in ("solve_rate", "mean_bb_coverage", "mean_elapsed_s")])


@query(_LEAF + " SELECT CASE WHEN num_leaves = 0 THEN 'none' WHEN u >= 5 THEN '5+' ELSE u::VARCHAR END AS bucket, count(*) AS n, round(avg(depth), 6) AS mean_depth FROM s GROUP BY 1")
def depth_histogram(spark, sf_dir):
    bucket = F.when(F.col("num_leaves") == 0, "none").when(F.col("u") >= 5, "5+").otherwise(F.col("u").cast("string"))
    return order_reports(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("depth"), 6).alias("mean_depth"))


@query(_LEAF + " SELECT depth, count(*) AS n FROM s WHERE solved GROUP BY 1")
def solved_depths(spark, sf_dir):
    return R.depth_histogram(order_reports(spark, sf_dir).where("solved"), "depth")


@query(_LEAF + " SELECT steps::INTEGER AS steps, round((SELECT count(*) FROM s WHERE solved AND depth <= g.steps) / (SELECT count(*) FROM s), 6) AS rate FROM (SELECT unnest(range(1, 8)) AS steps) g")
def solve_rate_at(spark, sf_dir):
    return R.solve_rate_at(order_reports(spark, sf_dir), "depth", 7).withColumn("rate", F.round("rate", 6))


@query(_EVENTS + " SELECT event_id, round(avg(solved::INTEGER) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS rate FROM r WHERE ok")
def running_rate(spark, sf_dir):
    r = event_reports(spark, sf_dir).where("error IS NULL").withColumn("day", F.to_date("ts"))
    return R.running_rate(r, ["ts", "event_id"], "solved", "day").select("event_id", F.round("rate", 6).alias("rate"))


@query(_LEAF + """ SELECT customer, '{"n":' || count(*) || ',"solved":' || count(*) FILTER (solved) || ',"best":[' || string_agg(u::VARCHAR, ',' ORDER BY u, o) || ']}' AS report FROM s GROUP BY customer""")
def json_report(spark, sf_dir):
    r = order_reports(spark, sf_dir).groupBy("customer").agg(F.count(F.lit(1)).alias("n"), F.count_if("solved").alias("solved"), F.array_sort(F.collect_list(F.struct("u", "o"))).alias("x"))
    return r.select("customer", F.to_json(F.struct("n", "solved", F.transform("x", lambda v: v["u"]).alias("best"))).alias("report"))
