"""Steps that grew faster than their input, or passed through the driver."""

import time

import pytest
from pyspark.sql import functions as F

from routeloom.functions import text as T
from routeloom.operators import graph, routes, stats

EDGES = [(0, 4, [1, 2], 0.5), (1, 5, [4, 3], 0.4), (2, 6, [7], 0.9), (3, 7, [6, 5], 0.8), (4, 8, [6, 1], 0.7), (5, 9, [4], 0.6)]  # 6 and 7 make each other


@pytest.fixture
def plans(monkeypatch):
    """The joins without a merge hint, of everything that the operators cut; adaptive execution may broadcast these."""
    seen, cut = [], graph.cut

    def noted(df):
        seen.extend(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x and "strategy=merge" not in x)
        return cut(df)

    monkeypatch.setattr(graph, "cut", noted)
    monkeypatch.setattr(routes, "cut", noted)
    return seen


@pytest.fixture
def network(spark):
    return spark.createDataFrame(EDGES, "rule_id long, product long, reactants array<long>, score double"), spark.createDataFrame([(1,), (2,), (3,)], "k long")


def test_fixpoints_broadcast_nothing(network, plans):
    rules, stock = network
    done = graph.solved(rules, stock)
    assert {r.k for r in done.collect()} == {1, 2, 3, 4, 5, 9}
    rn = graph.route_cost(rules, stock, F.lit(1.0))
    assert {r.k for r in rn.where("rn < 100").collect()} == {1, 2, 3, 4, 5, 9}
    assert graph.min_depth(rules, rules.select(F.col("product").alias("run"), F.col("product").alias("k")), 5).count() == 34
    graph.route_delta(rules, rn, rules.agg(F.max("product").alias("k")))
    assert not plans


def test_walk_broadcasts_nothing(network, plans):
    rules, stock = network
    best = routes.cheapest_rules(rules, graph.solved(rules, stock), stock)
    walked = routes.walk(best, rules, best.select(F.col("product").alias("target")))
    assert {tuple(r) for r in walked.collect()} == {(4, 4, 0), (5, 5, 1), (5, 4, 0), (9, 9, 5), (9, 4, 0)}
    assert not plans


def test_closure_by_layers_and_cycles(spark, network, plans):
    rules, _ = network
    up = {(c, p) for _, p, cs, _ in EDGES for c in cs}
    want = set(up)
    while new := {(a, d) for a, b in want for c, d in up if b == c} - want:
        want |= new
    nodes = {x for e in up for x in e}
    got = [tuple(r) for r in graph.closure(rules, spark.createDataFrame([(x,) for x in nodes], "k long")).collect()]
    assert len(got) == len(want) and set(got) == want
    got = [tuple(r) for r in graph.closure(rules, spark.createDataFrame([(4,), (6,)], "k long")).collect()]
    assert sorted(got) == sorted(x for x in want if x[0] in (4, 6))
    assert not plans


def test_wilcoxon_of_many_pairs(spark):
    """n (n + 1) (2 n + 1) is beyond a long."""
    n = 2_000_000
    w = stats.wilcoxon(spark.range(n).select((F.col("id") % 3 - 1).cast("double").alias("x"), F.lit(0.5).alias("y")), "x", "y").first()
    assert w.n == n and w.w_plus + w.w_minus == n * (n + 1) / 2 and w.z < -100


def test_longest_of_many_parts(spark):
    """Linear in the number of parts; the first of equal ones."""
    d = spark.range(1).select(F.concat(F.lit("ab.abc.xyz."), F.repeat(F.lit("pq."), 60_000)).alias("t"))
    began = time.monotonic()
    assert d.select(T.longest(T.components(F.col("t"))).alias("x")).first().x == "abc"
    assert time.monotonic() - began < 20
    assert spark.range(1).select(T.longest(T.components(F.lit(" . "))).alias("x")).first().x is None
