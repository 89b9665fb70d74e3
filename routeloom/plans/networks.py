"""Reaction networks: fixpoints over rules, routes, searches, growth of a pool."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evolution as E
from ..operators import graph as G
from ..operators import ranking, routes
from ..session import table
from ..sources import projections as P
from .registry import query
from .relational import _PAIRS, react

#: Products halve along rules, so this many rounds reach every fixpoint of the test tables.
ROUNDS = 13
_NET = f"WITH RECURSIVE {P.RULES_SQL}, {P.STOCK_SQL}, edges AS (SELECT rule_id, product, score, unnest(reactants) AS child, unnest(range(0, len(reactants))) AS pos FROM rules)"


@query(f"WITH {P.RULES_SQL} SELECT rule_id, round(-ln(greatest(score, 1e-12::DOUBLE)), 6) AS cost FROM rules")
def neg_log_cost(spark, sf_dir):
    return P.rules(spark, sf_dir).select("rule_id", F.round(G.cost(F.col("score")), 6).alias("cost"))


@query(_NET + """, up AS (SELECT DISTINCT child AS k, product AS ancestor FROM edges WHERE child <> product),
reach AS (SELECT k, ancestor FROM up UNION SELECT r.k, u.ancestor FROM reach r JOIN up u ON u.k = r.ancestor)
SELECT k, ancestor FROM reach""")
def ancestor_closure(spark, sf_dir):
    return G.closure(P.rules(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")))


@query(f"""
WITH RECURSIVE {_PAIRS}, up AS (SELECT DISTINCT a AS k, product AS ancestor FROM made WHERE a <> product UNION SELECT DISTINCT b, product FROM made WHERE b <> product),
reach AS (SELECT k, ancestor FROM up UNION SELECT r.k, u.ancestor FROM reach r JOIN up u ON u.k = r.ancestor),
cand AS (SELECT DISTINCT p.n AS product, c.n AS child FROM (SELECT unnest(range(0, 75)) AS n) p, (SELECT unnest(range(0, 75)) AS n) c WHERE (p.n * 5 + c.n) % 7 = 0)
SELECT product, child FROM cand WHERE product <> child AND NOT EXISTS (SELECT 1 FROM reach WHERE k = product AND ancestor = child)""")
def cycle_reject(spark, sf_dir):
    from .relational import nation_reactions

    made = nation_reactions(spark, sf_dir).select(F.monotonically_increasing_id().alias("rule_id"), "product", F.lit(1.0).alias("score"), F.array("a", "b").alias("reactants"))
    # (5 product + child) mod 7 = 0 as an equality of remainders
    numbers = spark.range(75).withColumn("left", F.pmod(F.col("id") * 2, F.lit(7))).withColumn("right", F.pmod(F.col("id"), F.lit(7)))
    closure = G.closure(made, numbers.select(F.col("id").alias("k")))
    cand = numbers.select(F.col("id").alias("product"), F.col("left").alias("m")).join(numbers.select(F.col("id").alias("child"), F.col("right").alias("m")), "m").select("product", "child")
    return G.acyclic(cand, closure).select("product", "child")


def _levels(n: int) -> str:
    return ", ".join(f"d{i} AS MATERIALIZED (SELECT run, k, depth FROM d{i - 1} UNION ALL SELECT DISTINCT d.run, e.child, {i} FROM d{i - 1} d JOIN step e ON e.product = d.k WHERE d.depth = {i - 1} AND NOT EXISTS (SELECT 1 FROM d{i - 1} x WHERE x.run = d.run AND x.k = e.child))" for i in range(1, n + 1))


@query(_NET + f", step AS (SELECT DISTINCT product, child FROM edges), d0 AS (SELECT p_partkey AS run, p_partkey AS k, 0 AS depth FROM part), {_levels(5)} SELECT run, k, depth FROM d5")
def min_depth_intern(spark, sf_dir):
    roots = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run"), F.col("p_partkey").alias("k"))
    return G.min_depth(P.rules(spark, sf_dir), roots, 5)


def _solved_sql(n: int) -> str:
    return ", ".join(f"s{i} AS MATERIALIZED (SELECT k FROM s{i - 1} UNION SELECT product FROM (SELECT rule_id, product, bool_and(child IN (SELECT k FROM s{i - 1})) AS ok FROM edges GROUP BY 1, 2) WHERE ok)" for i in range(1, n + 1))


@query(_NET + f", s0 AS (SELECT k FROM stock), {_solved_sql(ROUNDS)} SELECT k FROM s{ROUNDS}")
def andor_solved(spark, sf_dir):
    return G.solved(P.rules(spark, sf_dir), P.stock(spark, sf_dir))


@query(_NET + """, v AS (SELECT p_partkey AS k, p_size, CASE WHEN p_partkey IN (SELECT k FROM stock) THEN 0::DOUBLE ELSE 0.1::DOUBLE * greatest(0, p_size - 12) END AS h FROM part)
SELECT k, round(h, 6) AS h, rank FROM (SELECT k, h, p_size, row_number() OVER (PARTITION BY k % 4 ORDER BY h DESC, k) AS rank FROM v WHERE k NOT IN (SELECT k FROM stock)) WHERE rank <= 32""")
def open_frontier(spark, sf_dir):
    from ..operators.stock import with_flag

    parts = with_flag(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size"), P.stock(spark, sf_dir)).where("NOT in_stock")
    h = routes.size_value(F.col("p_size"), F.col("in_stock"))
    top = ranking.top_k(parts.withColumn("h", h).withColumn("run", F.col("k") % 4), "run", [F.desc("h"), F.col("k")], 32)
    return top.select("k", F.round("h", 6).alias("h"), F.col("rank").cast("long").alias("rank"))


_BASE = """, mols AS (SELECT DISTINCT child AS k FROM edges UNION SELECT DISTINCT product FROM edges),
c AS MATERIALIZED (SELECT rule_id, product, child, -ln(greatest(score, 1e-12::DOUBLE)) AS c FROM edges),
r0 AS MATERIALIZED (SELECT k, k IN (SELECT k FROM stock) AS bought, k IN (SELECT product FROM edges) AS made, CASE WHEN k IN (SELECT k FROM stock) THEN 0::DOUBLE WHEN k IN (SELECT product FROM edges) THEN 'inf'::DOUBLE ELSE 1::DOUBLE END AS rn FROM mols)"""


def _rn_sql(n: int) -> str:
    return ", ".join(
        f"r{i} AS MATERIALIZED (SELECT r.k, bought, made, CASE WHEN bought OR NOT made THEN rn ELSE coalesce(best, 'inf'::DOUBLE) END AS rn FROM r{i - 1} r LEFT JOIN (SELECT product AS k, min(t) AS best FROM (SELECT rule_id, product, max(c) + sum(rn) AS t FROM c JOIN r{i - 1} x ON x.k = child GROUP BY 1, 2) GROUP BY 1) b USING (k))"
        for i in range(1, n + 1)
    )


_RN = _NET + _BASE + f", {_rn_sql(ROUNDS)}"


@query(_RN + f" SELECT k, round(rn, 6) AS rn FROM r{ROUNDS}")
def retro_rn(spark, sf_dir):
    return G.route_cost(P.rules(spark, sf_dir), P.stock(spark, sf_dir), F.lit(1.0), digits=6)


def _delta_sql(n: int) -> str:
    return ", ".join(f"e{i} AS MATERIALIZED (SELECT k, min(delta) AS delta FROM (SELECT k, delta FROM e{i - 1} UNION ALL SELECT child, rest + delta FROM e{i - 1} JOIN step ON product = k) GROUP BY 1)" for i in range(1, n + 1))


@query(_RN + f""", w AS (SELECT rule_id, product, child, c, rn FROM c JOIN r{ROUNDS} x ON x.k = child),
tot AS (SELECT rule_id, max(c) + sum(rn) AS t FROM w GROUP BY 1),
step AS MATERIALIZED (SELECT product, child, min(rest) AS rest FROM (SELECT w.product, w.child, max(t) - sum(rn) AS rest FROM w JOIN tot USING (rule_id) GROUP BY w.rule_id, w.product, w.child) GROUP BY 1, 2),
e0 AS (SELECT max(p_partkey) AS k, 0::DOUBLE AS delta FROM part), {_delta_sql(ROUNDS)} SELECT k, round(delta, 6) AS delta FROM e{ROUNDS}""")
def retro_delta(spark, sf_dir):
    rules = P.rules(spark, sf_dir)
    rn = G.route_cost(rules, P.stock(spark, sf_dir), F.lit(1.0))
    root = table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("k"))
    return G.route_delta(rules, rn, root).select("k", F.round("delta", 6).alias("delta"))


@query(_NET + f""", s0 AS (SELECT k FROM stock), {_solved_sql(ROUNDS)},
ok AS (SELECT e.rule_id, e.product, max(score) AS score FROM edges e GROUP BY 1, 2 HAVING bool_and(child IN (SELECT k FROM s{ROUNDS}))),
best AS (SELECT product, arg_max(rule_id, (score, -rule_id)) AS rule_id FROM ok WHERE product NOT IN (SELECT k FROM stock) GROUP BY 1),
walk AS (SELECT product AS target, product AS k, rule_id FROM best
  UNION SELECT w.target, b.product, b.rule_id FROM walk w JOIN edges e ON e.rule_id = w.rule_id JOIN best b ON b.product = e.child)
SELECT target, k, rule_id FROM walk""")
def route_best(spark, sf_dir):
    rules = P.rules(spark, sf_dir)
    stock = P.stock(spark, sf_dir)
    best = routes.cheapest_rules(rules, G.solved(rules, stock), stock)
    return routes.walk(best, rules, best.select(F.col("product").alias("target")))


@query(f"""
WITH {P.LEAVES_SQL}, l AS (SELECT o, k, in_stock, pos, (((k * 7) % 97) + 1) / 100::DOUBLE AS score FROM leaves),
m AS (SELECT o, count(*) AS n_leaves, avg(in_stock::INTEGER) AS coverage, count(DISTINCT pos) AS steps, exp(sum(ln(greatest(score, 1e-12::DOUBLE)))) AS score, max(pos)::BIGINT AS depth FROM l GROUP BY o)
SELECT o, n_leaves, round(coverage, 6) AS coverage, steps, round(score, 9) AS score, depth, row_number() OVER (PARTITION BY o % 100 ORDER BY round(coverage, 9) DESC, steps, round(score, 9) DESC, o) AS rank FROM m""")
def route_metrics(spark, sf_dir):
    leaves = P.leaves(spark, sf_dir).withColumn("score", ((F.col("k") * 7) % 97 + 1) / F.lit(100.0))
    m = routes.metrics(leaves, "o", "pos")
    ranked = routes.rank(m.withColumn("group", F.col("o") % 100), "group", "o")
    return ranked.select("o", "n_leaves", F.round("coverage", 6).alias("coverage"), "steps", F.round("score", 9).alias("score"), "depth", F.col("rank").cast("long").alias("rank"))


_ARMS = f"""
WITH {P.LEAVES_SQL}, arms AS (SELECT o, count(*) FILTER (pos <= 3) AS a_steps, bool_and(in_stock) FILTER (pos <= 3) AS a_solved, count(*) AS b_steps, bool_and(in_stock) AS b_solved, string_agg(k::VARCHAR, '.' ORDER BY pos, k, s) AS t FROM leaves GROUP BY o)"""


@query(_ARMS + " SELECT o, a_steps, b_steps, length(t)::BIGINT AS n_chars FROM arms WHERE a_solved AND b_solved AND a_steps <= 2 AND b_steps >= 2 ORDER BY b_steps DESC, n_chars, o LIMIT 50")
def route_contrast(spark, sf_dir):
    a = arms(spark, sf_dir)
    return a.where("a_solved AND b_solved AND a_steps <= 2 AND b_steps >= 2").orderBy(F.desc("b_steps"), "n_chars", "o").limit(50).select("o", "a_steps", "b_steps", "n_chars")


def arms(spark, sf_dir):
    """Two planners' results per order: arm a sees lines 1 to 3, arm b all lines."""
    early = F.col("pos") <= 3
    d = P.leaves(spark, sf_dir).groupBy("o").agg(
        F.count_if(early).alias("a_steps"),
        F.bool_and(F.when(early, F.col("in_stock"))).alias("a_solved"),
        F.count(F.lit(1)).alias("b_steps"),
        F.bool_and("in_stock").alias("b_solved"),
        (F.sum(F.length(F.col("k").cast("string"))) + F.count(F.lit(1)) - 1).alias("n_chars"),
        F.avg(F.col("in_stock").cast("double")).alias("b_coverage"),
        F.avg(F.when(early, F.col("in_stock").cast("double"))).alias("a_coverage"),
    )
    return d


@query(f"""
WITH {_PAIRS}, seen AS (SELECT a, b FROM pairs WHERE (a + b) % 5 = 0), tot AS (SELECT n_nationkey::BIGINT AS m, 1 - n_nationkey / 100::DOUBLE AS total FROM nation)
SELECT a, b, round(least(x.total, y.total), 6) AS priority FROM pairs JOIN tot x ON x.m = a JOIN tot y ON y.m = b
WHERE (a % 3 = 0 OR b % 3 = 0) AND a <> b AND (a, b) NOT IN (SELECT (a, b) FROM seen) ORDER BY priority DESC, a, b LIMIT 100""")
def pair_generation(spark, sf_dir):
    able = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("m"), (1 - F.col("n_nationkey") / F.lit(100.0)).alias("total"))
    every = able.select(F.col("m").alias("a")).join(able.select(F.col("m").alias("b")), F.col("a") <= F.col("b"))
    pairs = E.new_pairs(able, able.where("m % 3 = 0"), every.where("(a + b) % 5 = 0"), E.Settings(self_pairs=False))
    return pairs.withColumn("priority", F.round("priority", 6)).orderBy(F.desc("priority"), "a", "b").limit(100)


def _grown(spark, sf_dir, depth=1, threshold=0.1):
    seeds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("m"))
    return E.evolve(seeds, react, E.Settings(max_depth=depth, threshold=threshold))


_GROWN = f"""
WITH RECURSIVE {_PAIRS}, e AS MATERIALIZED (SELECT a, b, product, step FROM made WHERE product <> a AND product <> b),
x AS (SELECT product AS m, round(step, 12) AS total, 1 AS depth, a AS parent_a, b AS parent_b, step, row_number() OVER (PARTITION BY product ORDER BY round(step, 12) DESC, a, b, step) AS i FROM e WHERE product >= 25),
pool AS (SELECT n_nationkey::BIGINT AS m, 1::DOUBLE AS total, 0 AS depth, NULL::BIGINT AS parent_a, NULL::BIGINT AS parent_b FROM nation UNION ALL SELECT m, total, depth, parent_a, parent_b FROM x WHERE i = 1)"""


@query(_GROWN + " SELECT m, round(total, 6) AS total, depth, parent_a, parent_b FROM pool")
def evolve_relax(spark, sf_dir):
    return _grown(spark, sf_dir)[0].select("m", F.round("total", 6).alias("total"), "depth", "parent_a", "parent_b")


@query(_GROWN + " SELECT m, round(total, 6) AS total FROM pool WHERE depth >= 1 ORDER BY pool.total DESC, m LIMIT 10")
def evolve_top(spark, sf_dir):
    return E.top(_grown(spark, sf_dir)[0], 10, min_depth=1).select("m", F.round("total", 6).alias("total"))


@query(_GROWN + " SELECT m AS target, m, parent_a, parent_b FROM pool WHERE parent_a IS NOT NULL")
def evolve_route(spark, sf_dir):
    pool = _grown(spark, sf_dir)[0]
    return E.best_route(pool, pool.where("depth > 0").select("m")).select("target", "m", "parent_a", "parent_b")


@query()
def evolve_deep(spark, sf_dir):
    """Three rounds of a cyclic network; tests compare it with a plain loop."""
    return _grown(spark, sf_dir, 3, 0.9)[0].select("m", F.round("total", 6).alias("total"), "depth", "parent_a", "parent_b")


@query(f"WITH {_PAIRS}, e AS (SELECT * FROM made WHERE product <> a AND product <> b) SELECT a AS m, product FROM e UNION SELECT b, product FROM e")
def dependents(spark, sf_dir):
    from .relational import nation_reactions

    return E.dependents(nation_reactions(spark, sf_dir).where("product <> a AND product <> b"))


def _search(spark, sf_dir, algorithm):
    from .planner import Planner

    targets = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("target"))
    rules = P.rules(spark, sf_dir).select(F.col("product").cast("string").alias("product"), F.col("reactants").cast("array<string>").alias("reactants"), "score", F.col("rule_id").alias("template_id"))
    stock = P.stock(spark, sf_dir).select(F.col("k").cast("string").alias("k"))
    return Planner(rules, stock, algorithm=algorithm, value="zero").plan(targets, max_depth=5, max_expansions=60)


_COLUMNS = ["target", "solved", "bb_coverage", "min_steps", "num_routes", "u", "synscore", "expansions", "terminated_by", "error"]


@query()
def bfs_rounds(spark, sf_dir):
    return _search(spark, sf_dir, "bfs").select(*_COLUMNS)


@query()
def retrostar_plan(spark, sf_dir):
    return _search(spark, sf_dir, "retrostar").select(*_COLUMNS)


@query()
def mcts_plan(spark, sf_dir):
    return _search(spark, sf_dir, "mcts").select(*_COLUMNS)


@query()
def route_trees(spark, sf_dir):
    """Every step of every route found, with the nested tree as JSON."""
    return _search(spark, sf_dir, "retrostar").select("target", F.posexplode("routes").alias("route", "r")).select("target", "route", "r.steps", "r.tree")
