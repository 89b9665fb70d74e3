"""AND-OR graphs held as DataFrames: closures, solved flags, route costs. One loop per fixpoint, all runs at once.

Joins inside the loops are merge joins by hint: a broadcast per round would pass
through the driver and stay there until its next collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def cost(score: Column) -> Column:
    """-ln(max(score, 1e-12))."""
    return -F.log(F.greatest(score, F.lit(1e-12)))


def edges(rules: DataFrame) -> DataFrame:
    """(rule_id, product, pos, child)."""
    return rules.select("rule_id", "product", "score", F.posexplode("reactants").alias("pos", "child"))


def solved(rules: DataFrame, stock: DataFrame) -> DataFrame:
    """Molecules that are in stock or made by a rule all of whose children are solved, to the fixpoint.

    Semi-naive: a round joins only the rules of molecules solved in the round
    before, adds to each rule's number of solved children, and solves the
    products of those that have all.
    """
    e = cut(edges(rules).select("rule_id", "product", "child").distinct())
    need = cut(e.groupBy("rule_id", "product").agg(F.count(F.lit(1)).alias("need")))
    done = front = cut(stock.select("k").distinct())
    have = None
    while True:
        hit = e.join(front.withColumnRenamed("k", "child").hint("merge"), "child").groupBy("rule_id", "product").agg(F.count(F.lit(1)).alias("n"))
        have = cut(hit if have is None else have.unionByName(hit).groupBy("rule_id", "product").agg(F.sum("n").alias("n")))
        full = have.join(need.hint("merge"), ["rule_id", "product"]).where("n = need").select(F.col("product").alias("k")).distinct()
        front = cut(full.join(done.hint("merge"), "k", "left_anti"))
        if front.limit(1).count() == 0:
            return done
        done = cut(done.unionByName(front))


def min_depth(rules: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(run, k, depth): the smallest number of reactions from the run's root, up to max_depth."""
    step = edges(rules).select(F.col("product").alias("k"), "child").distinct()
    seen = cut(roots.select("run", "k", F.lit(0).alias("depth")))
    front = seen
    for d in range(1, max_depth + 1):
        new = front.join(step.hint("merge"), "k").select("run", F.col("child").alias("k")).distinct().join(seen.select("run", "k").hint("merge"), ["run", "k"], "left_anti").withColumn("depth", F.lit(d))
        new = cut(new)
        if new.limit(1).count() == 0:
            break
        seen, front = seen.unionByName(new), new
    return seen


def closure(rules: DataFrame, roots: DataFrame) -> DataFrame:
    """(k, ancestor): everything that each root can be made into.

    Products come in layers: one is taken when all its children are done, and has
    what its children have, as one array a product; so every pair is made once per
    child. What is on a cycle, or above one, is closed pair by pair.
    """
    up = cut(edges(rules).select(F.col("child").alias("k"), F.col("product").alias("ancestor")).where("k <> ancestor").distinct())
    own, rest, below = roots.select("k").distinct(), up, None
    # leaves have nothing below them
    front = cut(up.select("k").distinct().join(up.select(F.col("ancestor").alias("k")).hint("merge"), "k", "left_anti"))
    while True:
        # an edge goes when its child is done; a product is done when none of its edges is left
        candidates = rest.join(front.hint("merge"), "k", "left_semi").select("ancestor").distinct()
        rest = cut(rest.join(front.hint("merge"), "k", "left_anti"))
        ready = cut(candidates.join(rest.select("ancestor").hint("merge"), "ancestor", "left_anti"))
        if ready.limit(1).count() == 0:
            break
        mine = up.join(ready.hint("merge"), "ancestor", "left_semi")
        if below is None:
            new = mine.groupBy("ancestor").agg(F.collect_set("k").alias("ks"))
        else:
            held = mine.join(below.withColumnRenamed("ancestor", "k").hint("merge"), "k", "left")
            new = held.groupBy("ancestor").agg(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("k"), F.coalesce("ks", F.array().cast(below.schema["ks"].dataType)))))).alias("ks"))
        new = cut(new)
        below = new if below is None else below.unionByName(new)
        front = ready.select(F.col("ancestor").alias("k"))
    pairs = None if below is None else below.select(F.explode("ks").alias("k"), "ancestor")
    if rest.limit(1).count():
        looped = _pairs(cut(up.join(rest.select("ancestor").hint("merge"), "ancestor", "left_semi")), pairs)
        pairs = looped if pairs is None else pairs.unionByName(looped)
    if pairs is None:
        return up.select("k", "ancestor").join(own, "k", "left_semi")
    return pairs.join(own.hint("merge"), "k", "left_semi").select("k", "ancestor")


def _pairs(up: DataFrame, known: DataFrame | None) -> DataFrame:
    """(k, ancestor) for the ancestors of ``up``, by semi-naive evaluation; ``known`` are the pairs of all others."""
    total = up
    if known is not None:
        total = total.unionByName(known.select("k", F.col("ancestor").alias("_m")).join(up.select(F.col("k").alias("_m"), "ancestor").hint("merge"), "_m").select("k", "ancestor")).distinct()
    total = delta = cut(total)
    while True:
        new = delta.select("k", F.col("ancestor").alias("_m")).join(up.select(F.col("k").alias("_m"), "ancestor").hint("merge"), "_m").select("k", "ancestor").distinct()
        delta = cut(new.join(total.hint("merge"), ["k", "ancestor"], "left_anti"))
        if delta.limit(1).count() == 0:
            return total
        total = total.unionByName(delta)


def acyclic(candidates: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Candidate edges (product, child) that close no cycle: the child is neither the product nor one of its ancestors."""
    return candidates.where("product <> child").join(ancestors.select(F.col("k").alias("product"), F.col("ancestor").alias("child")), ["product", "child"], "left_anti")


def route_cost(rules: DataFrame, stock: DataFrame, leaf: Column, max_rounds: int = 64, digits: int = 9) -> DataFrame:
    """(k, rn): 0 in stock, ``leaf`` where no rule makes it, or else the least over rules of cost plus the children's rn, iterated to the fixpoint."""
    e = cut(edges(rules).select("rule_id", "product", cost(F.col("score")).alias("c"), "child"))
    every = e.select(F.col("child").alias("k")).unionByName(e.select(F.col("product").alias("k"))).distinct()
    made = e.select(F.col("product").alias("k")).distinct().withColumn("made", F.lit(True))
    base = every.join(stock.select("k", F.lit(True).alias("bought")).hint("merge"), "k", "left").join(made.hint("merge"), "k", "left")
    inf = F.lit(float("inf"))
    rn = cut(base.select("k", "bought", "made", F.when(F.col("bought"), 0.0).when(F.col("made"), inf).otherwise(leaf).alias("rn")))
    for _ in range(max_rounds):
        total = e.join(rn.select(F.col("k").alias("child"), "rn").hint("merge"), "child").groupBy("rule_id", "product").agg((F.max("c") + F.sum("rn")).alias("t"))
        best = total.groupBy(F.col("product").alias("k")).agg(F.min("t").alias("best"))
        new = cut(rn.join(best.hint("merge"), "k", "left").select("k", "bought", "made", F.when(F.col("bought") | F.col("made").isNull(), F.col("rn")).otherwise(F.coalesce("best", inf)).alias("rn"), F.col("rn").alias("old")))
        changed = new.where("abs(rn - old) > 1e-9 OR (rn <> old AND (rn = double('inf') OR old = double('inf')))").limit(1).count()
        rn = new.drop("old")
        if not changed:
            break
    return rn.select("k", F.round("rn", digits).alias("rn"))


def route_delta(rules: DataFrame, rn: DataFrame, root: DataFrame) -> DataFrame:
    """(k, delta): least cost of everything else on a route from the root that uses k: 0 at the root, or else the least over parent rules of their total less the own rn, plus the parent's delta."""
    e = edges(rules).select("rule_id", "product", cost(F.col("score")).alias("c"), "child")
    with_rn = e.join(rn.select(F.col("k").alias("child"), "rn").hint("merge"), "child")
    total = with_rn.groupBy("rule_id").agg((F.max("c") + F.sum("rn")).alias("t"))
    # equal children of one rule are both left out of each other's siblings
    own = with_rn.groupBy("rule_id", "product", "child").agg(F.sum("rn").alias("own")).join(total.hint("merge"), "rule_id").select("product", "child", (F.col("t") - F.col("own")).alias("rest"))
    step = cut(own.groupBy("product", "child").agg(F.min("rest").alias("rest")))
    best = cut(root.select("k", F.lit(0.0).alias("delta")))
    while True:
        new = best.select(F.col("k").alias("product"), "delta").join(step.hint("merge"), "product").groupBy(F.col("child").alias("k")).agg(F.min(F.col("rest") + F.col("delta")).alias("delta"))
        merged = cut(best.unionByName(new).groupBy("k").agg(F.min("delta").alias("delta")))
        old = best.select("k", F.col("delta").alias("old"))
        changed = merged.join(old.hint("merge"), "k", "left").where("old IS NULL OR old - delta > 1e-9").limit(1).count()
        best = merged
        if not changed:
            break
    return best
