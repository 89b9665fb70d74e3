"""Growth of forward reaction networks: pairs, reactions, max-product relaxation, routes."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


@dataclass(frozen=True)
class Settings:
    max_depth: int = 3
    threshold: float = 0.1
    self_pairs: bool = True
    frontier_width: int | None = None
    max_reactions: int = 2_000_000
    max_pool: int | None = None
    max_rounds: int | None = None

    def __post_init__(self) -> None:
        if self.max_depth < 1:
            raise ValueError("max_depth must be 1 or more")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must lie in [0, 1]")


def reactable(pool: DataFrame, s: Settings) -> DataFrame:
    """(m, total): molecules good and shallow enough to react; the frontier_width best if one is set."""
    d = pool.where((F.col("total") >= s.threshold) & (F.col("depth") < s.max_depth)).select("m", "total")
    return d if s.frontier_width is None else d.orderBy(F.desc("total"), "m").limit(s.frontier_width)


def new_pairs(able: DataFrame, changed: DataFrame, reacted: DataFrame, s: Settings) -> DataFrame:
    """(a, b, priority): unordered pairs with a changed endpoint that have not reacted yet. The changed side is joined with all, never all with all."""
    left = able.join(changed.select("m"), "m", "left_semi").select(F.col("m").alias("x"), F.col("total").alias("tx"))
    right = able.select(F.col("m").alias("y"), F.col("total").alias("ty"))
    both = left.crossJoin(right)  # every pair is a reaction to try: the result itself; frontier_width and max_reactions bound it
    pairs = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.least("tx", "ty").alias("priority")).distinct()
    if not s.self_pairs:
        pairs = pairs.where("a <> b")
    return pairs.join(reacted.select("a", "b"), ["a", "b"], "left_anti")


def relax(pool: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Every product's best in-edge: the largest min(parents) * step, then the shallower, then the smaller (a, b); repeated until nothing changes. Sources stay (1, 0)."""
    while True:
        a = pool.select(F.col("m").alias("a"), F.col("total").alias("ta"), F.col("depth").alias("da"))
        b = pool.select(F.col("m").alias("b"), F.col("total").alias("tb"), F.col("depth").alias("db"))
        scored = edges.join(a, "a").join(b, "b").select(F.col("product").alias("m"), F.round(F.least("ta", "tb") * F.col("step"), 12).alias("total"), (F.greatest("da", "db") + 1).alias("depth"), "a", "b", "step")
        best = F.min(F.struct((-F.col("total")).alias("t"), F.col("depth"), F.col("a"), F.col("b"), F.col("step"))).alias("x")
        new = scored.join(sources.select("m"), "m", "left_anti").groupBy("m").agg(best).select("m", (-F.col("x.t")).alias("total"), "x.depth", F.col("x.a").alias("parent_a"), F.col("x.b").alias("parent_b"), "x.step")
        merged = cut(sources.select("m", "total", "depth", *[F.lit(None).cast(t).alias(c) for c, t in (("parent_a", dict(edges.dtypes)["a"]), ("parent_b", dict(edges.dtypes)["b"]), ("step", "double"))]).unionByName(new))
        old = pool.select("m", F.col("total").alias("t0"), F.col("depth").alias("d0"))
        changed = merged.join(old, "m", "full_outer").where("t0 IS NULL OR total IS NULL OR t0 <> total OR d0 <> depth").limit(1).count()
        pool = merged
        if not changed:
            break
    return pool


def evolve(seeds: DataFrame, react: Callable[[DataFrame], DataFrame], s: Settings = Settings()) -> tuple[DataFrame, DataFrame, dict]:
    """Pool (m, total, depth, parent_a, parent_b, step), edges (a, b, product, step) and what the run did.

    ``react`` maps pairs (a, b) to (a, b, product, step). Products equal to a
    reactant are dropped; equal edges are kept as often as they come.
    """
    sources = cut(seeds.select("m").where("m IS NOT NULL").distinct().select("m", F.lit(1.0).alias("total"), F.lit(0).alias("depth")))
    if sources.limit(1).count() == 0:
        raise ValueError("no seed molecule")
    pool, changed, edges, reacted, n, why = sources, sources, None, None, 0, "exhausted"
    rounds = 0
    while True:
        if rounds == s.max_rounds:
            why = "max_rounds"
            break
        able = reactable(pool, s)
        if reacted is None:
            kind = dict(sources.dtypes)["m"]
            reacted = sources.sparkSession.createDataFrame([], f"a {kind}, b {kind}")
        pairs = new_pairs(able, changed, reacted, s)
        room = s.max_reactions - n
        pairs = cut(pairs.orderBy(F.desc("priority"), "a", "b").limit(room))
        k = pairs.count()
        if k == 0:
            break
        rounds, n = rounds + 1, n + k
        reacted = cut(reacted.unionByName(pairs.select("a", "b")))
        made = react(pairs.select("a", "b")).where("product <> a AND product <> b").select("a", "b", "product", "step")
        edges = cut(made if edges is None else edges.unionByName(made))
        before = pool
        pool = relax(pool, edges, sources)
        changed = pool.join(before.select("m", F.col("total").alias("t0")), "m", "left").where("t0 IS NULL OR total > t0").select("m")
        if n >= s.max_reactions:
            why = "max_reactions"
            break
        if s.max_pool is not None and pool.count() >= s.max_pool:
            why = "max_pool_size"
            break
    return pool, edges, {"rounds": rounds, "reactions": n, "terminated_by": why}


def top(pool: DataFrame, n: int, min_depth: int = 0, min_total: float = 0.0) -> DataFrame:
    return pool.where((F.col("depth") >= min_depth) & (F.col("total") >= min_total)).orderBy(F.desc("total"), "m").limit(n)


def incoming(edges: DataFrame, product: DataFrame) -> DataFrame:
    return edges.join(product.select(F.col("m").alias("product")), "product", "left_semi")


def dependents(edges: DataFrame) -> DataFrame:
    """(m, product): the distinct products that use each molecule."""
    return edges.select(F.col("a").alias("m"), "product").unionByName(edges.select(F.col("b").alias("m"), "product")).distinct()


def best_route(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, m, parent_a, parent_b, step): the stored parents of each target and, in turn, of these; each molecule once, sources left out."""
    made = pool.where("parent_a IS NOT NULL").select("m", "parent_a", "parent_b", "step")
    front = targets.select(F.col("m").alias("target"), "m")
    out = None
    while True:
        got = front.join(made, "m").select("target", "m", "parent_a", "parent_b", "step")
        got = cut(got if out is None else got.join(out.select("target", "m"), ["target", "m"], "left_anti"))
        if got.limit(1).count() == 0:
            break
        out = got if out is None else out.unionByName(got)
        front = got.select("target", F.explode(F.array("parent_a", "parent_b")).alias("m")).distinct()
    return got if out is None else out
