"""Planning and growth with models: molecules are expanded on demand, all targets' frontiers in one batch a round."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nn, udf
from ..operators import cache as C
from ..session import cut
from ..sources import files
from .planner import Planner

Expand = Callable[[DataFrame], DataFrame]  # (smiles, k) -> (smiles, top_k, predictions)


def model_expand(weights: dict, templates: dict[int, str], width: int = 50, top_templates: int = 50) -> Expand:
    """Expansions by a template model."""
    return lambda asked: udf.expand(asked, weights, templates, width, top_templates).withColumn("top_k", F.lit(width))


def model_react(weights: dict, templates: dict[int, str], top_k: int = 5, top_templates: int = 10) -> Callable[[DataFrame], DataFrame]:
    """Pair reactions (a, b, product, step) by a forward model, for evolution.evolve."""

    def react(pairs: DataFrame) -> DataFrame:
        asked = pairs.select("a", "b", F.concat_ws(".", "a", "b").alias("reactants"))
        made = udf.react(asked, weights, templates, top_k, top_templates).select("reactants", F.explode("predictions").alias("x"))
        return asked.join(made, "reactants").select("a", "b", F.col("x.product").alias("product"), F.col("x.score").alias("step"))

    return react


def empty_cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"smiles string, top_k int, predictions {udf.PREDICTIONS}")


def network(targets: DataFrame, stock: DataFrame, expand: Expand, max_depth: int, width: int, cache: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, molecules of them that are in stock, cache afterwards).

    A round expands what the round before has met: every molecule once, whatever
    number of targets need it, through the cache. Molecules in stock are not
    expanded, but targets are.
    """
    spark = targets.sparkSession
    rules = spark.createDataFrame([], "product string, reactants array<string>, score double, template_id int")
    bought = lambda d: d.withColumn("key", udf.mol_key("k")).join(stock.select(F.col("k").alias("key")), "key", "left_semi").select("k")
    seen = front = cut(targets.select(F.col("target").alias("k")).where("k IS NOT NULL").distinct())
    held = cut(bought(seen))
    for _ in range(max_depth):
        answers, cache = C.read_through(front.select(F.col("k").alias("smiles"), F.lit(width).alias("k")), cache, expand)
        new = cut(answers.select(F.col("smiles").alias("product"), F.explode("predictions").alias("x")).select("product", "x.reactants", "x.score", "x.template_id"))
        cache, rules = cut(cache), cut(rules.unionByName(new))
        met = cut(new.select(F.explode("reactants").alias("k")).distinct().join(seen, "k", "left_anti"))
        seen, more = cut(seen.unionByName(met)), cut(bought(met))
        held, front = cut(held.unionByName(more)), cut(met.join(more, "k", "left_anti"))
        if front.limit(1).count() == 0:
            break
    return rules, held, cache


@dataclass
class ModelPlanner:
    """Plans with a model: its expansions, screened by ``plausibility`` if there is one, become the rules that the search runs on. ``stock`` holds molecule keys."""

    expand: Expand
    stock: DataFrame
    algorithm: str = "retrostar"
    width: int = 50
    value: str = "molsize"
    plausibility: Column | None = None
    threshold: float = 0.4
    cache: DataFrame | None = field(default=None)

    def plan(self, targets: DataFrame, max_depth: int = 6, **budget) -> DataFrame:
        asked = targets.select(F.coalesce(udf.canonical("target"), "target").alias("target"))
        before = self.cache if self.cache is not None else empty_cache(targets.sparkSession)
        rules, held, self.cache = network(asked.where(udf.canonical("target").isNotNull()), self.stock, self.expand, max_depth, self.width, before)
        return Planner(rules, held, self.algorithm, self.width, self.value, self.plausibility, self.threshold).plan(asked, max_depth, **budget)


def read_templates(spark: SparkSession, path: str) -> dict[int, str]:
    """A model's templates, which are part of the model and of its size."""
    rows = files.read_templates_json(spark, path) if path.endswith(".json") else files.read_templates_tsv(spark, path)
    return {r.label: r.smarts for r in rows.toLocalIterator()}


def load_default_planner(spark: SparkSession, folder: str | None = None, model: str | None = None, templates: str | None = None, stock: str | None = None, width: int = 50, top_templates: int = 50, **settings) -> ModelPlanner:
    """A planner from files: those named, or else model.npz, templates.json and stock.txt of the folder, the environment or the cache folder."""
    weights = nn.load(model or files.asset("model.npz", folder))
    known = read_templates(spark, templates or files.asset("templates.json", folder))
    keys = files.read_keys(spark, stock or files.asset("stock.txt", folder))
    return ModelPlanner(model_expand(weights, known, width, top_templates), keys, width=width, **settings)


def load_default_scorer(spark: SparkSession, folder: str | None = None, **settings):
    from .planner import Scorer

    return Scorer(load_default_planner(spark, folder, **settings))
