"""Multi-step planning of many targets at once, and their scores."""

from __future__ import annotations

import marshal
import re
import time
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranking, scoring
from ..operators.stock import with_flag
from ..session import cut
from . import search

REPORT = (
    "target string, solved boolean, bb_coverage double, min_steps int, min_route_depth int, num_routes int, u int, synscore double, "
    "leaves array<struct<smiles:string,in_stock:boolean>>, expansions int, nodes int, reactions int, terminated_by string, error string, elapsed_s double, "
    "routes array<struct<steps:int,depth:int,coverage:double,score:double,tree:string>>"
)

_LEAVES = pa.list_(pa.struct([("smiles", pa.string()), ("in_stock", pa.bool_())]))
_ROUTES = pa.list_(pa.struct([("steps", pa.int32()), ("depth", pa.int32()), ("coverage", pa.float64()), ("score", pa.float64()), ("tree", pa.string())]))
_KINDS = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}
REPORT_ARROW = pa.schema([(n, {"leaves": _LEAVES, "routes": _ROUTES}.get(n) or _KINDS[t]) for n, t in re.findall(r"(\w+) ([\w<>:,]+)(?:, |$)", REPORT)])


def _pack(batches):
    """Per product one value: its rules by rank as (reactants, score, template), and those of their reactants that are in stock."""
    for batch in batches:
        products, packed = batch.column("product").to_pylist(), []
        for ways in batch.column("ways").to_pylist():
            rules: dict[int, tuple] = {}
            for w in sorted(ways, key=lambda w: (w["rank"], w["pos"] or 0)):
                reactants = rules.setdefault(w["rank"], ([], float(w["score"]), int(w["template_id"])))[0]
                if w["pos"] is not None:
                    reactants.append(w["child"])
            flagged = list({w["child"] for w in ways if w["bought"]})
            packed.append(marshal.dumps(([(tuple(r), s, t) for r, s, t in rules.values()], flagged)))
        yield pa.RecordBatch.from_arrays([pa.array(products, pa.string()), pa.array(packed, pa.binary())], ["product", "steps"])


@dataclass(frozen=True)
class Planner:
    """Rules (product, reactants, score, template_id), stock (k) and a strategy.

    ``plausibility`` (a column over the rules) screens them before the search:
    those below the threshold go, but each product keeps one at least.
    """

    rules: DataFrame
    stock: DataFrame
    algorithm: str = "retrostar"
    width: int = 50
    value: str = "molsize"
    plausibility: Column | None = None
    threshold: float = 0.4
    overfetch: int = 1

    def __post_init__(self) -> None:
        search.get_algorithm(self.algorithm)
        search.get_value(self.value)

    def expansions(self) -> DataFrame:
        """(product, reactants, score, template_id, rank): the first ``width`` rules of each product."""
        r = self.rules.groupBy("product", F.array_sort("reactants").alias("reactants")).agg(F.max(F.struct("score", (-F.col("template_id")).alias("t"))).alias("x")).select("product", "reactants", "x.score", (-F.col("x.t")).alias("template_id"))
        order = [F.desc("score"), F.col("template_id"), F.col("reactants")]
        if self.plausibility is None:
            return ranking.top_k(r, "product", order, self.width)
        wide = ranking.top_k(r.withColumn("plausibility", self.plausibility), "product", order, self.width * self.overfetch)
        return ranking.plausibility_filter(wide, "product", self.threshold, 1, self.width).drop("rank", "plausibility").withColumnRenamed("new_rank", "rank")

    def plan(self, targets: DataFrame, max_depth: int = 6, max_expansions: int | None = 500, time_limit: float | None = None, exclude_target: bool = False) -> DataFrame:
        """A report per distinct target.

        Level by level the molecules that a target's search may expand (not in
        stock, made by a rule, less than max_depth below it) are joined to it;
        then the searches run one after the other over a partition's targets,
        each over its own part of the network, whose rules come packed.
        """
        algorithm, width, value = self.algorithm, self.width, self.value
        rules = cut(self.expansions().where("reactants IS NOT NULL"))
        stock = self.stock.select("k").distinct().hint("merge")
        ways = with_flag(rules.select("product", "rank", "score", "template_id", F.posexplode_outer("reactants").alias("pos", "child")), stock, "child", "bought")
        packed = cut(ways.groupBy("product").agg(F.collect_list(F.struct("rank", "pos", "child", "bought", "score", "template_id")).alias("ways")).mapInArrow(_pack, "product string, steps binary"))
        made = packed.select("product").hint("merge")
        open_ = ways.where("child IS NOT NULL AND NOT bought").select(F.col("product").alias("k"), "child").distinct()
        step = cut(open_.join(made, F.col("child") == F.col("product"), "left_semi")).hint("merge")
        runs = cut(with_flag(targets.select(F.col("target").alias("run")).distinct(), stock, "run"))
        seen = front = cut(runs.where("run IS NOT NULL" if exclude_target else "run IS NOT NULL AND NOT in_stock").join(made, F.col("run") == F.col("product"), "left_semi").select("run", F.col("run").alias("k")))
        for _ in range(max_depth - 1):
            new = front.join(step, "k").select("run", F.col("child").alias("k")).distinct()
            front = cut(new.join(seen.hint("merge"), ["run", "k"], "left_anti"))
            if front.limit(1).count() == 0:
                break
            seen = seen.unionByName(front)
        network = seen.join(packed.hint("merge"), F.col("k") == F.col("product")).groupBy("run").agg(F.collect_list(F.struct("k", "steps")).alias("network"))
        rows = runs.where("run IS NOT NULL").join(network.hint("merge"), "run", "left")

        def one(run, bought, network):
            known, buyable = {}, {run} if bought else set()
            for x in network or []:
                known[x["k"]], flagged = marshal.loads(x["steps"])
                buyable.update(flagged)
            limits = search.Limits(max_depth, max_expansions, time_limit)
            began = time.perf_counter()
            report = search.run(run, lambda k: known.get(k, []), buyable.__contains__, algorithm, limits, width, value, exclude_target)
            return report | {"elapsed_s": time.perf_counter() - began}

        def searched(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, 500):
                    yield pa.RecordBatch.from_pylist([one(*x.values()) for x in batch.slice(i, 500).to_pylist()], REPORT_ARROW)

        done = rows.select("run", "in_stock", "network").mapInArrow(searched, REPORT)
        bad = runs.where("run IS NULL").mapInPandas(lambda it: (pd.DataFrame([search.failed(None, "no molecule") | {"elapsed_s": 0.0}] * len(p)) for p in it if len(p)), REPORT)
        return done.unionByName(bad)


@dataclass(frozen=True)
class Scorer:
    """Scores targets by how far their best route is from being purchasable."""

    planner: Planner

    def score_batch(self, targets: DataFrame, max_steps: int = 5, **budget) -> DataFrame:
        return self.planner.plan(targets, max_depth=max_steps, **budget)

    @staticmethod
    def summary(reports: DataFrame) -> DataFrame:
        return scoring.batch_summary(reports)
