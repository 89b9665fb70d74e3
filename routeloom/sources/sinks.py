"""Results as JSON, CSV and short texts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evolution import top
from ..operators.scoring import batch_summary


def _timed(reports: DataFrame) -> DataFrame:
    """Reports of runs that kept no time have none, rather than zero seconds."""
    return reports if "elapsed_s" in reports.columns else reports.withColumn("elapsed_s", F.lit(None).cast("double"))


def batch_json(reports: DataFrame) -> DataFrame:
    """(kind, json): one row with the summary and one per target, rounded for reading; nothing is collected."""
    rounded = reports.withColumns({c: F.round(c, 4) for c in ("bb_coverage", "synscore") if c in reports.columns})
    rows = rounded.select(F.lit("molecule").alias("kind"), F.to_json(F.struct(*[c for c in rounded.columns if c != "routes"])).alias("json"))
    summary = batch_summary(_timed(reports))
    return summary.select(F.lit("summary").alias("kind"), F.to_json(F.struct(*summary.columns)).alias("json")).unionByName(rows)


def evolution_json(pool: DataFrame, edges: DataFrame, stats: dict, max_molecules: int = 1000) -> str:
    """What a run did, the sizes of its network and its best molecules."""
    best = [r.asDict() for r in top(pool, max_molecules).select("m", "total", "depth", "parent_a", "parent_b").collect()]  # max_molecules rows
    return json.dumps(stats | {"molecules": pool.count(), "edges": edges.count(), "top": best})


def describe_batch(reports: DataFrame) -> str:
    s = batch_summary(_timed(reports)).first()
    return f"{s.n} targets, {s.n_evaluated} evaluated, {100 * s.solve_rate:.1f} % solved, mean coverage {s.mean_bb_coverage:.3f}"


def describe_evolution(pool: DataFrame, stats: dict, n: int = 10) -> str:
    lines = [f"{stats['rounds']} rounds, {stats['reactions']} pairs, ended: {stats['terminated_by']}"]
    return "\n".join(lines + [f"{r.m}  {r.total:.4f}  depth {r.depth}" for r in top(pool, n).collect()])


def describe_tree(tree: str, indent: int = 0) -> str:
    """A route's JSON tree as indented lines."""
    node = json.loads(tree) if isinstance(tree, str) else tree
    out = [" " * indent + node["smiles"] + (" (in stock)" if node["in_stock"] else "")]
    for r in node.get("children", []):
        out += [describe_tree(c, indent + 2) for c in r["children"]]
    return "\n".join(out)


def tree_steps(tree: str) -> list[tuple[str, list[str]]]:
    """(product, reactants) of every step of a route's JSON tree, the root's first."""
    out, todo = [], [json.loads(tree)]
    while todo:
        node = todo.pop(0)
        for r in node.get("children", []):
            out.append((node["smiles"], [c["smiles"] for c in r["children"]]))
            todo = r["children"] + todo
    return out


def all_leaves_in_stock(tree: str) -> bool:
    todo, ok = [json.loads(tree)], True
    while todo:
        node = todo.pop()
        parts = [c for r in node.get("children", []) for c in r["children"]]
        ok = ok and (bool(parts) or node["in_stock"])
        todo += parts
    return ok


def status_rows(reports: DataFrame) -> DataFrame:
    """One row per target with a status: OK, TIMEOUT or ERR."""
    status = F.when(F.col("error").isNotNull(), "ERR").when(F.col("terminated_by") == "time", "TIMEOUT").otherwise("OK")
    return reports.select(F.col("target").alias("smiles"), "solved", "bb_coverage", F.size("leaves").alias("num_leaves"), F.size(F.filter("leaves", lambda x: x["in_stock"])).alias("num_purchasable"), "u", "synscore", "min_steps", "min_route_depth", "expansions", status.alias("status"))


def save_csv(reports: DataFrame, path: str, shards: int = 8) -> None:
    """Status rows as CSV with one header per part; targets are dealt over the parts."""
    status_rows(reports).repartition(shards).write.mode("append").option("header", True).csv(path)
