"""Command line: plan, score, forward, evolve, build-stock.

Rules come as Parquet (product, reactants, score, template_id), or from a model
(.npz) and its templates; stock as a key file, targets as text.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .functions import nn
from .operators import evolution
from .plans.model import load_default_planner, model_react, read_templates
from .plans.planner import Planner, Scorer
from .session import session
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="routeloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("plan", "score"):
        c = sub.add_parser(name)
        c.add_argument("targets", help="a target, or a file of targets with score")
        c.add_argument("--rules")
        c.add_argument("--model")
        c.add_argument("--templates")
        c.add_argument("--stock", required=True)
        c.add_argument("--algorithm", default="retrostar", choices=["bfs", "retrostar", "mcts"])
        c.add_argument("--value", default="molsize", choices=["zero", "constant", "molsize"])
        c.add_argument("--max-depth", type=int, default=5)
        c.add_argument("--width", type=int, default=50)
        c.add_argument("--max-expansions", type=int, default=500)
        c.add_argument("--time-limit", type=float)
        c.add_argument("--exclude-target", action="store_true")
        c.add_argument("--output")
    c = sub.add_parser("forward")
    c.add_argument("reactants", help="molecules between dots")
    c.add_argument("--model", required=True)
    c.add_argument("--templates", required=True)
    c.add_argument("--top-k", type=int, default=10)
    c.add_argument("--top-templates", type=int, default=10)
    c = sub.add_parser("evolve")
    c.add_argument("seeds", help="molecules between dots")
    c.add_argument("--edges", help="Parquet of pair reactions (a, b, product, step)")
    c.add_argument("--model")
    c.add_argument("--templates")
    c.add_argument("--max-depth", type=int, default=3)
    c.add_argument("--threshold", type=float, default=0.1)
    c.add_argument("--frontier-width", type=int)
    c.add_argument("--no-self-pairs", action="store_true")
    c.add_argument("--top", type=int, default=20)
    c = sub.add_parser("build-stock")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--column", type=int, default=0)
    c.add_argument("--delimiter")
    c.add_argument("--skip-header", action="store_true")
    c.add_argument("--gzip", action="store_true")
    return p


def describe(report) -> str:
    """A short text of one report row."""
    if report.error:
        return f"{report.target}: error: {report.error}"
    state = "solved" if report.solved else "unsolved"
    steps = f", {report.min_steps} steps" if report.solved else f", {report.u} missing"
    return f"{report.target}: {state}{steps}, coverage {report.bb_coverage:.3f}, score {report.synscore:.3f} ({report.expansions} expansions, {report.terminated_by})"


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    if a.command == "build-stock":
        files.save_keys(files.stock_from_smiles(files.read_column(spark, a.input, a.column, a.delimiter, a.skip_header)), a.output, a.gzip)
        return 0
    if a.command == "forward":
        model = nn.TemplateModel(nn.load(a.model), read_templates(spark, a.templates), a.top_templates)
        found = model.predict_forward([a.reactants], a.top_k)[0]
        for i, p in enumerate(found, 1):
            print(f"{i}\t{p['product']}\t{p['score']:.4f}\ttemplate {p['template_id']}")
        if not found:
            print("nothing predicted")
        return 0 if found else 1
    if a.command == "evolve":
        react = model_react(nn.load(a.model), read_templates(spark, a.templates)) if a.model else None
        known = None if react else spark.read.parquet(a.edges)
        seeds = files.reaction_seeds(spark.createDataFrame([(a.seeds,)], "value string"))
        s = evolution.Settings(max_depth=a.max_depth, threshold=a.threshold, self_pairs=not a.no_self_pairs, frontier_width=a.frontier_width)
        pool, _, stats = evolution.evolve(seeds, react or (lambda pairs: known.join(pairs, ["a", "b"], "left_semi")), s)
        print(stats)
        for r in evolution.top(pool, a.top).collect():
            print(f"{r.m}\t{r.total:.4f}\tdepth {r.depth}")
        return 0
    if a.model:
        planner = load_default_planner(spark, model=a.model, templates=a.templates, stock=a.stock, width=a.width, algorithm=a.algorithm, value=a.value)
    else:
        planner = Planner(spark.read.parquet(a.rules), files.read_keys(spark, a.stock), a.algorithm, a.width, a.value)
    one = a.command == "plan"
    targets = spark.createDataFrame([(a.targets,)], "target string") if one else files.read_targets(spark, a.targets)
    out = Scorer(planner).score_batch(targets, a.max_depth, max_expansions=a.max_expansions, time_limit=a.time_limit, exclude_target=a.exclude_target)
    if a.output:
        files.save_reports(out, a.output)
        out = spark.read.json(a.output, schema=out.schema)
    if one:
        r = out.first()
        print(describe(r))
        for route in r.routes:
            print(route.tree)
        return 0 if r.solved else 1
    print(Scorer.summary(out.withColumn("error", F.col("error"))).first().asDict())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
