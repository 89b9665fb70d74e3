"""Chemistry and models as Arrow-batched functions and tables for DataFrames and SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chem, nn


@F.pandas_udf(T.StringType())
def canonical(s: pd.Series) -> pd.Series:
    return s.map(chem.canonicalize)


@F.pandas_udf(T.StringType())
def mol_key(s: pd.Series) -> pd.Series:
    return s.map(lambda x: chem.key(x))


@F.pandas_udf(T.IntegerType())
def heavy_atoms(s: pd.Series) -> pd.Series:
    return s.map(chem.heavy_atoms).astype("Int32")


@F.pandas_udf(T.StringType())
def largest_fragment(s: pd.Series) -> pd.Series:
    return s.map(lambda x: chem.largest_fragment(x or ""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def components(s: pd.Series) -> pd.Series:
    return s.map(lambda x: chem.components(x or ""))


@F.pandas_udf(T.BooleanType())
def has_radical(s: pd.Series) -> pd.Series:
    return s.map(lambda x: chem.has_radical(x) if chem.canonicalize(x) else None).astype("boolean")


_SIZES = ("n_atoms", "n_directed", "atom_width", "bond_width", "plain_atom_width", "plain_bond_width")


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in _SIZES]))
def graph_sizes(s: pd.Series) -> pd.DataFrame:
    both = [(nn.tensors(x), nn.tensors(x, True)) for x in s]
    return pd.DataFrame([(len(a[0]), a[1].shape[1], a[0].shape[1], a[2].shape[1], b[0].shape[1], b[2].shape[1]) if a else (None,) * 6 for a, b in both], columns=list(_SIZES))


@F.udtf(returnType=T.StructType().add("reactants", T.ArrayType(T.StringType())).add("match_atoms", T.ArrayType(T.IntegerType())))
class ApplyTemplate:
    def eval(self, smarts: str, product: str):
        for reactants, at in chem.apply_template(smarts or "", product or ""):
            yield list(reactants), list(at) if at else None


@F.udtf(returnType=T.StructType().add("product", T.StringType()))
class ApplyTemplateForward:
    def eval(self, smarts: str, reactants: str):
        for product in chem.apply_template_forward(smarts or "", reactants or ""):
            yield (product,)


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL."""
    for name, f in (("canonical_smiles", canonical), ("mol_key", mol_key), ("heavy_atoms", heavy_atoms), ("largest_fragment", largest_fragment), ("smiles_components", components)):
        spark.udf.register(name, f)
    spark.udtf.register("apply_template", ApplyTemplate)
    spark.udtf.register("apply_template_forward", ApplyTemplateForward)


PREDICTIONS = "array<struct<reactants:array<string>,score:double,template_id:int,center_avg:double>>"
FORWARD = "array<struct<product:string,score:double,template_id:int,n_templates:int>>"


def _batches(df: DataFrame, column: str, kind: str, parts: tuple, run) -> DataFrame:
    """Predictions of a model whose parts are broadcast once; a task builds it once."""
    shared = df.sparkSession.sparkContext.broadcast(parts)

    def each(frames):
        model = nn.TemplateModel(*shared.value)
        for f in frames:
            yield pd.DataFrame({column: f[column], "predictions": run(model, f[column].tolist())})

    return df.select(column).mapInPandas(each, f"{column} string, predictions {kind}")


def expand(molecules: DataFrame, weights: dict, templates: dict[int, str], top_k: int = 50, top_templates: int = 50) -> DataFrame:
    """(smiles, predictions) of a template model. Equal molecules are predicted once."""
    return _batches(molecules.select("smiles").distinct(), "smiles", PREDICTIONS, (weights, templates, top_templates), lambda model, s: model.predict(s, top_k))


def react(sets: DataFrame, weights: dict, templates: dict[int, str], top_k: int = 10, top_templates: int = 10) -> DataFrame:
    """(reactants, predictions) of a forward model."""
    return _batches(sets.select("reactants").distinct(), "reactants", FORWARD, (weights, templates, top_templates), lambda model, s: model.predict_forward(s, top_k))


def plausibility(weights: dict):
    """A column function (reactants, product) -> score."""

    @F.pandas_udf(T.DoubleType())
    def score(r: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(nn.Plausibility(weights).score(list(zip(r, p))))

    return score


def apply_rules(products: DataFrame, templates: DataFrame, top_k: int = 50, max_templates: int | None = None) -> DataFrame:
    """(product, reactants, score, template_id, rank) of prior-ranked templates (label, smarts, prior).

    Products are distinct; the templates' ordered list travels with the task, as in a model.
    """
    from ..operators.ranking import normalised_priors, top_k as best

    ordered = normalised_priors(templates.select("label", "smarts", "prior")).orderBy(F.desc("prior"), "label")
    rows = [(r.label, r.smarts, r.prior) for r in (ordered.limit(max_templates) if max_templates else ordered).toLocalIterator()]

    def each(frames):
        for f in frames:
            out = [(p, list(r), prior, label) for p in f["product"] for label, smarts, prior in rows for r, _ in chem.apply_template(smarts, p or "")]
            yield pd.DataFrame(out, columns=["product", "reactants", "score", "template_id"])

    made = products.select("product").distinct().mapInPandas(each, "product string, reactants array<string>, score double, template_id int")
    merged = made.groupBy("product", "reactants").agg(F.max(F.struct("score", (-F.col("template_id")).alias("t"))).alias("x")).select("product", "reactants", "x.score", (-F.col("x.t")).alias("template_id"))
    return best(merged, "product", [F.desc("score"), F.col("template_id"), F.col("reactants")], top_k)
