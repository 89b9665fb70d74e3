"""Queries of the chemistry and neural kernel over toy molecules; their SQL states the results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nn, udf
from .registry import query

#: Texts of molecules, another spelling of each, heavy atoms, bonds, whether an atom lacks hydrogens.
MOLECULES = [
    ("CC(C)CO", "OCC(C)C", 5, 4, False),
    ("Clc1ccccc1", "c1ccc(Cl)cc1", 7, 7, False),
    ("C=CC(=O)O", "OC(=O)C=C", 5, 4, False),
    ("C1CCOC1", "O1CCCC1", 5, 5, False),
    ("[CH2]CC", "CC[CH2]", 3, 2, True),
    ("CC#N", "N#CC", 3, 2, False),
    ("Brc1cc2ccccc2[nH]1", "[nH]1c(Br)cc2ccccc12", 10, 11, False),
]
#: Breaks a C-O bond of an ester into an acid and an alcohol; joins acid and alcohol when run forwards.
ESTER = "[C:1](=[O:2])-[O:3]-[CH3:4]>>[C:1](=[O:2])-[OH].[OH:3]-[CH3:4]"


def _sql(select: str) -> str:
    rows = ", ".join(f"('{a}', '{b}', {n}, {m}, {str(r).lower()})" for a, b, n, m, r in MOLECULES)
    return f"WITH m(smiles, other, atoms, bonds, radical) AS (VALUES {rows}) {select}"


def _molecules(spark):
    return spark.createDataFrame(MOLECULES, "smiles string, other string, atoms int, bonds int, radical boolean")


@query(_sql("SELECT smiles, atoms FROM m UNION ALL SELECT smiles || '.O', atoms + 1 FROM m UNION ALL SELECT 'C1CC', NULL"))
def kernel_heavy_atoms(spark, sf_dir):
    m = _molecules(spark)
    every = m.select("smiles").unionByName(m.select(F.concat("smiles", F.lit(".O")).alias("smiles"))).unionByName(spark.createDataFrame([("C1CC",)], "smiles string"))
    return every.select("smiles", udf.heavy_atoms("smiles").alias("atoms"))


@query(_sql("SELECT smiles, other, true AS same, true AS same_key, 27::BIGINT AS key_size FROM m"))
def kernel_identity(spark, sf_dir):
    m = _molecules(spark)
    return m.select("smiles", "other", (udf.canonical("smiles") == udf.canonical("other")).alias("same"), (udf.mol_key("smiles") == udf.mol_key("other")).alias("same_key"), F.length(udf.mol_key("smiles")).cast("long").alias("key_size"))


@query(_sql("SELECT a.smiles, b.smiles AS beside, 2::BIGINT AS n_parts, CASE WHEN b.atoms > a.atoms THEN 'second' ELSE 'first' END AS largest FROM m a JOIN m b ON a.smiles < b.smiles"))
def kernel_fragments(spark, sf_dir):
    m = _molecules(spark)
    pairs = m.select("smiles").join(m.select(F.col("smiles").alias("beside")), F.col("smiles") < F.col("beside"))  # pairs of the toy table
    text = F.concat("smiles", F.lit("."), "beside")
    largest = F.when(udf.largest_fragment(text) == udf.canonical("smiles"), "first").when(udf.largest_fragment(text) == udf.canonical("beside"), "second")
    return pairs.select("smiles", "beside", F.size(udf.components(text)).cast("long").alias("n_parts"), largest.alias("largest"))


@query(_sql("SELECT smiles, radical FROM m"))
def kernel_radical(spark, sf_dir):
    return _molecules(spark).select("smiles", udf.has_radical("smiles").alias("radical"))


@query(_sql(f"SELECT smiles, atoms::BIGINT AS n_atoms, 2 * bonds::BIGINT AS n_directed, {nn.ATOM_WIDTH}::BIGINT AS atom_width, {nn.BOND_WIDTH}::BIGINT AS bond_width, {nn.PLAIN_ATOM_WIDTH}::BIGINT AS plain_atom_width, {nn.PLAIN_BOND_WIDTH}::BIGINT AS plain_bond_width FROM m"))
def kernel_graph(spark, sf_dir):
    """Sizes of the molecules' graphs and of their features."""
    return _molecules(spark).select("smiles", udf.graph_sizes("smiles").alias("g")).select("smiles", "g.*")


@query("SELECT * FROM (VALUES ('CCC(=O)OC', 1::BIGINT, true), ('COC(=O)c1ccccc1', 1, true), ('CCCCl', 0, false), ('broken(', 0, false)) t(product, n_sets, is_acid_and_methanol)")
def sql_nn_udtf(spark, sf_dir):
    """A template applied by a table function in SQL."""
    udf.register(spark)
    spark.createDataFrame([("CCC(=O)OC", "CCC(=O)O"), ("COC(=O)c1ccccc1", "OC(=O)c1ccccc1"), ("CCCCl", None), ("broken(", None)], "product string, acid string").createOrReplaceTempView("kernel_products")
    return spark.sql(f"""
SELECT product, count(t.reactants) AS n_sets, coalesce(bool_and(size(t.reactants) = 2 AND array_contains(t.reactants, canonical_smiles(acid)) AND array_contains(t.reactants, canonical_smiles('CO'))), false) AS is_acid_and_methanol
FROM kernel_products LEFT JOIN LATERAL apply_template('{ESTER}', product) t ON true GROUP BY product""")


@query("SELECT * FROM (VALUES ('CCC(=O)O.CO', 1::BIGINT, true), ('CO.CCC(=O)O', 1, true), ('CCC(=O)O', 0, false)) t(reactants, n_products, is_ester)")
def kernel_forward(spark, sf_dir):
    """The template run forwards by a table function in SQL."""
    udf.register(spark)
    spark.createDataFrame([("CCC(=O)O.CO",), ("CO.CCC(=O)O",), ("CCC(=O)O",)], "reactants string").createOrReplaceTempView("kernel_sets")
    return spark.sql(f"""
SELECT reactants, count(t.product) AS n_products, coalesce(bool_and(t.product = canonical_smiles('CCC(=O)OC')), false) AS is_ester
FROM kernel_sets LEFT JOIN LATERAL apply_template_forward('{ESTER}', reactants) t ON true GROUP BY reactants""")


@query("SELECT * FROM (VALUES ('CCC(=O)OC', 4, 0.75::DOUBLE, 1::BIGINT)) t(product, template_id, score, rank)")
def kernel_rule_model(spark, sf_dir):
    """Prior-ranked templates as a one-step model."""
    products = spark.createDataFrame([("CCC(=O)OC",), ("CCCCl",), ("CCC(=O)OC",)], "product string")
    templates = spark.createDataFrame([(4, ESTER, 3.0), (9, "broken", 1.0)], "label int, smarts string, prior double")
    return udf.apply_rules(products, templates).select("product", "template_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT * FROM (VALUES ('CCC(=O)OC', 1::BIGINT, true), ('CCCCl', 0, true)) t(smiles, n_sets, in_unit)")
def kernel_template_model(spark, sf_dir):
    """A template model of seeded weights, expanded in Arrow batches."""
    weights = nn.random_weights(3, 16, seed=4)
    asked = spark.createDataFrame([("CCC(=O)OC",), ("CCCCl",), ("CCCCl",)], "smiles string")
    made = udf.expand(asked, weights, {0: ESTER, 1: "broken", 2: ESTER}, 10, 3)
    return made.select("smiles", F.size("predictions").cast("long").alias("n_sets"), F.forall("predictions", lambda p: (p["score"] > 0) & (p["score"] < 1) & (p["center_avg"] >= 0) & (p["center_avg"] <= 1)).alias("in_unit"))


@query("SELECT * FROM (VALUES ('CCC(=O)O.CO', 'CCC(=O)OC', true), ('broken(', 'CO', false)) t(reactants, product, scored)")
def kernel_plausibility(spark, sf_dir):
    """A plausibility model of seeded weights; what can't be read scores 0."""
    score = udf.plausibility(nn.random_weights(1, 16, True, seed=4))
    pairs = spark.createDataFrame([("CCC(=O)O.CO", "CCC(=O)OC"), ("broken(", "CO")], "reactants string, product string")
    return pairs.select("reactants", "product", (score("reactants", "product") > 0).alias("scored"))
