import json

import numpy as np

import routeloom
from routeloom import cli
from routeloom.functions import chem, nn
from routeloom.operators import evolution
from routeloom.plans import model
from routeloom.plans.kernel import ESTER

THIOESTER = "[C:1](=[O:2])-[S:3]-[CH3:4]>>[C:1](=[O:2])-[OH].[SH:3]-[CH3:4]"


def saved(tmp_path):
    np.savez(tmp_path / "model.npz", **nn.random_weights(2, 8, seed=1))
    (tmp_path / "templates.json").write_text(json.dumps({"0": ESTER, "1": THIOESTER}))
    (tmp_path / "stock.txt").write_text("\n".join(chem.key(s) for s in ("CCC(=O)O", "CO")))
    return str(tmp_path)


def test_model_planner(spark, tmp_path):
    """Expansions on demand: a shared molecule once, stock not at all; targets solved through the model's rules."""
    asked = []
    planner = routeloom.load_default_planner(spark, saved(tmp_path), value="zero")
    plain = planner.expand

    def counted(d):
        asked.extend(r.smiles for r in d.collect())
        return plain(d)

    planner.expand = counted
    targets = spark.createDataFrame([("COC(=O)CC",), ("CCC(=O)OC",), ("CCC(=O)SC",), ("CCCCl",), ("broken(",), (None,)], "target string")
    rows = {r.target: r for r in planner.plan(targets, max_depth=3).collect()}
    ester, thio = chem.canonicalize("CCC(=O)OC"), chem.canonicalize("CCC(=O)SC")
    assert rows[ester].solved and rows[ester].min_steps == 1 and rows[ester].elapsed_s > 0
    assert not rows[thio].solved and not rows[chem.canonicalize("CCCCl")].solved
    assert rows[None].error and set(rows) == {ester, thio, chem.canonicalize("CCCCl"), "broken(", None}
    assert len(asked) == len(set(asked)) and chem.canonicalize("CO") not in asked and chem.canonicalize("CS") in asked
    again = len(asked)
    assert {r.target for r in planner.plan(targets, max_depth=3).collect()} == set(rows) and len(asked) == again  # all from the cache
    scored = routeloom.load_default_scorer(spark, str(tmp_path)).score_batch(targets, 2)
    assert scored.where("solved").count() == 1


def test_forward_and_growth(spark, tmp_path, capsys):
    folder = saved(tmp_path)
    files = ["--model", f"{folder}/model.npz", "--templates", f"{folder}/templates.json"]
    assert cli.main(["forward", "CCC(=O)O.CO", *files]) == 0
    assert chem.canonicalize("CCC(=O)OC") in capsys.readouterr().out
    assert cli.main(["forward", "CCC", *files]) == 1
    assert cli.main(["plan", "CCC(=O)OC", "--stock", f"{folder}/stock.txt", *files]) == 0
    react = model.model_react(nn.load(f"{folder}/model.npz"), model.read_templates(spark, f"{folder}/templates.json"))
    seeds = spark.createDataFrame([(chem.canonicalize(s),) for s in ("CCC(=O)O", "CO", "CS")], "m string")
    pool, _, stats = evolution.evolve(seeds, react, evolution.Settings(max_depth=1, threshold=0.0))
    assert {chem.canonicalize("CCC(=O)OC"), chem.canonicalize("CCC(=O)SC")} <= {r.m for r in pool.collect()}
    assert stats["terminated_by"] == "exhausted"


def test_ring_bonds_equal_removal():
    for s in ("C1CC1CC2CC2", "c1ccc2ccccc2c1CC", "C1CC2CCC1C2.CC", "CCO"):
        g = chem.parse(s)
        for i in g.bonds:
            for j in g.bonds[i]:
                if i < j:
                    cut = chem.Graph(g.atoms, {a: {b: o for b, o in near.items() if {a, b} != {i, j}} for a, near in g.bonds.items()})
                    assert ((i, j) in nn.ring_bonds(g)) == any(i in p and j in p for p in cut.parts())
