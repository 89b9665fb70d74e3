import json

from routeloom import cli
from routeloom.functions import chem
from routeloom.plans import search
from routeloom.sources import sinks


def test_commands(spark, tmp_path, capsys):
    rules = spark.createDataFrame([("e", ["x", "y"], 0.7, 0), ("t", ["e", "z"], 0.8, 1)], "product string, reactants array<string>, score double, template_id int")
    rules.write.parquet(str(tmp_path / "rules"))
    (tmp_path / "keys.txt").write_text("x\ny\n")
    (tmp_path / "targets.smi").write_text("# targets\ne first\nt second\n")
    base = ["--rules", str(tmp_path / "rules"), "--stock", str(tmp_path / "keys.txt")]
    assert cli.main(["plan", "e", *base]) == 0 and cli.main(["plan", "t", *base]) == 1
    assert cli.main(["score", str(tmp_path / "targets.smi"), *base, "--output", str(tmp_path / "out")]) == 0
    assert "'solve_rate': 0.5" in capsys.readouterr().out
    rows = {r.target: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert rows["e"].solved and rows["t"].u == 1
    (tmp_path / "in.smi").write_text("CCO\nOCC\n")
    assert cli.main(["build-stock", str(tmp_path / "in.smi"), str(tmp_path / "stock")]) == 0
    assert spark.read.text(str(tmp_path / "stock")).count() == 1
    spark.createDataFrame([("a", "b", "p", 0.5)], "a string, b string, product string, step double").write.parquet(str(tmp_path / "edges"))
    assert cli.main(["evolve", "a.b", "--edges", str(tmp_path / "edges")]) == 0
    assert "p\t0.5000\tdepth 1" in capsys.readouterr().out
    a = cli.parser().parse_args(["score", "f", *base])
    assert (a.max_depth, a.width, a.algorithm, a.max_expansions) == (5, 50, "retrostar", 500)


def test_trees_and_sets():
    r = search.run("t", lambda k: {"t": [(("e", "z"), 0.8, 1)], "e": [(("x",), 0.5, 2)]}.get(k, []), {"x", "z"}.__contains__, value="zero")
    tree = r["routes"][0]["tree"]
    assert sinks.tree_steps(tree) == [("t", ["e", "z"]), ("e", ["x"])] and sinks.all_leaves_in_stock(tree)
    assert sinks.describe_tree(tree).splitlines()[0] == "t" and json.loads(tree)["smiles"] == "t"
    assert chem.canonical_set("OCC.C") == "C.CCO" and chem.canonical_set("C.bad!!") == ""


def test_batch_json(spark):
    d = spark.createDataFrame([("a", True, 1.0, None, 1.0), ("b", False, 0.33333, "x", 0.0)], "target string, solved boolean, bb_coverage double, error string, synscore double")
    rows = [(r.kind, json.loads(r.json)) for r in sinks.batch_json(d).collect()]
    assert rows[0][0] == "summary" and rows[0][1]["n"] == 2 and rows[0][1]["solve_rate"] == 1
    assert "2 targets" in sinks.describe_batch(d)
