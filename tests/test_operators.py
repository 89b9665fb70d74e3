import math

import pytest
from pyspark.sql import functions as F

from routeloom.functions import text as T
from routeloom.operators import cache, graph, prep, ranking, scoring, stats, stock
from routeloom.sources import files, shards


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stock(spark):
    s = stock.stock_of(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string"))
    q = spark.createDataFrame([("a",), ("c",), (None,)], "k string")
    assert s.count() == 2 and rows(stock.add(s, q)) == [("a",), ("b",), ("c",)]
    assert rows(stock.purchasable(q, s)) == [("a",)] and rows(stock.missing(q, s)) == [("c",), (None,)]
    assert rows(stock.with_flag(q, s)) == [("a", True), ("c", False), (None, False)]
    assert stock.with_flag(q, stock.empty(s)).where("in_stock").count() == 0
    assert rows(stock.with_flag(q.where("k = 'a'"), s, excluded=F.lit("a"))) == [("a", False)]


def test_toy_network(spark):
    r = spark.createDataFrame([(0, "e", ["x", "y"], 0.7), (1, "e", ["e"], 0.05), (2, "t", ["x", "m"], 0.8), (3, "m", ["z"], 0.6)], "rule_id int, product string, reactants array<string>, score double")
    s = spark.createDataFrame([("x",), ("y",), ("z",)], "k string")
    assert {k for (k,) in rows(graph.solved(r, s))} == {"x", "y", "z", "e", "m", "t"}
    assert {k for (k,) in rows(graph.solved(r, s.where("k <> 'z'")))} == {"x", "y", "e"}
    rn = dict(rows(graph.route_cost(r, s, F.lit(1.0))))
    assert rn["t"] == pytest.approx(-math.log(0.8) - math.log(0.6)) and rn["e"] == pytest.approx(-math.log(0.7))
    rn = dict(rows(graph.route_cost(r, s.where("k <> 'z'"), F.lit(2.0))))
    assert rn["m"] == pytest.approx(2 - math.log(0.6))


def test_cache(spark):
    c = spark.createDataFrame([("a", 3, ["p", "q", "r"]), ("b", 1, ["s"]), ("e", 5, [])], "smiles string, top_k int, predictions array<string>")
    q = spark.createDataFrame([("a", 2), ("b", 2), ("n", 1), ("e", 4), ("n", 1)], "smiles string, k int")
    seen = []

    def expand(m):
        seen.extend(rows(m))
        return m.select("smiles", F.col("k").alias("top_k"), F.array(F.lit("new"), F.lit("more")).alias("predictions"))

    answers, after = cache.read_through(q, c, expand)
    assert [(a, b, list(p)) for a, b, p in rows(answers.select("smiles", "k", "predictions"))] == [("a", 2, ["p", "q"]), ("b", 2, ["new", "more"]), ("e", 4, []), ("n", 1, ["new"]), ("n", 1, ["new"])]
    assert seen == [("b", 2), ("n", 1)]
    assert {x: k for x, k, _ in rows(after.select("smiles", "top_k", "predictions"))} == {"a": 3, "b": 2, "e": 5, "n": 1}
    h = cache.hit_rate(q, c).first()
    assert (h.hits, h.misses, h.hit_rate) == (2, 3, 0.4) and cache.hit_rate(q.limit(0), c).first().hit_rate == 0


def test_filter_keeps_one(spark):
    d = spark.createDataFrame([("p", 1, 0.1), ("p", 2, 0.3), ("q", 1, 0.2), ("q", 2, 0.9), ("q", 3, None)], "product string, rank int, plausibility double")
    assert [(p, r) for p, r, *_ in rows(ranking.plausibility_filter(d, "product"))] == [("p", 1), ("q", 2)]


def test_reports(spark):
    d = spark.createDataFrame([(True, 1.0, 1.0, None, 1), (True, 1.0, 3.0, None, 4), (False, 0.5, 9.0, "x", None)], "solved boolean, bb_coverage double, elapsed_s double, error string, depth int")
    s = scoring.batch_summary(d).first()
    assert (s.n, s.n_evaluated, s.solve_rate, s.mean_elapsed_s) == (3, 2, 1.0, 2.0)
    ok = d.where("error IS NULL")
    assert dict(rows(scoring.solve_rate_at(ok, "depth", 4))) == {1: 0.5, 2: 0.5, 3: 0.5, 4: 1.0}
    assert rows(scoring.depth_histogram(ok, "depth")) == [(1, 1), (4, 1)]
    assert scoring.batch_summary(d.limit(0)).first().solve_rate == 0


def test_statistics(spark):
    assert stats.mcnemar_exact(68, 35) == pytest.approx(0.0015, abs=2e-4) and stats.mcnemar_exact(0, 0) == 1
    d = spark.createDataFrame([(float(i), float(i * i % 7)) for i in range(40)], "x double, y double")
    c = stats.correlations(d, "x", "y").first()
    b = stats.bootstrap_ci(d, "x", "y", 300).first()
    assert b.low <= c.pearson <= b.high
    w = stats.wilcoxon(spark.createDataFrame([(1.0, 2.0), (3.0, 1.0), (4.0, 4.0), (9.0, 1.0)], "x double, y double"), "x", "y").first()
    assert (w.n, w.w_plus, w.w_minus) == (3, 5.0, 1.0)


def test_text(spark):
    d = spark.createDataFrame([("A.B>>CCO.CC(=O)N",), ("a>b>c",), ("none",), ("a>b",)], "s string").select(T.parse_reaction(F.col("s")).alias("r"))
    got = [r.r for r in d.collect()]
    assert got[0].left == ["A", "B"] and got[0].agents == [] and got[1].agents == ["b"] and got[2] is None and got[3] is None
    p = spark.createDataFrame([("[C:1]>>[C:1].[O:2]",), ("C.C>>C.C",), ("C>>C",)], "s string").select(T.is_simplifying(F.col("s")).alias("x"))
    assert [r.x for r in p.collect()] == [True, False, False]


def test_relabel_and_shards(spark):
    kept = spark.createDataFrame([(5000,), (7,), (9,), (7,)], "label int")
    assert dict(rows(prep.dense_relabel(kept, "label"))) == {7: 0, 9: 1, 5000: 2}
    items = spark.createDataFrame([(0, 7, [1.0, 2.0]), (1, 8, [3.0]), (2, 9, [4.0])], "pos long, label int, values array<double>")
    m = spark.createDataFrame([(7, 0), (9, 1)], "old int, new int")
    assert [(a, b, list(v), s) for a, b, v, s in rows(shards.keep_labels(items, m))] == [(0, 0, [1.0, 2.0], 0), (1, 1, [4.0], 2)]
    assert rows(shards.lookup_table(items, m)) == [(7, 0), (8, -1), (9, 1)]


def test_files(spark, tmp_path):
    (tmp_path / "in.smi").write_text("head er\n# note\n\nCCO ethanol\nOCC again\nbad!! x\nc1ccccc1\n")
    d = files.read_column(spark, str(tmp_path / "in.smi"), skip_header=True)
    assert rows(d) == [("CCO",), ("OCC",), ("bad!!",), ("c1ccccc1",)]
    s = files.stock_from_smiles(d)
    assert s.count() == 2
    files.save_keys(s, str(tmp_path / "keys"), gzip=True)
    assert rows(files.read_keys(spark, str(tmp_path / "keys"))) == rows(s)
    with pytest.raises(Exception, match="unreadable molecule"):
        files.stock_from_smiles(d, on_error="raise").count()
    (tmp_path / "t.json").write_text('{"3": "C>>O", "1": "N>>C"}')
    (tmp_path / "t.tsv").write_text("label\tsmarts\n3\tC>>O\n1\tN>>C\n")
    assert rows(files.read_templates_json(spark, str(tmp_path / "t.json"))) == rows(files.read_templates_tsv(spark, str(tmp_path / "t.tsv"))) == [(1, "N>>C"), (3, "C>>O")]
    (tmp_path / "r.csv").write_text("smiles,sec\na,1\na,2\nb,3\n")
    assert rows(files.read_results(spark, str(tmp_path / "r.csv"), "smiles string, sec int")) == [("a", 2), ("b", 3)]
    with pytest.raises(FileNotFoundError, match="x1, .*x2|x1.*x2"):
        files.find([str(tmp_path / "x1"), str(tmp_path / "x2")])


def test_streaming(spark, tmp_path):
    from routeloom.streaming import scoring as st

    (tmp_path / "in").mkdir()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for text in ("a\nb\n", "b\nc\n"):
        (tmp_path / "in" / f"{text[0]}.txt").write_text(text)
        stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "target")
        st.score_stream(stream, lambda d: d.withColumn("score", F.length("target")), out, mark).awaitTermination()
    assert sorted(r.target for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_normal_tail_and_empty_conditions(spark):
    import math

    from pyspark.sql import functions as F

    from routeloom.functions.text import conditions_empty
    from routeloom.operators.stats import normal_tail

    for r in spark.createDataFrame([(z / 4,) for z in range(-20, 21)], "z double").select("z", normal_tail(F.col("z")).alias("p")).collect():
        assert abs(r.p - math.erfc(r.z / math.sqrt(2)) / 2) < 2e-7
    rows = [(1, None), (2, (None, None, None, None)), (3, (None, None, None, {})), (4, ("water", None, None, None)), (5, (None, 0.0, None, None)), (6, (None, None, None, {"ph": "7"}))]
    d = spark.createDataFrame(rows, "k int, c struct<solvent:string,temperature_c:double,reagent:string,extra:map<string,string>>")
    assert {r.k for r in d.where(conditions_empty(F.col("c"))).collect()} == {1, 2, 3}


def test_fixpoints_have_no_cap(spark):
    """A chain of 70 rules is solved, closed and walked to its end."""
    from pyspark.sql import functions as F

    from routeloom.operators import graph, routes

    rules = spark.range(70).select(F.col("id").alias("rule_id"), (F.col("id") + 1).alias("product"), F.lit(0.9).alias("score"), F.array("id").alias("reactants"))
    stock, top = spark.createDataFrame([(0,)], "k long"), spark.createDataFrame([(0,)], "k long")
    done = graph.solved(rules, stock)
    assert done.count() == 71
    assert graph.closure(rules, top).count() == 70
    best = routes.cheapest_rules(rules, done, stock)
    assert routes.walk(best, rules, spark.createDataFrame([(70,)], "target long")).count() == 70
