import pytest
from pyspark.sql import functions as F

from routeloom.operators import evolution as e

A, B, X, Z, Y = "CCO", "CCN", "CCCO", "CCCN", "CCCCO"
KNOWN = [(A, B, X, 0.3), (A, B, Z, 0.9), (A, Z, X, 0.9), (A, X, Y, 0.5)]


def grow(spark, known=KNOWN, seeds=(A, B), **kw):
    table = spark.createDataFrame([(min(a, b), max(a, b), p, s) for a, b, p, s in known], "a string, b string, product string, step double")
    pool, edges, stats = e.evolve(spark.createDataFrame([(m,) for m in seeds], "m string"), lambda pairs: table.join(pairs, ["a", "b"], "left_semi"), e.Settings(**kw))
    return {r.m: r for r in pool.collect()}, edges, stats, pool


def test_scores_and_depths(spark):
    got, edges, stats, pool = grow(spark, max_depth=4, threshold=0.0)
    assert {m: (round(r.total, 6), r.depth) for m, r in got.items()} == {A: (1, 0), B: (1, 0), Z: (0.9, 1), X: (0.81, 2), Y: (0.405, 3)}
    assert {got[X].parent_a, got[X].parent_b} == {A, Z} and stats["terminated_by"] == "exhausted"
    route = {r.m for r in e.best_route(pool, pool.where(F.col("m") == Y).select("m")).collect()}
    assert route == {Y, X, Z}
    assert e.incoming(edges, spark.createDataFrame([(X,)], "m string")).count() == 2


def test_knobs(spark):
    assert Y not in grow(spark, max_depth=4, threshold=0.85)[0]
    assert X in grow(spark, max_depth=1, threshold=0.0)[0] and Y not in grow(spark, max_depth=1, threshold=0.0)[0]
    _, _, stats, _ = grow(spark, max_reactions=1)
    assert stats["reactions"] == 1 and stats["terminated_by"] == "max_reactions"
    loop = [(A, A, X, 0.5)]
    assert X in grow(spark, loop, (A,))[0] and X not in grow(spark, loop, (A,), self_pairs=False)[0]
    assert grow(spark, max_depth=4, threshold=0.0, frontier_width=1, seeds=(A,))[2]["rounds"] == 1
    with pytest.raises(ValueError):
        e.Settings(max_depth=0)
    with pytest.raises(ValueError):
        e.Settings(threshold=2)
    with pytest.raises(ValueError):
        grow(spark, seeds=(None,))


def test_deep_pool_equals_a_plain_loop(spark):
    from routeloom.plans import networks

    total, depth, reacted, edges, changed = {m: 1.0 for m in range(25)}, {m: 0 for m in range(25)}, set(), [], set(range(25))
    while True:
        able = [m for m in total if total[m] >= 0.9 and depth[m] < 3]
        pairs = {(min(a, b), max(a, b)) for a in able if a in changed for b in able} - reacted
        if not pairs:
            break
        reacted |= pairs
        edges += [(a, b, p, s) for a, b in pairs for p, s in [(25 + (a * 7 + b * 3) % 50, ((a + b) % 50 + 50) / 100)] if p not in (a, b)]
        before = dict(total)
        while True:
            best = {}
            for a, b, p, s in edges:
                if p >= 25 and a in total and b in total:
                    k = (-round(min(total[a], total[b]) * s, 12), max(depth[a], depth[b]) + 1, a, b, s)
                    best[p] = min(best.get(p, k), k)
            new_t, new_d = {m: 1.0 for m in range(25)} | {p: -k[0] for p, k in best.items()}, {m: 0 for m in range(25)} | {p: k[1] for p, k in best.items()}
            done = new_t == total and new_d == depth
            total, depth = new_t, new_d
            if done:
                break
        changed = {m for m in total if m not in before or total[m] > before[m]}
    got = {r.m: (r.total, r.depth) for r in networks.evolve_deep(spark, "/root/testdata/sf0.001").collect()}
    assert got == {m: (pytest.approx(round(total[m], 6)), depth[m]) for m in total}
