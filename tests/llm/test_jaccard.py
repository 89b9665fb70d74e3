import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.llm import jaccard as j


def test_occurring_equals_counting(monkeypatch):
    rnd = random.Random(2)
    for k in range(300):
        monkeypatch.setattr(j, "HEAP", rnd.choice([0, 5, 2000]))
        monkeypatch.setattr(j, "MU", rnd.choice([0.001, 0.3]))
        sets = [np.array(sorted(rnd.sample(range(30), rnd.randrange(0, 20))), np.uint64) for _ in range(rnd.randrange(0, 12))]
        index = j.Index(sets, np.array([len(s) for s in sets], np.int64))
        own = np.array(sorted(rnd.sample(range(30), rnd.randrange(1, 20))), np.uint64)
        for t in (1, 2, len(own) // 2 + 1, len(own)):
            want = [(i, c) for i, s in enumerate(sets) if (c := len(set(s.tolist()) & set(own.tolist()))) >= t]
            assert list(zip(*(x.tolist() for x in index.occurring(own, t)))) == want


def shingles(text):
    w = (text or "").encode()
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in w).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(id, set size, smallest id reachable, links to other sets) of each row, sorted as text."""
    s = [shingles(t) for _, t in rows]
    alike = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    near, out = [[k for k, b in enumerate(s) if alike(a, b)] for a in s], []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [k for k in near[todo.pop()] if k not in seen]
            seen.update(new)
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((str(doc), len(s[i]), str(min(ids) if ids else None), len({frozenset(s[k]) for k in near[i] if s[k] != s[i]})))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in j.join(df).collect())


def corpus(seed):
    rnd = random.Random(seed)
    rows, base = [], [[f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(1, 90))] for _ in range(12)]
    common = "this line is on every page of the site".split()
    for i in range(90):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(30)}"
        if rnd.random() < 0.5:
            w = common + w
        rows.append((1000 - i * 7, " ".join(w).upper() if rnd.random() < 0.2 else "  ".join(w)))
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A b"), (6, "a b c")]


@pytest.mark.parametrize(("seed", "load"), [(1, None), (2, 40), (3, 300)])
def test_against_brute_force(spark, monkeypatch, seed, load):
    if load:  # cells of several parts, and queries in several chunks
        monkeypatch.setattr(j, "LOAD", load)
        monkeypatch.setattr(j, "QUERY_LOAD", 2 * load)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)
    assert found(df.repartition(5)) == brute(rows)


def test_the_search_merges_and_bisects(spark, monkeypatch):
    """On the rows that Spark deals to a part, lists are merged with a heap and long ones bisected."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rnd.randrange(80)] = f"x{i % 7}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = j.stage(lambda: j.text_blocks(df))
    members = j.stage(lambda: j._members(blocks))
    classes = j.stage(lambda: members.groupBy("c", "c2", "n").agg(F.min("row").alias("r"), F.min("doc_id").alias("doc_id")))
    sets = j._survivors(blocks, classes, j._shared(blocks, classes, 8), 80, 8).selectExpr("r", "n", "s", "1 AS indexed", "1 AS asks").toArrow()
    links, degree, work = j._search(sets, 80)
    assert work[0] > 100 and work[2] > 1000 and len(links) == classes.count() - 1
    assert found(df) == brute(rows)


def test_edges(spark):
    text = " ".join(f"t{i}" for i in range(40))
    near = text.replace("t0 ", "q0 ")
    rows = [(None, text), (9, text), (9, text), (None, "alone here"), (None, None), (9, "one two three four five six"), (5, near), (None, "alone HERE"), (None, " ".join(f"n{i}" for i in range(30)))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component string, row int")
    assert found(df) == brute(rows)
    kept = [(r.doc_id, r.text) for r in j.first_of_each(df).collect()]
    # of the two copies with a null id one stays, that with the smaller hash of its text
    assert {(i, t.lower() if t else t) for i, t in kept} == {(5, near), (9, rows[5][1]), (None, None), (None, "alone here"), (None, rows[8][1])} and len(kept) == 5
    assert j.first_of_each(df).columns == df.columns
    assert found(df.limit(0)) == []
    assert j.required(10) == 8 and j.overlap(10, 10) == 9


@pytest.mark.parametrize(("kind", "rows"), [("string", [("10", "a b c d e f"), ("9", "a b c d e F"), ("é", "z")]), ("smallint", [(2, "a b"), (1, "A b")])])
def test_any_id(spark, kind, rows):
    assert found(spark.createDataFrame(rows, f"doc_id {kind}, text string")) == brute(rows)


def test_very_long_and_hot(spark):
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:30] + [f"v{i}"] + base[31:])) for i in range(150)] + [(i, " ".join(base)) for i in range(200, 260)]
    long = [str(rnd.randrange(9)) for _ in range(30_000)]
    rows += [(1000, " ".join(long)), (1001, " ".join(long[:-2])), (1002, "w" * 300_000), (1003, "a " * 40_000)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == brute(rows)


def test_what_is_read_twice_is_worked_out_once(spark):
    """Plans that are left once the links are known have few joins: their broadcasts are held by the driver."""
    df = spark.createDataFrame(corpus(1), "doc_id long, text string")
    for make, most in ((j.join, 2), (j.first_of_each, 2)):
        plan = make(df)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") <= most, plan


def test_workers_give_back_what_they_freed():
    """In a process of its own: after a table's work is done, the memory of its lists isn't held any more."""
    code = """
import numpy, pyarrow, re
from routeloom.llm.common import give_back, giving_back
held = lambda: int(re.search(r"Rss:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
def work(n):
    some = [bytes(1000) for _ in range(n)]
    keep.append(some[-1])  # at the end of the heap, so that it doesn't shrink by itself
    return n
keep = []
work(10), give_back()
before = held()
work(200_000)
without = held() - before
giving_back(work)(200_000)
print(without, held() - before)
"""
    without, after = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(j.__file__).parents[2]).stdout.split())
    assert without > 100 and after < 30, (without, after)
