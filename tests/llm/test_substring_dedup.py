import decimal
import hashlib
import random

import numpy as np
import pytest

from routeloom.llm import substring_dedup as s


def brute(rows, window):
    """rows: (doc_id, text), each id once."""
    seen, out = {}, {}
    docs = sorted((i, (t or "").encode().split()) for i, t in rows)
    for i, w in docs:
        for p in range(len(w) - window + 1):
            seen.setdefault(tuple(w[p : p + window]), (i, p))
    for i, w in docs:
        gone = {q for p in range(len(w) - window + 1) if seen[tuple(w[p : p + window])] != (i, p) for q in range(p, p + window)}
        kept = [x for q, x in enumerate(w) if q not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_against_brute_force(spark):
    rnd = random.Random(3)
    passage = [rnd.choice("abcdefgh") + str(rnd.randrange(9)) for _ in range(30)]
    rows = []
    for i in range(60):
        w = [rnd.choice("xyzuvw") + str(rnd.randrange(40)) for _ in range(rnd.randrange(0, 60))]
        if i % 3 == 0:
            a = rnd.randrange(len(w) + 1)
            w[a:a] = passage[rnd.randrange(5) : rnd.randrange(20, 30)] * rnd.randrange(1, 3)
        rows.append((i * 3, " ".join(w).replace(" ", rnd.choice([" ", "\n", "\t  "]))))
    rows += [(500, "la " * 200), (501, None), (502, ""), (503, rows[0][1]), (504, "one"), (505, " ".join(passage) + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window, gram in ((20, 8), (6, 3), (5, 5)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in s.dedup(df, window, gram).collect()}
        assert got == brute(rows, window)


def test_edges(spark):
    text, other = " ".join(str(i) for i in range(25)), " ".join(f"o{i}" for i in range(30))
    df = spark.createDataFrame([(None, text, "q"), (7, text, "q"), (7, text, "q"), (3, text, None), (None, other, "q"), (7, "short", "q")], "doc_id long, text string, marks string")
    out = sorted((str(r.doc_id), r.n_removed, r.kept) for r in s.dedup(df, texts=True).collect())
    assert out == [("3", 0, text), ("7", 0, "short"), ("7", 25, ""), ("7", 25, ""), ("None", 0, other), ("None", 25, "")]
    assert s.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize(("kind", "first", "second"), [("string", "10", "9"), ("smallint", 9, 10), ("decimal(20,0)", decimal.Decimal(9), decimal.Decimal(10)), ("long", 9, (1 << 63) - 1)])
def test_any_id(spark, kind, first, second):
    text = " ".join(str(i) for i in range(25))
    out = {r.doc_id: r.n_removed for r in s.dedup(spark.createDataFrame([(second, text), (first, text)], f"doc_id {kind}, text string")).collect()}
    assert out == {first: 0, second: 25}


def test_very_long_and_hot(spark):
    rnd = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"{rnd.random()}" for _ in range(15)) + " " + passage) for i in range(300)]
    rows += [(1000, " ".join(str(rnd.randrange(5)) for _ in range(150_000))), (1001, "w" * 300_000), (1002, "la la " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in s.dedup(df).collect()} == brute(rows, 20)


def test_intervals():
    assert s.intervals(np.array([], int), 5) == []
    assert s.intervals(np.array([0, 3, 8, 14]), 5) == [(0, 13), (14, 19)]
