import math
import random
from collections import Counter

import pytest

from routeloom.llm import lm


def grams(words, n):
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, order=lm.ORDER):
    docs = [(t or "").encode().split() for _, t in rows]
    every = {n: sum((grams(d, n) for d in docs), Counter()) for n in range(1, order + 1)}
    total, out = sum(map(len, docs)), []
    for (i, _), d in zip(rows, docs):
        own = {n: grams(d, n) for n in range(1, order + 1)}
        rest = lambda g: every[len(g)][g] - own[len(g)][g]  # noqa: B023, E731
        others, s = max(total - len(d), 1), 0.0
        for e in range(len(d)):
            n = possible = min(e + 1, order)
            while n and not rest(tuple(d[e - n + 1 : e + 1])):
                n -= 1
            seen = rest(tuple(d[e - n + 1 : e + 1])) / (rest(tuple(d[e - n + 1 : e])) if n > 1 else others) if n else 1 / others
            s += math.log(seen * lm.BACKOFF ** (possible - n))
        out.append((str(i), len(d), s))
    return sorted(out)


def check(got, want):
    assert len(got) == len(want)
    for (i, n, s, m), (j, k, t) in zip(sorted(got), want):
        assert (i, n) == (j, k) and s == pytest.approx(t, rel=1e-9, abs=1e-5) and (m is None if n == 0 else m == pytest.approx(t / n, abs=1e-5))


def scored(df, *args, **more):
    return [(str(r.doc_id), r.n_words, r.log_score, r.mean_score) for r in lm.score(df, *args, **more).collect()]


@pytest.mark.parametrize(("head", "order"), [(lm.HEAD, 3), (5, 3), (0, 3), (lm.HEAD, 2), (5, 1), (lm.HEAD, 5)])
def test_against_brute_force(spark, head, order):
    rnd = random.Random(head)
    rows = [(i, " ".join(rnd.choice("abcdefgh") + "x" * int(rnd.expovariate(1)) for _ in range(rnd.randrange(0, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "a b a b zz"), (7, "same text here"), (7, "same text here"), (7, "other text"), (102, rows[3][1])]
    check(scored(spark.createDataFrame(rows, "doc_id long, text string"), head, order=order), brute(rows, order))


def test_other_ids_and_columns(spark):
    rows = [("x", "a b c a b c"), (None, "a b c"), ("é", "b c d")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id string, text string, block int, words string")
    check(scored(df), brute(rows))
    assert lm.score(df.limit(0)).count() == 0


def test_very_long_and_repeated(spark):
    rows = [(0, "a " * 70_001 + "b"), (1, "a a b c"), (2, "x y " * 140_000), (3, "y x y c"), (4, "word" * 50_000)]
    check(scored(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)), brute(rows))
