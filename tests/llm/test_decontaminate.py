import random

from pyspark.sql import functions as F

from routeloom.llm import decontaminate as d


def shingles(w):
    k = min(len(w), 5)
    return sorted(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else []


def brute(docs, items):
    """The best window of every pair, over all places."""
    out = {}
    for i, t in docs:
        w = (t or "").lower().split()
        for j, b in items:
            v = (b or "").lower().split()
            for a in range(max(1, len(w) - len(v) + 1)):
                x, y = shingles(w[a : a + len(v)]), shingles(v)
                m = sum(min(x.count(s), y.count(s)) for s in set(x))
                u = len(x) + len(y) - m
                if m and 100 * m >= 80 * u and (i, j) not in out or m and u and (i, j) in out and m / u > out[i, j][0]:
                    out[i, j] = (m / u, a)
    return out


def test_against_brute_force(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(30))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([30, 12, 40, 3, 5, 30])] + [(10, ""), (11, None)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rnd.randrange(0, 80))]
        if i % 2:
            v = rnd.choice(items[:6])[1].split()
            for _ in range(rnd.randrange(3)):
                v[rnd.choice([0, len(v) - 1])] = "zz"
            w[rnd.randrange(len(w) + 1) : 0] = [x.upper() for x in v]
        docs.append((i, " \n".join(w)))
    docs += [(90, None), (91, ""), (92, items[0][1]), (93, " ".join(items[2][1].split()[:36]))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_common / r.n_all for r in d.matches(df, bench).collect()}
    assert got == {k: x for k, (x, _) in brute(docs, items).items()} and len(got) > 20
    old, d.BROADCAST_SHINGLES = d.BROADCAST_SHINGLES, 3
    try:
        assert {(r.doc_id, r.item_id): r.n_common / r.n_all for r in d.matches(df, bench).collect()} == got
    finally:
        d.BROADCAST_SHINGLES = old
    assert {r.doc_id for r in d.clean(df, bench).collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, text, 1), (3, text, 2), (3, text, 2), (4, "clean", 3)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, text, "x"), (None, text, "x")], "item_id long, text string, doc_id string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in d.matches(docs, bench).collect())
    assert got == [("3", "7"), ("3", "None"), ("None", "7"), ("None", "None")]
    assert [r.doc_id for r in d.clean(docs, bench).collect()] == [4] and d.clean(docs, bench).columns == docs.columns
    assert d.matches(docs.limit(0), bench).count() == 0 and d.matches(docs, bench.limit(0)).count() == 0


def test_words_put_into_a_passage(spark):
    """The best window lies between the places that shared shingles give."""
    docs, items = [], []
    for k, (n, cut, put) in enumerate([(80, 2, 4), (90, 2, 4), (92, 2, 4), (110, 3, 6), (30, 0, 1)]):
        v = [f"i{k}w{j}" for j in range(n)]
        x = [f"a{j}" for j in range(cut)] + v[cut : n // 2] + [f"b{j}" for j in range(put)] + v[n // 2 : n - cut] + [f"c{j}" for j in range(cut)]
        items.append((k, " ".join(v)))
        docs.append((k, " ".join([f"x{j}" for j in range(50)] + x + [f"y{j}" for j in range(50)])))
    got = d.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): r.n_common / r.n_all for r in got} == {k: x for k, (x, _) in want.items()}
    assert {(k, k) for k in range(4)} <= set(want)


def test_clean_keeps_other_texts_of_an_id(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, text, 1), (None, "clean one", 2), (None, None, 3), (None, "clean two", 4), (3, text, 5), (3, "clean three", 6), (4, text, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = d.clean(docs, spark.createDataFrame([(7, text)], "item_id long, text string"))
    assert sorted(r.row for r in kept.collect()) == [2, 3, 4, 6] and kept.columns == docs.columns


def test_fingerprints_keep_nine_tenths(spark):
    """Of random edits of items that stay at a similarity of 0.8 or more, those within the radius: at least 0.9, measured against all."""
    rnd = random.Random(11)
    items = [(i, " ".join(f"w{rnd.randrange(900)}" for _ in range(rnd.choice([30, 60, 120])))) for i in range(12)]
    rows = []
    for i, text in items:
        for _ in range(8):
            w = text.split()
            for _ in range(rnd.randrange(1, 2 + len(w) // 40)):
                w[rnd.randrange(len(w))] = "changed"
            if rnd.random() < 0.5:  # parts exchanged
                k = rnd.randrange(len(w))
                w = w[k:] + w[:k]
            rows.append((len(rows), " ".join(["before"] * 7 + w + ["after"] * 9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found, every = (d.matches(docs, bench, radius=r).select("doc_id", "item_id").distinct().count() for r in (d.RADIUS, 63))
    assert every >= 60 and found >= 0.9 * every


def test_texts_are_split_once(spark, monkeypatch):
    """Each pass over the documents splits a text once, the second only the texts of places found, and items are worked out once."""
    plans, real = [], d.stage

    def recorded(make):
        df = make()
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(lambda: df)

    monkeypatch.setattr(d, "stage", recorded)
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"x {text} y"), (2, "clean")], "doc_id long, text string")
    out = d.matches(docs, spark.createDataFrame([(7, text)], "item_id long, text string"))
    assert [tuple(r) for r in out.collect()] == [(1, 7, 1, 20, 16, 16)]
    found, marked = plans[-2:]
    assert found.count("split(") == 1 and marked.count("split(") == 1
    assert marked.index("split(") < marked.index("Join")  # the words are those of joined rows
    last = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in last and "aggregate(transform(" not in last


def test_lower_case_of_odd_texts(spark):
    """The faster way to lower case gives what the plain one does."""
    texts = [None, "", "ABC xyz [@`{]", "ÉA İI ΣA AΣ KK", "Z\x00\x7f\t\x0bQ", "\U0001f600 A", "É", "Á"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", d._lower(F.col("text")).alias("x"), d.lower_ascii(F.col("text")).alias("y"))
    assert [r.x for r in df.collect()] == [r.y for r in df.collect()] == [t and "".join(c.lower() if c < "\x80" else c for c in t) for t in texts]
