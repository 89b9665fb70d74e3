import random

import numpy as np
import pytest
from test_bpe import library
from test_jaccard import brute as near_brute
from test_line_dedup import near

from routeloom.llm import bpe, cnn


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(6)
    words = ["thing", "other", "ending", "here", "there", "with", "that", "more", "of", "and"]
    line = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "s", "ed", "ing"]) for _ in range(n))
    items = [(k, line(20)) for k in range(3)]
    shared, rows, labels = [line(8) for _ in range(3)], [], []
    for i in range(70):
        body = [line(rnd.randrange(8, 16)) for _ in range(rnd.randrange(2, 6))]
        if rnd.random() < 0.4:
            body.insert(0, rnd.choice(shared) + rnd.choice(["", "s", "."]))
        if i % 9 == 0:
            body.append("so " + items[i % 3][1].upper() + " end")
        if i % 7 == 3 and rows:
            body = rows[rnd.randrange(len(rows))][1].split("\n")
            body[0] = " ".join([*body[0].split()[:-1], "changedword", "anotherword"])
        if i % 7 == 5:  # the words of another document in other lines
            body = [rows[i // 2][1].replace("\n", " ")]
        bad = i % 5 == 2
        text = "\n".join(body)
        rows.append((i * 2, " ".join(w + "%%%" for w in text.split()) if bad else text, "en", "src", len(text)))
        labels.append((i * 2, int(not bad), 0))
    rows += [(200, None, "en", "s", 0), (201, "", None, "s", 0)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, items


def line_brute(rows):
    first, out = {}, []
    for i, t in sorted(rows):
        for p, x in enumerate((t or "").split("\n")):
            if x.split():
                first.setdefault(x, (i, p))
    for i, t in rows:
        kept = [x for p, x in enumerate((t or "").split("\n")) if not x.split() or (first[x] == (i, p) and not any(near(x, y) and f < (i, p) for y, f in first.items()))]
        if any(x.split() for x in kept) or not (t or "").split():
            out.append((i, t if t is None else "\n".join(kept)))
    return out


def leaks(text, item):
    w, b = (text or "").lower().split(), item.lower().split()
    n, best = len(b), 0
    s = lambda x: sorted(tuple(x[k : k + 5]) for k in range(len(x) - 4))
    for a in range(max(1, len(w) - n + 1)):
        x, y = s(w[a : a + n]), s(b)
        both = sum(min(x.count(k), y.count(k)) for k in set(x))
        best = max(best, both / max(1, len(x) + len(y) - both))
    return best >= 0.8


def test_stages_equal_brute_force(spark, tables):
    import corpus_pipeline as c

    d, rows, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = cnn.fit(docs, spark.read.parquet(f"{d}/labels.parquet"), c.bucket(c.F.col("doc_id"), 5) != 0)
    score = model.score([(t or "").encode() for _, t, *_ in rows])
    want = [(r[0], r[1]) for r, s in zip(rows, score) if s >= cnn.THRESHOLD]
    assert 40 < len(want) < len(rows), (len(want), sorted(score))
    want = line_brute(want)
    first = {i for i, _, component, _ in near_brute(want) if i == component}
    assert len(first) < len(want)
    want = [(i, t) for i, t in want if str(i) in first]
    left = [(i, t) for i, t in want if not any(leaks(t, b) for _, b in items)]
    assert len(left) < len(want)
    tok = bpe.load()
    got = {r.doc_id: r.n_tokens for r in c.run(spark, d).collect()}
    assert got == {i: len(np.frombuffer(library(tok, t)[0], "<u4")) for i, t in left}


def test_empty(spark, tables):
    import corpus_pipeline as c

    d, *_ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in c.STAGES:
        out = stage(spark, docs.limit(0), d)
        assert out.count() == 0
        if name != c.STAGES[-1][0]:
            assert out.columns == docs.columns
