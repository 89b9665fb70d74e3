import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.llm import cnn, sample, toxicity

CLEAN = "The thing of the ending was here and there, with other things.\nAnd that is all of it. "
JUNK = "Buy%%% now$$$ best### price&&& here*** "


def corpus(n=240):
    rng = np.random.default_rng(1)
    words = ["thing", "other", "ending", "here", "there", "with", "that"]
    text, quality, toxic = [], [], []
    for i in range(n):
        plain = " ".join(rng.choice(words, 60))
        quality.append(int(i % 3 != 0))
        toxic.append(int(i % 4 == 0))
        text.append((plain if quality[-1] else " ".join(w + "%%%" for w in plain.split())) + (" you idiot moron" if toxic[-1] else ""))
    return text, np.array(quality), np.array(toxic)


def test_cnn_learns_and_pools_whole_texts():
    text, quality, _ = corpus()
    raw = [t.encode() for t in text]
    model = cnn.Network().fit(raw[:180], quality[:180], epochs=12)
    assert ((model.score(raw[180:]) >= 0.5) == quality[180:]).mean() > 0.95
    # blocks and pieces do not change a score
    alone = np.concatenate([model.score([r]) for r in raw[:5]])
    assert np.allclose(alone, model.score(raw[:5]), atol=1e-5)
    long = b" ".join(raw[180:] * 20)
    old, cnn.BLOCK = cnn.BLOCK, 1000
    try:
        assert np.allclose(model.score([long, b""]), [model.score([long])[0], model.score([b""])[0]], atol=1e-5)
    finally:
        cnn.BLOCK = old


def test_cnn_gradient_is_right():
    net = cnn.Network(seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    padded, y = [cnn._pad(t.encode()) for t in (CLEAN * 9, JUNK * 5)], np.array([1.0, 0.0])
    grads = net._gradients(padded, y)

    def loss():
        x = np.frombuffer(b"".join(padded), np.uint8)
        steps = np.maximum(cnn._activations(net.p["w"], x).reshape(-1, cnn.STEP, cnn.FILTERS).max(axis=1) + net.p["b"], 0)
        first = np.array([0, len(padded[0]) // cnn.STEP])
        p = net._head(cnn._pool(cnn._chunks(steps, first), first))[1]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, at in (("o", 2), ("c", 1), ("h", (20, 1)), ("b", 3), ("w", (2, 101, 4))):
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-5
        up = loss()
        net.p[k][at] = keep - 1e-5
        down = loss()
        net.p[k][at] = keep
        assert grads[k][at] == pytest.approx((up - down) / 2e-5, rel=2e-2, abs=1e-6)


def test_toxicity_learns():
    text, _, toxic = corpus()
    model = toxicity.Linear().fit(text[:180], toxic[:180])
    assert ((model.score(text[180:]) >= 0.7) == toxic[180:]).mean() > 0.95
    assert np.allclose(model.score(text[:3]), [model.score([t])[0] for t in text[:3]])


def plain_toxicity(model, text):
    """The score of one text, n-gram by n-gram."""
    clean, mask, mult = " " + " ".join(text.lower().split()) + " ", (1 << 64) - 1, 0x9E3779B97F4A7C15
    found = set()
    for n in toxicity.SIZES:
        for i in range(len(clean) - n + 1):
            h = 0
            for k, c in enumerate(clean[i : i + n], 1):
                h = (h * mult + ord(c) + k) & mask
            found.add(((h ^ (h >> 29)) * mult & mask) >> (64 - toxicity.BITS))
    z = sum(float(model.weight[f]) for f in found) / math.sqrt(max(len(clean), toxicity.SHORT)) / model.unit + model.bias
    return 1 / (1 + math.exp(-z))


def plain_quality(model, raw):
    """The score of one text, byte by byte."""
    p, step, width = model.p, cnn.STEP, cnn.WIDTH
    x = b"\0" * (width - 1) + raw
    x += b"\0" * (-len(x) % step)
    acts = []
    for i in range(0, len(x), step):
        best = [-math.inf] * cnn.FILTERS
        for j in range(i, i + step):
            for f in range(cnn.FILTERS):
                best[f] = max(best[f], sum(float(p["w"][k][x[j + k] if j + k < len(x) else 0][f]) for k in range(width)))
        acts.append([max(0.0, b + float(p["b"][f])) for f, b in enumerate(best)])
    chunks = [[max(a, b) for a, b in zip(one, two)] for one, two in zip(acts, acts[1:] + acts[-1:])]
    columns = list(zip(*chunks))
    z = [sum(c) / len(c) for c in columns] + [max(c) for c in columns] + [min(c) for c in columns]
    hidden = [max(0.0, sum(a * float(p["h"][i][k]) for i, a in enumerate(z)) + float(p["c"][k])) for k in range(cnn.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(h * float(o) for h, o in zip(hidden, p["o"])) + float(p["d"][0]))))


def test_scores_equal_plain_loops(spark):
    text, quality, toxic = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(text)] + [(300, ""), (301, "a"), (302, CLEAN * 30), (303, "Ünï " * 99)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(q), int(t)) for i, (q, t) in enumerate(zip(quality, toxic)) if i < 180], "doc_id long, quality int, toxic int")
    some = [*range(0, 240, 30), 300, 301, 302, 303]
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = cnn.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in cnn.score(docs, model).collect()}
    assert all(got[i] == pytest.approx(plain_quality(model, texts[i].encode()), abs=1e-4) for i in some)
    model = toxicity.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == pytest.approx(plain_toxicity(model, texts[i]), abs=1e-5) for i in some)
    # learning on the executors equals learning in one place
    again = toxicity.Linear().fit(text[:180], toxic[:180])
    assert np.allclose(again.weight, model.weight, atol=1e-6) and again.bias == pytest.approx(model.bias)


def test_learning_reads_whole_texts(spark):
    """What tells the labels apart stands at the end of long texts only."""
    rng, rows, labels = np.random.default_rng(2), [], []
    words = ["thing", "other", "ending", "here", "there", "with", "that"]
    for i in range(60):
        rows.append((i, " ".join(rng.choice(words, 6000)) + (" zzqx%%% zzqx%%%" * 20 if i % 2 else "")))
        labels.append((i, 1 - i % 2, i % 2))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for module, sign in ((cnn, -1), (toxicity, 1)):
        s = np.array([r.score for r in sorted(module.score(docs, module.fit(docs, known, F.col("doc_id") < 40)).collect())])[40:]
        odd = np.arange(40, 60) % 2 == 1
        assert ((s >= 0.5) == (odd if sign > 0 else ~odd)).all()


def test_grams_are_of_one_text_only(monkeypatch):
    owner, found = toxicity.grams([(0, " abc "), (1, "  "), (2, " abc ")])
    assert sorted(found[owner == 0]) == sorted(found[owner == 2])
    long = " ".join(f"w{i % 97}" for i in range(400))
    whole = toxicity.features(long)
    monkeypatch.setattr(toxicity, "BLOCK", 50)
    cut = toxicity.features(long)
    assert np.array_equal(whole[0], cut[0]) and whole[1] == cut[1]


@pytest.mark.parametrize("module", [cnn, toxicity])
def test_edges(spark, module):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, "", "a", CLEAN * 3000, JUNK, JUNK])] + [(None, "z", "x"), (4, JUNK, "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in module.score(docs, module.fit(docs, none, F.lit(True))).collect()} == {0.5}
    some = spark.createDataFrame([(2, None, 0), (3, 1, 0), (4, 0, 1), (4, 0, 1), (None, 1, 1), (5, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    out = module.score(docs, module.fit(docs, some, F.lit(True))).collect()
    assert len(out) == 8 and all(0 <= r.score <= 1 for r in out)
    assert module.score(docs.limit(0), cnn.Network()).count() == 0


def test_bucket_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", sample.bucket(F.col("id"), 5).alias("b")).collect()
    assert all(r.b == zlib.crc32(str(r.id).encode()) % 5 for r in got)
