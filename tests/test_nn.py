import numpy as np
import pytest

from routeloom.functions import nn, udf

SMILES = ["CC(=O)Nc1ccccc1", "CCO", "C", "CC(=O)O.CN"]
AMIDE = "[C:1](=[O:2])-[NH:3]-[C,c:4]>>[C:1](=[O:2])-[OH].[NH2:3]-[C,c:4]"
FORWARD = "[C:1](=[O:2])-[N:3]>>[C:1](=[O:2])-[OH].[N:3]"


def test_widths():
    for plain, a, b in ((False, nn.ATOM_WIDTH, nn.BOND_WIDTH), (True, nn.PLAIN_ATOM_WIDTH, nn.PLAIN_BOND_WIDTH)):
        for s in SMILES:
            x, edge, feat = nn.tensors(s, plain)
            assert x.shape[1] == a and feat.shape == (edge.shape[1], b)
            assert np.array_equal(edge[:, ::2], edge[::-1, 1::2])
    assert nn.tensors("bad!!") is None
    with pytest.raises(ValueError):
        nn.check_width(nn.random_weights(3, plain=True))


def loops(w, x, edge, feat, depth):
    """Message passing, one bond at a time."""
    n = edge.shape[1]
    first = [w["in"] @ np.concatenate([x[edge[0, e]], feat[e]]) for e in range(n)]
    h = [np.maximum(f, 0) for f in first]
    for _ in range(depth - 1):
        h = [np.maximum(first[e] + w["h"] @ (sum((h[k] for k in range(n) if edge[1, k] == edge[0, e]), np.zeros(len(h[0]))) - h[e ^ 1]), 0) for e in range(n)]
    out = [np.maximum(w["out"] @ np.concatenate([x[i], sum((h[k] for k in range(n) if edge[1, k] == i), np.zeros(w["in"].shape[0]))]) + w["out_b"], 0) for i in range(len(x))]
    return np.sum(out, axis=0)


@pytest.mark.parametrize("plain", [False, True])
def test_message_passing_equals_loops(plain):
    w = nn.random_weights(5, 8, plain, seed=3)
    graphs = [nn.tensors(s, plain) for s in SMILES]
    got, _ = nn.encode(w, *nn.batch(graphs), len(graphs), 3)
    for g, v in zip(graphs, got):
        assert np.allclose(loops(w, *g, 3), v)


def test_models(spark):
    w = nn.random_weights(4, 8, seed=1)
    model = nn.TemplateModel(w, {0: AMIDE, 1: "garbage", 2: AMIDE, 3: FORWARD}, 4)
    bad, amide, none = model.predict([None, "CC(=O)Nc1ccccc1.Cl", "C"], 5)
    assert bad == [] and none == [] and len(amide) >= 1
    assert amide == sorted(amide, key=lambda p: -p["score"])
    forward = model.predict_forward(["CC(=O)O.CN", "bad!!"], 3)
    assert forward[0][0]["n_templates"] >= 1 and forward[1] == []
    p = nn.Plausibility(nn.random_weights(1, 8, True, seed=2), 2)
    s = p.score([("CC(=O)O.CN", "CNC(C)=O"), ("bad!!", "C"), ("C", None), ("C", "CCO")])
    assert s[1] == s[2] == 0 and 0 < s[0] < 1 and np.isclose(s[3], p.score([("C", "CCO")])[0])
    df = spark.createDataFrame([("CC(=O)Nc1ccccc1",), ("CCO",), (None,)], "smiles string")
    got = {r.smiles: r.predictions for r in udf.expand(df, w, model.templates).collect()}
    assert [x.template_id for x in got["CC(=O)Nc1ccccc1"]] == [x["template_id"] for x in model.predict(["CC(=O)Nc1ccccc1"])[0]]
    assert got["CCO"] == [] and got[None] == []
