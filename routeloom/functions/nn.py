"""Neural inference in numpy: molecular graphs, directed message passing, template heads, plausibility.

Weights are plain arrays, so that a model is a small dict that travels with the
task. Stereo, conjugation beyond single bonds between unsaturated atoms, and
partial charges are not derived here; their places hold the defaults (charge 0,
flag 0).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import chem

# What the features are one-hot over, and Pauling's electronegativities.
NUMBERS = [6, 7, 8, 9, 15, 16, 17, 35, 53]
DEGREES, CHARGES, HYDROGENS = list(range(6)), [-2, -1, 0, 1, 2], list(range(5))
CHIRALITIES, STEREOS, HYBRIDS = 4, 6, ["sp", "sp2", "sp3", "sp3d", "sp3d2"]
ORDERS = [1.0, 2.0, 3.0, 1.5]
MASS = {"H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Si": 28.086, "P": 30.974, "S": 32.06, "Cl": 35.45, "Br": 79.904, "I": 126.904}
PAULING = {"H": 2.20, "B": 2.04, "C": 2.55, "N": 3.04, "O": 3.44, "F": 3.98, "Si": 1.90, "P": 2.19, "S": 2.58, "Cl": 3.16, "Br": 2.96, "I": 2.66, "Li": 0.98, "Na": 0.93, "Mg": 1.31, "K": 0.82, "Se": 2.55}
ATOM_WIDTH, BOND_WIDTH = 45, 12
PLAIN_ATOM_WIDTH, PLAIN_BOND_WIDTH = 37, 8


def one_hot(value, known: list, other: bool = True) -> list[float]:
    out = [0.0] * (len(known) + other)
    if value in known:
        out[known.index(value)] = 1.0
    elif other:
        out[-1] = 1.0
    return out


def _hybrid(g: chem.Graph, i: int) -> str:
    orders = list(g.bonds[i].values())
    if 3.0 in orders or orders.count(2.0) > 1:
        return "sp"
    return "sp2" if 2.0 in orders or 1.5 in orders else "sp3"


def _common(g: chem.Graph, i: int) -> list[list[float]]:
    a, h = g.atoms[i], g.hydrogens(i)
    number = chem.ELEMENTS.index(a.symbol) + 1 if a.symbol in chem.ELEMENTS else 0
    return [one_hot(number, NUMBERS), one_hot(len(g.bonds[i]) + h, DEGREES), one_hot(a.charge, CHARGES), one_hot(h, HYDROGENS), one_hot(_hybrid(g, i), HYBRIDS), [float(a.aromatic), float(chem._in_ring(g, i))]]


def atom_features(g: chem.Graph, i: int) -> list[float]:
    number, degree, charge, h, hybrid, flags = _common(g, i)
    symbol = g.atoms[i].symbol
    return number + degree + charge + [1.0] + [0.0] * (CHIRALITIES - 1) + h + hybrid + flags + [MASS.get(symbol, 0.0) * 0.01, PAULING.get(symbol, 2.0) / 4, 0.0, 0.0]


def plain_atom_features(g: chem.Graph, i: int) -> list[float]:
    return sum(_common(g, i), [])


def ring_bonds(g: chem.Graph) -> set[tuple[int, int]]:
    """Bonds (smaller atom first) that lie on a ring: those that a depth-first search doesn't find to be bridges."""
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    rings = {(i, j) for i, near in g.bonds.items() for j in near if i < j}
    for root in g.bonds:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, -1, iter(g.bonds[root]))]
        while stack:
            at, parent, rest = stack[-1]
            for j in rest:
                if j == parent:
                    continue
                if j in order:
                    low[at] = min(low[at], order[j])
                else:
                    order[j] = low[j] = len(order)
                    stack.append((j, at, iter(g.bonds[j])))
                    break
            else:
                stack.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[at])
                    if low[at] > order[parent]:
                        rings.discard((min(at, parent), max(at, parent)))
    return rings


def _bond(g: chem.Graph, a: int, b: int, rings: set[tuple[int, int]] | None) -> tuple[float, float, float]:
    o = g.bonds[a][b]
    unsaturated = lambda i: any(x != 1.0 for x in g.bonds[i].values())
    conjugated = o == 1.5 or o == 1.0 and unsaturated(a) and unsaturated(b)
    ring = (min(a, b), max(a, b)) in (ring_bonds(g) if rings is None else rings)
    return o, float(conjugated), float(ring)


def bond_features(g: chem.Graph, a: int, b: int, rings: set[tuple[int, int]] | None = None) -> list[float]:
    o, conjugated, ring = _bond(g, a, b, rings)
    return one_hot(o, ORDERS, False) + [conjugated, ring] + [1.0] + [0.0] * (STEREOS - 1)


def plain_bond_features(g: chem.Graph, a: int, b: int, rings: set[tuple[int, int]] | None = None) -> list[float]:
    o, conjugated, ring = _bond(g, a, b, rings)
    return one_hot(o, ORDERS) + [conjugated, ring, 1.0]


@lru_cache(maxsize=200_000)
def tensors(smiles: str, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Atoms, directed bonds (2, e) whose reverse is the neighbour 2k / 2k + 1, and bond features; None for unreadable text."""
    try:
        g = chem.parse(smiles)
    except (ValueError, KeyError):
        return None
    af, bf, bw = (plain_atom_features, plain_bond_features, PLAIN_BOND_WIDTH) if plain else (atom_features, bond_features, BOND_WIDTH)
    x = np.array([af(g, i) for i in range(len(g.atoms))], np.float64)
    edges, feats, rings = [], [], ring_bonds(g)
    for i in g.bonds:
        for j in g.bonds[i]:
            if i < j:
                edges += [(i, j), (j, i)]
                feats += [bf(g, i, j, rings)] * 2
    return x, np.array(edges, np.int64).reshape(-1, 2).T, np.array(feats, np.float64).reshape(-1, bw)


def batch(graphs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Several graphs as one, with each atom's graph."""
    start = np.cumsum([0] + [len(g[0]) for g in graphs])
    return (
        np.concatenate([g[0] for g in graphs]),
        np.concatenate([g[1] + s for g, s in zip(graphs, start)], axis=1),
        np.concatenate([g[2] for g in graphs]),
        np.repeat(np.arange(len(graphs)), np.diff(start)),
    )


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def encode(w: dict[str, np.ndarray], x, edge, feat, owner, n: int, depth: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Directed-bond message passing: vectors of graphs and of atoms. Graphs without bonds take part with their atoms alone."""
    src, dst = edge
    first = np.concatenate([x[src], feat], axis=1) @ w["in"].T
    h = relu(first)
    for _ in range(depth - 1):
        into = np.zeros((len(x), h.shape[1]))
        np.add.at(into, dst, h)
        back = h.reshape(-1, 2, h.shape[1])[:, ::-1].reshape(h.shape)
        h = relu(first + (into[src] - back) @ w["h"].T)
    into = np.zeros((len(x), w["in"].shape[0]))
    np.add.at(into, dst, h)
    atoms = relu(np.concatenate([x, into], axis=1) @ w["out"].T + w["out_b"])
    graphs = np.zeros((n, atoms.shape[1]))
    np.add.at(graphs, owner, atoms)
    return graphs, atoms


def head(w: dict[str, np.ndarray], name: str, v: np.ndarray) -> np.ndarray:
    return relu(v @ w[f"{name}1"].T + w[f"{name}1_b"]) @ w[f"{name}2"].T + w[f"{name}2_b"]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def random_weights(classes: int, hidden: int = 32, plain: bool = False, seed: int = 0) -> dict[str, np.ndarray]:
    """Seeded weights of a template model, or of a plausibility model (plain)."""
    rng = np.random.default_rng(seed)
    a, b = (PLAIN_ATOM_WIDTH, PLAIN_BOND_WIDTH) if plain else (ATOM_WIDTH, BOND_WIDTH)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[-1]), s)
    w = {"in": draw(hidden, a + b), "h": draw(hidden, hidden), "out": draw(hidden, a + hidden), "out_b": np.zeros(hidden)}
    wide = 4 * hidden if plain else hidden
    w |= {"head1": draw(hidden, wide), "head1_b": np.zeros(hidden), "head2": draw(1 if plain else classes, hidden), "head2_b": np.zeros(1 if plain else classes)}
    if not plain:
        w |= {"center1": draw(hidden, hidden), "center1_b": np.zeros(hidden), "center2": draw(1, hidden), "center2_b": np.zeros(1)}
    return w


def check_width(w: dict[str, np.ndarray], plain: bool = False) -> None:
    want = PLAIN_ATOM_WIDTH + PLAIN_BOND_WIDTH if plain else ATOM_WIDTH + BOND_WIDTH
    if w["in"].shape[1] != want:
        raise ValueError(f"weights expect {w['in'].shape[1]} features, not {want}")


def load(path: str, plain: bool = False) -> dict[str, np.ndarray]:
    """Weights from an .npz file."""
    with np.load(path) as f:
        w = {k: f[k] for k in f.files}
    check_width(w, plain)
    return w


class TemplateModel:
    """Ranks templates by a graph network and applies the best ones."""

    def __init__(self, weights: dict[str, np.ndarray], templates: dict[int, str], top_templates: int = 50, batch_size: int = 128) -> None:
        check_width(weights)
        self.w, self.templates, self.top, self.size = weights, templates, top_templates, batch_size

    def _rank(self, texts: list[str]) -> list[tuple[list[tuple[int, float]], np.ndarray]]:
        out = []
        for i in range(0, len(texts), self.size):
            some = texts[i : i + self.size]
            x, edge, feat, owner = batch([tensors(t) for t in some])
            graphs, atoms = encode(self.w, x, edge, feat, owner, len(some))
            prob, centre = softmax(head(self.w, "head", graphs)), sigmoid(head(self.w, "center", atoms))[:, 0]
            for k in range(len(some)):
                best = np.argsort(-prob[k], kind="stable")[: self.top]
                out.append(([(int(c), float(prob[k, c])) for c in best], centre[owner == k]))
        return out

    def predict(self, smiles: list[str | None], top_k: int = 50) -> list[list[dict]]:
        """Reactant sets of each molecule's largest fragment, best first; nothing for unreadable text."""
        texts = [chem.largest_fragment(s or "") for s in smiles]
        good = [i for i, t in enumerate(texts) if t]
        out: list[list[dict]] = [[] for _ in texts]
        for i, (classes, centre) in zip(good, self._rank([texts[i] for i in good])):
            best: dict[tuple[str, ...], tuple[float, float, int]] = {}
            for label, p in classes:
                for reactants, at in chem.apply_template(self.templates.get(label, ""), texts[i]):
                    c = float(np.mean([centre[a] for a in at if a < len(centre)])) if at else 0.0
                    best[reactants] = max(best.get(reactants, (-1.0, 0.0, -1)), (p, c, label))
            ranked = sorted(best.items(), key=lambda x: (-x[1][0], -x[1][1], x[1][2], x[0]))
            out[i] = [{"reactants": list(r), "score": p, "template_id": label, "center_avg": c} for r, (p, c, label) in ranked[:top_k]]
        return out

    def predict_forward(self, reactants: list[str | None], top_k: int = 10) -> list[list[dict]]:
        """Products of each reactant set (all fragments count), best first, with how many templates gave them."""
        texts = [".".join(chem.components(s or "")) for s in reactants]
        good = [i for i, t in enumerate(texts) if t]
        out: list[list[dict]] = [[] for _ in texts]
        for i, (classes, _) in zip(good, self._rank([texts[i] for i in good])):
            best: dict[str, list] = {}
            for label, p in classes:
                for product in chem.apply_template_forward(self.templates.get(label, ""), texts[i]):
                    seen = best.setdefault(product, [p, label, 0])
                    seen[2] += 1
            ranked = sorted(best.items(), key=lambda x: (-x[1][0], -x[1][2], x[0]))
            out[i] = [{"product": q, "score": p, "template_id": label, "n_templates": n} for q, (p, label, n) in ranked[:top_k]]
        return out


class Plausibility:
    """Probability that a reaction is real, from both sides' vectors."""

    def __init__(self, weights: dict[str, np.ndarray], batch_size: int = 256, depth: int = 4) -> None:
        check_width(weights, True)
        self.w, self.size, self.depth = weights, batch_size, depth

    def _vectors(self, texts: list[str]) -> np.ndarray:
        x, edge, feat, owner = batch([tensors(t, True) for t in texts])
        return encode(self.w, x, edge, feat, owner, len(texts), self.depth)[0]

    def score(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        """Scores of (reactants, product); 0 where a side can't be read."""
        good = [i for i, (r, p) in enumerate(pairs) if r and p and tensors(r, True) is not None and tensors(p, True) is not None]
        out = np.zeros(len(pairs))
        for k in range(0, len(good), self.size):
            some = good[k : k + self.size]
            r, p = (self._vectors([pairs[i][j] for i in some]) for j in (0, 1))
            out[some] = sigmoid(head(self.w, "head", np.concatenate([r, p, p - r, p * r], axis=1)))[:, 0]
        return out
