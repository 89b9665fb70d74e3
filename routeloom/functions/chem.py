"""Molecules as text: a reader and writer of SMILES, a matcher of patterns, templates.

Covers the organic subset, brackets (isotope, hydrogens, charge, map number),
branches, rings, aromatic atoms and components. Stereo marks are read and left
out. The canonical text is the same for every way of writing a molecule, and
reading it again gives it back; it is this module's own normal form.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass, field
from functools import lru_cache

# Fixed values of the SMILES language.
ORGANIC = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
AROMATIC = ("b", "c", "n", "o", "p", "s", "se", "as")
BONDS = {"-": 1.0, "=": 2.0, "#": 3.0, "$": 4.0, ":": 1.5, "/": 1.0, "\\": 1.0}
ELEMENTS = "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe".split()
_ATOM = re.compile(r"(\d+)?([A-Z][a-z]?|[a-z][a-z]?|\*)(@{0,2})(?:H(\d*))?((?:\+\+|--|[+-]\d*)?)(?::(\d+))?")
_TOKEN = re.compile(r"Cl|Br|[BCNOPSFI]|[bcnops]|\[[^\]]*\]|%\d\d|\d|[-=#$:/\\().]|\*")
MAX_FRAGMENTS, MAX_PRODUCTS, MAX_OUTCOMES = 8, 1000, 64


@dataclass
class Atom:
    symbol: str
    aromatic: bool = False
    charge: int = 0
    isotope: int = 0
    hydrogens: int | None = None  # None: filled up to a normal valence
    number: int = 0

    def label(self) -> tuple:
        return (self.symbol, self.aromatic, self.charge, self.isotope)


@dataclass
class Graph:
    atoms: list[Atom] = field(default_factory=list)
    bonds: dict[int, dict[int, float]] = field(default_factory=dict)

    def add(self, atom: Atom) -> int:
        self.atoms.append(atom)
        self.bonds[len(self.atoms) - 1] = {}
        return len(self.atoms) - 1

    def join(self, a: int, b: int, order: float) -> None:
        if a == b or b in self.bonds[a]:
            raise ValueError("a bond from an atom to itself, or twice")
        self.bonds[a][b] = self.bonds[b][a] = order

    def hydrogens(self, i: int) -> int:
        a = self.atoms[i]
        if a.hydrogens is not None:
            return a.hydrogens
        used = sum(self.bonds[i].values())
        if a.aromatic:
            used = sum(1 if o == 1.5 else o for o in self.bonds[i].values()) + 1
        return max(0, next((int(v - used) for v in ORGANIC[a.symbol] if v >= used), 0))

    def parts(self) -> list[list[int]]:
        seen: set[int] = set()
        out = []
        for i in range(len(self.atoms)):
            if i not in seen:
                todo, part = [i], []
                seen.add(i)
                while todo:
                    x = todo.pop()
                    part.append(x)
                    for y in self.bonds[x]:
                        if y not in seen:
                            seen.add(y)
                            todo.append(y)
                out.append(sorted(part))
        return out

    def only(self, keep: list[int]) -> "Graph":
        at = {x: k for k, x in enumerate(keep)}
        return Graph([self.atoms[x] for x in keep], {at[x]: {at[y]: o for y, o in self.bonds[x].items() if y in at} for x in keep})


def _bracket(text: str) -> Atom:
    m = _ATOM.fullmatch(text)
    if not m:
        raise ValueError(f"unreadable atom [{text}]")
    iso, symbol, _, h, charge, number = m.groups()
    aromatic = symbol.islower() and symbol != "*"
    if aromatic and symbol not in AROMATIC or symbol.capitalize() not in (*ELEMENTS, "*"):
        raise ValueError(f"unknown element {symbol}")
    sign = 0
    if charge:
        sign = (1 if charge[0] == "+" else -1) * (2 if charge in ("++", "--") else int(charge[1:] or 1))
    return Atom(symbol.capitalize(), aromatic, sign, int(iso or 0), 0 if h is None and "H" not in text[text.index(symbol) + len(symbol) :] else int(h or 1), int(number or 0))


def parse(smiles: str) -> Graph:
    """The molecular graph; ValueError for what can't be read."""
    g, last, order, stack, rings, at = Graph(), None, None, [], {}, 0
    for m in _TOKEN.finditer(smiles):
        if m.start() != at:
            raise ValueError(f"unreadable at {at}")
        at, t = m.end(), m[0]
        if t in BONDS:
            order = BONDS[t]
        elif t == "(":
            stack.append(last)
        elif t == ")":
            if not stack:
                raise ValueError("unbalanced branch")
            last = stack.pop()
        elif t == ".":
            last = order = None
        elif t[0] == "%" or t.isdigit():
            key = t.lstrip("%")
            if last is None:
                raise ValueError("ring mark without an atom")
            if key in rings:
                other, first = rings.pop(key)
                both = g.atoms[last].aromatic and g.atoms[other].aromatic
                g.join(last, other, order or first or (1.5 if both else 1.0))
            else:
                rings[key] = (last, order)
            order = None
        else:
            atom = _bracket(t[1:-1]) if t[0] == "[" else Atom(t.capitalize(), t.islower(), hydrogens=0 if t == "*" else None)
            i = g.add(atom)
            if last is not None:
                g.join(last, i, order or (1.5 if atom.aromatic and g.atoms[last].aromatic else 1.0))
            last, order = i, None
    if at != len(smiles) or rings or stack or not g.atoms:
        raise ValueError("unreadable or unfinished")
    for i, a in enumerate(g.atoms):
        if a.hydrogens is None and sum(1 if o == 1.5 else o for o in g.bonds[i].values()) > max(ORGANIC[a.symbol]):
            raise ValueError("too many bonds")
        a.hydrogens = g.hydrogens(i)
    return g


def _ranks(g: Graph) -> list[int]:
    """Ranks of atoms, refined by their neighbours until they stand still; ties are broken one at a time by the smallest outcome."""

    def settle(colour: list) -> list[int]:
        order = sorted(set(colour))
        now = [order.index(c) for c in colour]
        while True:
            full = [(now[i], tuple(sorted((o, now[j]) for j, o in g.bonds[i].items()))) for i in range(len(now))]
            order = {c: k for k, c in enumerate(sorted(set(full)))}
            new = [order[c] for c in full]
            if len(order) == len(set(now)):
                return new
            now = new

    now = settle([(a.label(), g.hydrogens(i), len(g.bonds[i]), tuple(sorted(g.bonds[i].values()))) for i, a in enumerate(g.atoms)])
    while len(set(now)) < len(now):
        tied = min(c for c in now if now.count(c) > 1)
        best = None
        for i in [i for i, c in enumerate(now) if c == tied]:
            new = settle([2 * c - (k == i) for k, c in enumerate(now)])
            order = sorted(range(len(new)), key=lambda k: new[k])
            place = {k: n for n, k in enumerate(order)}
            seal = [sorted((place[j], o) for j, o in g.bonds[k].items()) for k in order] if len(set(new)) == len(new) else [sorted((new[j], o) for j, o in g.bonds[k].items()) for k in order]
            if best is None or seal < best[0]:
                best = (seal, new)
            if len(g.atoms) > 60:  # symmetric twins of large molecules: any of them gives the same text
                break
        now = best[1]
    return now


def _atom_text(g: Graph, i: int) -> str:
    a = g.atoms[i]
    symbol = a.symbol.lower() if a.aromatic else a.symbol
    h = g.hydrogens(i)
    if not a.charge and not a.isotope and (a.symbol in ORGANIC and (not a.aromatic or a.symbol.lower() in "bcnops") or a.symbol == "*"):
        plain = Graph([Atom(a.symbol, a.aromatic)] + [Atom("*")] * len(g.bonds[i]), {0: {k + 1: o for k, o in enumerate(g.bonds[i].values())}, **{k + 1: {} for k in range(len(g.bonds[i]))}})
        if a.symbol == "*" and h == 0 or a.symbol != "*" and plain.hydrogens(0) == h:
            return symbol
    sign = "" if not a.charge else ("+" if a.charge > 0 else "-") + (str(abs(a.charge)) if abs(a.charge) > 1 else "")
    return f"[{a.isotope or ''}{symbol}{'H' + (str(h) if h > 1 else '') if h else ''}{sign}]"


def write(g: Graph) -> str:
    """Canonical text; components in order of their texts."""
    return ".".join(sorted(_write(g.only(p)) for p in g.parts()))


def _bond_text(g: Graph, a: int, b: int) -> str:
    o, both = g.bonds[a][b], g.atoms[a].aromatic and g.atoms[b].aromatic
    if o == 1.5:
        return "" if both else ":"
    return ("-" if both else "") if o == 1.0 else {2.0: "=", 3.0: "#", 4.0: "$"}[o]


def _write(g: Graph) -> str:
    rank = _ranks(g)
    start = min(range(len(rank)), key=lambda i: (len(g.bonds[i]) > 1, rank[i]))
    tree: dict[int, list[int]] = {i: [] for i in range(len(rank))}
    back: list[tuple[int, int]] = []
    seen, order = set(), []

    def visit(i: int, parent: int | None) -> None:
        seen.add(i)
        order.append(i)
        for j in sorted(g.bonds[i], key=lambda k: rank[k]):
            if j == parent:
                continue
            if j in seen:
                if (j, i) not in back and (i, j) not in back:
                    back.append((i, j))
            else:
                tree[i].append(j)
                visit(j, i)

    visit(start, None)
    place = {x: n for n, x in enumerate(order)}
    marks: dict[int, list[str]] = {i: [] for i in tree}
    for n, (a, b) in enumerate(sorted(back, key=lambda e: (place[e[1]], place[e[0]])), 1):
        mark = str(n) if n < 10 else f"%{n}"
        marks[b].append(_bond_text(g, a, b) + mark)
        marks[a].append(mark)

    def text(i: int) -> str:
        out = _atom_text(g, i) + "".join(marks[i])
        for k, j in enumerate(tree[i]):
            part = _bond_text(g, i, j) + text(j)
            out += part if k == len(tree[i]) - 1 else f"({part})"
        return out

    return text(start)


@lru_cache(maxsize=500_000)
def canonicalize(smiles: str | None) -> str | None:
    """Canonical text without map numbers; None for what can't be read."""
    try:
        g = parse((smiles or "").strip())
    except (ValueError, RecursionError, KeyError):
        return None
    return write(g)


def key(smiles: str | None) -> str | None:
    """27 characters in the shape of an InChIKey, made from a hash of the canonical text."""
    text = canonicalize(smiles)
    if text is None:
        return None
    raw = "".join(chr(65 + b % 26) for b in hashlib.sha256(text.encode()).digest())
    return f"{raw[:14]}-{raw[14:24]}-{raw[24]}"


def heavy_atoms(smiles: str | None) -> int | None:
    try:
        return sum(a.symbol != "H" for a in parse((smiles or "").strip()).atoms)
    except (ValueError, KeyError):
        return None


def components(text: str) -> list[str]:
    """Canonical components in order; empty and unreadable ones are dropped."""
    return [c for c in (canonicalize(p) for p in text.split(".") if p) if c]


def canonical_set(text: str) -> str:
    """Sorted canonical components, joined; empty if one can't be read."""
    parts = [canonicalize(p) for p in text.split(".")]
    return "" if None in parts else ".".join(sorted(parts))


def parse_reaction(text: str) -> tuple[list[str], list[str], list[str]] | None:
    parts = text.split(">")
    return tuple(components(p) for p in parts) if len(parts) == 3 else None


def largest_fragment(smiles: str) -> str | None:
    """The component with the most heavy atoms, the first of equal ones."""
    parts = components(smiles)
    return max(parts, key=lambda p: heavy_atoms(p) or 0) if parts else None


def has_radical(smiles: str) -> bool:
    """Whether some atom lacks hydrogens of its normal valence."""
    g = parse(smiles)
    for i, a in enumerate(g.atoms):
        if a.symbol in ORGANIC and not a.aromatic:
            used = sum(g.bonds[i].values()) + g.hydrogens(i)
            shift = a.charge if a.symbol in ("N", "O", "P", "S") else -abs(a.charge)
            if all(v + shift != used for v in ORGANIC[a.symbol]):
                return True
    return False


# --- patterns -------------------------------------------------------------------------------


@dataclass
class Query:
    """One atom of a pattern: alternatives of (what, value, wanted)."""

    tests: list[list[tuple[str, object, bool]]]
    number: int = 0
    template: Atom | None = None  # how it looks where it is made


_PRIMITIVE = re.compile(r"!?(?:#\d+|\*|H\d*|D\d+|X\d+|R\d*|[+-]\d*|a(?![sl])|A(?![a-z])|Cl|Br|Se|Si|[BCNOPSFI]|[bcnops])")


def _query(text: str) -> Query:
    body, _, number = text.partition(":")
    alternatives, shape = [], Atom("*", hydrogens=None)
    for option in body.split(","):
        tests = []
        for part in re.split("[;&]", option):
            at = 0
            for m in _PRIMITIVE.finditer(part):
                if m.start() != at:
                    break
                at, p = m.end(), m[0]
                wanted, p = not p.startswith("!"), p.lstrip("!")
                if p == "*":
                    continue
                if p[0] == "#":
                    tests.append(("element", ELEMENTS[int(p[1:]) - 1], wanted))
                elif p[0] in "HDXR" and (len(p) == 1 or p[1:].isdigit()):
                    tests.append((p[0], int(p[1:] or 1) if p[0] != "R" or len(p) > 1 else -1, wanted))
                elif p[0] in "+-":
                    tests.append(("charge", (1 if p[0] == "+" else -1) * int(p[1:] or 1), wanted))
                elif p in "aA":
                    tests.append(("aromatic", p == "a", wanted))
                else:
                    tests += [("element", p.capitalize(), wanted), ("aromatic", p.islower(), wanted)] if wanted else [("atom", (p.capitalize(), p.islower()), False)]
            if at != len(part):
                raise ValueError(f"unreadable pattern [{text}]")
        alternatives.append(tests)
    for what, value, wanted in alternatives[0]:
        if wanted and what == "element":
            shape.symbol = value
        elif wanted and what == "aromatic":
            shape.aromatic = value
        elif wanted and what == "charge":
            shape.charge = value
        elif wanted and what == "H":
            shape.hydrogens = value
    return Query(alternatives, int(number or 0), shape)


@dataclass
class Pattern:
    atoms: list[Query] = field(default_factory=list)
    bonds: list[tuple[int, int, str]] = field(default_factory=list)


def parse_pattern(text: str) -> Pattern:
    p, last, order, stack, rings, at = Pattern(), None, "", [], {}, 0
    for m in re.finditer(r"\[[^\]]*\]|Cl|Br|[BCNOPSFI]|[bcnops]|%\d\d|\d|[-=#:~/\\()]|\*", text):
        if m.start() != at:
            raise ValueError("unreadable pattern")
        at, t = m.end(), m[0]
        if t in "-=#:~/\\":
            order = "-" if t in "/\\" else t
        elif t == "(":
            stack.append(last)
        elif t == ")":
            last = stack.pop()
        elif t.lstrip("%").isdigit():
            k = t.lstrip("%")
            if k in rings:
                other, first = rings.pop(k)
                p.bonds.append((other, last, order or first))
            else:
                rings[k] = (last, order)
            order = ""
        else:
            p.atoms.append(_query(t[1:-1] if t[0] == "[" else t))
            if last is not None:
                p.bonds.append((last, len(p.atoms) - 1, order))
            last, order = len(p.atoms) - 1, ""
    if at != len(text) or rings or stack or not p.atoms:
        raise ValueError("unreadable pattern")
    return p


def _fits(q: Query, g: Graph, i: int) -> bool:
    a = g.atoms[i]
    value = {"element": a.symbol, "aromatic": a.aromatic, "charge": a.charge, "atom": (a.symbol, a.aromatic)}
    for tests in q.tests:
        for what, want, wanted in tests:
            if what in value:
                ok = value[what] == want
            elif what == "H":
                ok = g.hydrogens(i) == want
            elif what == "D":
                ok = len(g.bonds[i]) == want
            elif what == "X":
                ok = len(g.bonds[i]) + g.hydrogens(i) == want
            else:
                ring = _in_ring(g, i)
                ok = ring if want == -1 else ring == bool(want)
            if ok != wanted:
                break
        else:
            return True
    return False


def _in_ring(g: Graph, i: int) -> bool:
    for j in g.bonds[i]:
        seen, todo = {i, j}, [j]
        while todo:
            x = todo.pop()
            for y in g.bonds[x]:
                if y == i and x != j:
                    return True
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
    return False


def _bond_fits(kind: str, order: float) -> bool:
    return kind == "~" or order in {"": (1.0, 1.5), "-": (1.0,), "=": (2.0,), "#": (3.0,), ":": (1.5,)}[kind]


def matches(p: Pattern, g: Graph):
    """Every way to lay the pattern on the molecule: tuples of atom places."""
    near: dict[int, list[tuple[int, str]]] = {i: [] for i in range(len(p.atoms))}
    for a, b, k in p.bonds:
        near[a].append((b, k))
        near[b].append((a, k))

    def grow(laid: dict[int, int]):
        if len(laid) == len(p.atoms):
            yield tuple(laid[i] for i in range(len(p.atoms)))
            return
        q = len(laid)
        tied = [(laid[b], k) for b, k in near[q] if b in laid]
        options = g.bonds[tied[0][0]] if tied else range(len(g.atoms))
        for i in sorted(options):
            if i not in laid.values() and _fits(p.atoms[q], g, i) and all(i in g.bonds[x] and _bond_fits(k, g.bonds[x][i]) for x, k in tied):
                yield from grow(laid | {q: i})

    yield from grow({})


def _rewrite(g: Graph, left: list[Pattern], right: list[Pattern], laid: list[tuple[int, ...]]) -> Graph | None:
    """The molecule after the matched atoms have become the right-hand side."""
    place: dict[int, int] = {}
    matched: set[int] = set()
    for p, at in zip(left, laid):
        for q, i in zip(p.atoms, at):
            matched.add(i)
            if q.number:
                place[q.number] = i
    kept = {q.number for p in right for q in p.atoms if q.number}
    charged = {q.number for p in left for q in p.atoms if any(t[0] == "charge" for t in q.tests[0])}
    out = Graph()
    at: dict[int, int] = {}
    gone = {i for i in matched if i not in {place[n] for n in place if n in kept}}
    for i, a in enumerate(g.atoms):
        if i not in gone:
            at[i] = out.add(Atom(a.symbol, a.aromatic, a.charge, a.isotope, a.hydrogens if a.symbol not in ORGANIC or a.charge or a.isotope else None))
            if a.hydrogens is not None and (a.aromatic and a.symbol == "N" and a.hydrogens and i not in matched):
                out.atoms[-1].hydrogens = a.hydrogens
    inner = {frozenset((at_[a], at_[b])) for p, at_ in zip(left, laid) for a, b, _ in p.bonds}
    for i in at:
        for j, o in g.bonds[i].items():
            if j in at and i < j and frozenset((i, j)) not in inner:
                out.join(at[i], at[j], o)
    left_bond = {frozenset((p.atoms[a].number, p.atoms[b].number)): g.bonds[at_[a]][at_[b]] for p, at_ in zip(left, laid) for a, b, _ in p.bonds}
    for p in right:
        own = []
        for q in p.atoms:
            if q.number in place:
                i = at[place[q.number]]
                if any(t[0] == "charge" for t in q.tests[0]):
                    out.atoms[i].charge = q.template.charge
                elif q.number in charged:
                    out.atoms[i].charge = 0
            else:
                if q.template.symbol == "*":
                    return None
                i = out.add(Atom(q.template.symbol, q.template.aromatic, q.template.charge, 0, q.template.hydrogens if q.template.symbol not in ORGANIC else None))
            own.append(i)
        for a, b, k in p.bonds:
            pair = frozenset((p.atoms[a].number, p.atoms[b].number))
            both = out.atoms[own[a]].aromatic and out.atoms[own[b]].aromatic
            order = {"-": 1.0, "=": 2.0, "#": 3.0, ":": 1.5}.get(k)
            if order is None:
                order = left_bond.get(pair, 1.5 if both else 1.0) if k in ("", "~") else 1.0
            if own[b] in out.bonds[own[a]]:
                out.bonds[own[a]][own[b]] = out.bonds[own[b]][own[a]] = order
            else:
                out.join(own[a], own[b], order)
    for i, a in enumerate(out.atoms):
        if a.hydrogens is None and (a.charge or a.isotope):
            used = sum(out.bonds[i].values())
            base = next((v for v in ORGANIC[a.symbol] if v + a.charge >= used), None)
            a.hydrogens = max(0, int(base + a.charge - used)) if base is not None else 0
        if a.hydrogens is None and a.symbol in ORGANIC and sum(1 if o == 1.5 else o for o in out.bonds[i].values()) > max(ORGANIC[a.symbol]):
            return None
    for i in range(len(out.atoms)):
        out.atoms[i].hydrogens = out.hydrogens(i)
    return out


def _strip(side: str) -> str:
    side = side.strip()
    while side.startswith("(") and side.endswith(")"):
        side = side[1:-1]
    return side


@lru_cache(maxsize=50_000)
def _compiled(smarts: str, forward: bool) -> tuple[tuple[Pattern, ...], tuple[Pattern, ...]] | None:
    """Both sides as patterns. Backwards, the left side must be one pattern; forwards, the sides change places."""
    left, arrow, right = smarts.partition(">>")
    if not arrow:
        return None
    try:
        a, b = (tuple(parse_pattern(_strip(x)) for x in re.split(r"\.(?![^\[]*\])", _strip(side)) if x) for side in (left, right))
    except (ValueError, IndexError):
        return None
    if not a or not b or len(a) != 1:
        return None
    return (b, a) if forward else (a, b)


@lru_cache(maxsize=4096)
def _graph(text: str) -> Graph:
    """The graph of a canonical text, which no caller changes."""
    return parse(text)


def apply_template(smarts: str, product: str, max_outcomes: int = MAX_OUTCOMES) -> list[tuple[tuple[str, ...], tuple[int, ...] | None]]:
    """Distinct reactant sets of a retro template, each sorted; matched atoms come with them only where every match has its own set."""
    sides = _compiled(smarts, False)
    text = canonicalize(product)
    if sides is None or text is None:
        return []
    g = _graph(text)
    found, n = {}, 0
    for at in matches(sides[0][0], g):
        n += 1
        made = _rewrite(g, list(sides[0]), list(sides[1]), [at])
        if made is None:
            continue
        parts = tuple(sorted(write(made.only(p)) for p in made.parts()))
        if parts and all(canonicalize(p) is not None for p in parts) and parts not in found:
            found[parts] = at
            if len(found) >= max_outcomes:
                break
    return [(k, v if n == len(found) else None) for k, v in found.items()]


def apply_template_forward(smarts: str, reactants: str, max_outcomes: int = MAX_OUTCOMES) -> list[str]:
    """Distinct products of a retro template run forwards, over every ordered choice of fragments for its slots."""
    sides = _compiled(smarts, True)
    parts = components(reactants)
    if sides is None or not parts or len(parts) > MAX_FRAGMENTS or len(parts) < len(sides[0]):
        return []
    out: dict[str, None] = {}
    graphs = [parse(p) for p in parts]
    for chosen in itertools.permutations(range(len(parts)), len(sides[0])):
        both, shift, starts = Graph(), 0, []
        for k in chosen:
            starts.append(shift)
            for a in graphs[k].atoms:
                both.add(Atom(**vars(a)))
            for i, near in graphs[k].bonds.items():
                both.bonds[i + shift] = {j + shift: o for j, o in near.items()}
            shift += len(graphs[k].atoms)
        ways = itertools.product(*[[tuple(i + s for i in at) for at in matches(p, graphs[k])] for p, k, s in zip(sides[0], chosen, starts)])
        for laid in itertools.islice(ways, MAX_PRODUCTS):
            made = _rewrite(both, list(sides[0]), list(sides[1]), list(laid))
            if made is None:
                continue
            text = largest_fragment(write(made))
            if text is not None and not has_radical(text) and text not in out:
                out[text] = None
                if len(out) >= max_outcomes:
                    return list(out)
    return list(out)
