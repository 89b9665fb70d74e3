"""BPE encoding and decoding with a public vocabulary.

White space of the ASCII kind always ends a piece for the vocabulary's
pre-tokenizer, so a text's ids are the concatenation of its pieces' ids. Short
pieces are encoded once per worker and remembered in a bounded table. A piece
of more than LONG bytes, which no white space splits, is encoded as a tree: its
leaves are encoded in parallel, and neighbours are concatenated by re-encoding a
growing window around the join until it agrees with both sides exactly.

Defined results: a null or empty text has no ids and decodes to the empty
text; repeated rows are encoded one by one; columns other than the id and the
text are neither read nor returned; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

VOCABULARY = "word_bpe_49k.json"
#: Bytes from which a piece counts as long; characters of a tree's leaf, in trees of up to FEW and of more characters; first half-width of a window.
LONG, LEAF, FEW, LARGE, WINDOW = 24, 16, 2048, 1024, 8
#: Pieces that a worker remembers; rows looked at together.
REMEMBERED, SLICE = 600_000, 512

#: Letters whose case and form change one by one, then marks without an apostrophe: at most one word for the pre-tokenizer from either.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)?([!-&(-/:-@\\[-`{-~]+)?")


def load(path: str | None = None):
    """The tokenizer at path, or else the installed public vocabulary."""
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


Token = tuple[int, int, int]  # id, first and last character's offset


def _encode_at(tok, text: str, at: list[tuple[int, int]]) -> list[list[Token]]:
    found = tok.encode_batch([text[a:b] for a, b in at], add_special_tokens=False)
    return [[(i, a + s, a + e) for i, (s, e) in zip(x.ids, x.offsets)] for x, (a, _) in zip(found, at)]


def _seams(tokens: list[Token], lo: int, hi: int) -> dict[tuple[Token, Token], int]:
    """Neighbouring tokens that lie within lo..hi, with the second's position; neither shares a character with the other."""
    return {(x, y): i + 1 for i, (x, y) in enumerate(zip(tokens, tokens[1:])) if lo <= x[1] and y[2] <= hi and x[2] <= y[1]}


def _span(tokens: list[Token], lo: int, hi: int) -> tuple[int, int]:
    """Positions of the tokens that touch lo..hi, found by bisection."""
    from bisect import bisect_left

    first = bisect_left(tokens, lo, key=lambda t: t[1])
    last = bisect_left(tokens, hi, key=lambda t: t[1])
    return max(0, first - 1), last


def join(tok, text: str, left: list[Token], right: list[Token], lo: int, cut: int, hi: int, width: int = WINDOW) -> list[Token]:
    """Tokens of text[lo:hi] from those of text[lo:cut] and text[cut:hi].

    Two neighbouring tokens that the window and a side have in common are a
    valid pair in both, so the sequences may be exchanged between them; every
    pair of the result is then valid, which makes it the encoding itself.
    """
    while True:
        a, b = max(lo, cut - width), min(hi, cut + width)
        window = _encode_at(tok, text, [(a, b)])[0]
        if a == lo and b == hi:
            return window
        own = _seams(window, a, b)
        start, stop = (0, 0) if a == lo else (None, None)
        end = resume = None
        if a > lo:
            f, t = _span(left, a, cut)
            for pair, i in _seams(left[f:t], a, cut).items():
                if pair in own:
                    start, stop = own[pair], f + i
                    break
        if b < hi:
            f, t = _span(right, cut, b)
            for pair, i in reversed(_seams(right[f:t], cut, b).items()):
                if pair in own:
                    end, resume = own[pair], f + i
                    break
        else:
            end, resume = len(window), len(right)
        if start is not None and end is not None and start <= end:
            return left[:stop] + window[start:end] + right[resume:]
        width *= 2


def encode_tree(tok, text: str, leaf: int | None = None) -> list[int]:
    """Ids of a long text: leaves in parallel, then concatenated in pairs, level by level."""
    n = max(1, -(-len(text) // (leaf or (LEAF if len(text) <= FEW else LARGE))))
    edges = [len(text) * i // n for i in range(n + 1)]
    at = list(zip(edges, edges[1:]))
    parts = _encode_at(tok, text, at)
    while len(parts) > 1:
        merged, spans = [], []
        for i in range(0, len(parts) - 1, 2):
            (lo, cut), (_, hi) = at[i], at[i + 1]
            merged.append(join(tok, text, parts[i], parts[i + 1], lo, cut, hi))
            spans.append((lo, hi))
        if len(parts) % 2:
            merged.append(parts[-1])
            spans.append(at[-1])
        parts, at = merged, spans
    return [t[0] for t in parts[0]]


class Coder:
    """Encodes and decodes whole texts; remembers a bounded number of pieces, in two generations."""

    def __init__(self, path: str | None = None, long: int = LONG, remembered: int = REMEMBERED) -> None:
        self.tok, self.long, self.remembered = load(path), long, remembered
        self.ids: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.trees = 0
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.shown = [(self.tok.id_to_token(i) or "").encode() for i in range(size)]
        self.ends = np.array([x.endswith(b"</w>") for x in self.shown])

    def _learn(self, pieces: set[bytes]) -> None:
        if len(self.ids) + len(pieces) > self.remembered:  # pieces that are met again move on to the new generation
            self.old, self.ids = self.ids, {}
        new = []
        for p in pieces - self.ids.keys():
            found = self.old.get(p)
            if found is None:
                new.append(p)
            else:
                self.ids[p] = found
        plain, other = [], []
        for p in new:
            m = _PLAIN.fullmatch(p.decode("utf-8", "replace"))
            if m:
                plain.append((p, m[0], bool(m[1]) + bool(m[2])))
            else:
                other.append(p)
        for i in range(0, len(plain), 2000):
            other += self._together(plain[i : i + 2000])
        for i in range(0, len(other), 20_000):
            some = other[i : i + 20_000]
            for p, x in zip(some, self.tok.encode_batch_fast([p.decode("utf-8", "replace") for p in some], add_special_tokens=False)):
                self.ids[p] = np.array(x.ids, "<u4").tobytes()

    def _together(self, some: list[tuple[bytes, str, int]]) -> list[bytes]:
        """Learn pieces from one text that holds them all, told apart by the tokens that end a word; returns those still to learn."""
        ids = np.array(self.tok.encode_batch_fast([" ".join(t for _, t, _ in some)], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends[ids])
        upto = np.cumsum([n for _, _, n in some])
        if len(last) != upto[-1]:
            return [p for p, _, _ in some]
        edge = [0, *(4 * (last[upto - 1] + 1)).tolist()]
        raw = ids.tobytes()
        for (p, _, _), x, y in zip(some, edge, edge[1:]):
            self.ids[p] = raw[x:y]
        return []

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Ids as little-endian 32-bit integers, and the decoded text, of each text."""
        pieces = [(t or "").encode("utf-8", "replace").split() for t in texts]
        met = set().union(*pieces)
        long = {p for p in met if len(p) > self.long}
        self._learn(met - long)
        trees = {p: self.old.get(p) or self.ids.get(p) or np.array(encode_tree(self.tok, p.decode("utf-8", "replace")), "<u4").tobytes() for p in long}
        self.ids.update((p, x) for p, x in trees.items() if len(p) <= FEW)
        self.trees += len(trees)
        known = (lambda p: trees.get(p) or self.ids[p]) if trees else self.ids.__getitem__
        for ps in pieces:
            ids = b"".join(map(known, ps))
            yield ids, b" ".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[str | None, Coder] = {}


def _coder(path: str | None) -> Coder:
    """One coder per worker process, which later tasks find warm."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = _coder(path)
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                both = list(coder(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.frombuffer(x, "<i4") for x, _ in both], pa.list_(pa.int32())), pa.array([y.decode() for _, y in both], pa.string())], [id_col, "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; ids and decoded texts never leave the worker."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder, sha = _coder(path), lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                n, h, d = [], [], []
                for ids, shown in coder(part.column(1).to_pylist()):
                    n.append(len(ids) // 4)
                    h.append(sha(ids))
                    d.append(sha(shown))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(h), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
