import random

import numpy as np

from routeloom.llm import hashing as h


def test_words_are_what_split_gives():
    rnd = random.Random(1)
    texts = [None, "", " ", "a", " a b\tc\x0bd\x0ce\rf\n", "é\x85日 x", "x" * 5000 + " y", "\x1cA\x1f B"]
    texts += ["".join(rnd.choice("ab \n\té") for _ in range(rnd.randrange(60))) for _ in range(300)]
    for lower in (False, True):
        for block in (h.BLOCK, 50):
            old, h.BLOCK = h.BLOCK, block
            both, size = h.Words().words(texts, lower)
            h.BLOCK = old
            split = [((t or "").encode().translate(h._LOWER) if lower else (t or "").encode()).split() for t in texts]
            assert size.tolist() == [len(s) for s in split] and both.shape == (2, size.sum())
            flat = [w for s in split for w in s]
            for k in range(2):
                seen = {}
                for w, x in zip(flat, both[k].tolist()):
                    assert seen.setdefault(w, x) == x
                assert len(set(seen.values())) == len(seen)


def test_rolling_and_sliding():
    x = np.random.default_rng(2).integers(0, 3, 200).astype(h.U)
    r = h.rolling(x, 4, h.BASES[0])
    runs = [tuple(x[i : i + 4]) for i in range(len(x) - 3)]
    assert len(set(zip(runs, r.tolist()))) == len(set(runs)) == len(set(r.tolist()))
    assert len(h.rolling(x[:2], 3, h.BASES[0])) == 0
    for n in (1, 2, 5, 13):
        assert h.sliding(x, n, np.minimum).tolist() == [x[i : i + n].min() for i in range(len(x) - n + 1)]
    assert h.left(np.array([2, 0, 3])).tolist() == [2, 1, 3, 2, 1]
