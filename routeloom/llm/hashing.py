"""Words of texts as arrays of 64-bit hashes, and rolling hashes over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the rolling hashes.
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
#: Bytes whose words are hashed together; a longer text is a block of its own.
BLOCK = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """64-bit hashes (``kinds`` of them, two at most) of every word of texts, the same in every process.

    A word's hash is a polynomial of its bytes, each byte replaced by a fixed
    64-bit value, and comes from a difference of running sums: texts are never
    taken apart word by word.
    """

    def __init__(self, kinds: int = 2) -> None:
        index = np.arange(256, dtype=U)
        self.bases = BASES[:kinds]
        self.tables = [mixed(index + U((1 + 1000 * k) * int(b) % (1 << 64))) for k, b in enumerate(self.bases)]
        self.inverses = [U(pow(int(b), -1, 1 << 64)) for b in self.bases]
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        """Powers of the bases and of their inverses, for blocks of up to n bytes."""

        def power(b: np.uint64) -> np.ndarray:
            x = np.full(n + 1, b, U)
            x[0] = 1
            return np.multiply.accumulate(x)

        self.powers = [(power(b), power(i)) for b, i in zip(self.bases, self.inverses)]

    def words(self, texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the texts (a list or an Arrow array), one text after the other, and each text's number of words.

        Words are what stands between bytes 0x20 and 0x09 to 0x0D.
        """
        data, offsets = raw(texts)
        found, sizes, i, n = [np.zeros((len(self.bases), 0), U)], [np.zeros(0, np.int64)], 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
            h, size = self._block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
            found.append(h)
            sizes.append(size)
            i = j
        return np.concatenate(found, axis=1), np.concatenate(sizes)

    def _block(self, x: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        if len(x) >= len(self.powers[0][0]):
            self._grow(2 * len(x))
        start, end, size = spans(x, offsets)
        if lower:
            x = _LOWER.take(x)
        out = np.empty((len(self.bases), len(start)), U)
        for k, (table, (power, inverse)) in enumerate(zip(self.tables, self.powers)):
            sums = np.empty(len(x) + 1, U)
            sums[0] = 0
            np.cumsum(table.take(x) * power[: len(x)], out=sums[1:])
            h = (sums.take(end) - sums.take(start)) * inverse.take(start)
            out[k] = mixed(h ^ (end - start).astype(U))
        return out, size


def raw(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts, one text after the other, and where each begins and the last ends; a null is an empty text."""
    if not isinstance(texts, pa.Array):
        texts = pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.large_binary())
    texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1] or b"\0" * 8, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of texts begin and end in their bytes, and each text's number of words."""
    space = np.empty(len(x) + 1, bool)
    space[:-1] = _SPACE.take(x)
    space[-1] = True
    first = np.empty(len(x) + 1, bool)  # a text's first byte follows no word
    first[0], first[1:] = True, space[:-1]
    first[offsets] = True
    start = np.flatnonzero(first & ~space)
    last = space.copy()
    last[offsets] = True
    last[1:] &= ~space[:-1]
    last[0] = False
    end = np.flatnonzero(last)
    return start, end, np.diff(np.searchsorted(start, offsets))


def rolling(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Rabin-Karp hash of every run of n values, modulo 2**64, mixed."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, U)
    out = h[:k].copy()
    for j in range(1, n):
        out *= base
        out += h[j : j + k]
    out ^= out >> U(29)
    out *= U(0xBF58476D1CE4E5B9)
    return out ^ (out >> U(32))


def left(size: np.ndarray) -> np.ndarray:
    """Of every word, how many words its text has from there on."""
    return np.repeat(np.cumsum(size), size) - np.arange(int(size.sum()))


def sliding(x: np.ndarray, n: int, how) -> np.ndarray:
    """Minimum or maximum (``how``) of every n neighbours, by doubling."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = how(out[: len(out) - step], out[step:])
        have += step
    return out
