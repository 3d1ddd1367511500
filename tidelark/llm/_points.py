"""Flat arrays of code points with substring hashes in constant time.

The texts of a batch stand in one array, each preceded by a space.  A running
polynomial sum gives the hash of any substring ``[s, e)`` as
``(P[e] - P[s]) * p**-s`` modulo 2**64, whatever its length, so n-grams of
several orders and whole words cost a few vector operations each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 2**64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}

#: Code points of a chunk; a longer text is cut at white space.
CHUNK = 1 << 17


class Table:
    """A test of characters, held ready for the first 65,536 code points and asked for the others."""

    def __init__(self, test):
        self.test = test
        self.low = np.array([test(chr(i)) for i in range(0x10000)])

    def of(self, codes: np.ndarray) -> np.ndarray:
        out = self.low[np.minimum(codes, 0xFFFF)]
        high = np.flatnonzero(codes > 0xFFFF)
        if len(high):  # few distinct ones occur in a chunk
            seen, at = np.unique(codes[high], return_inverse=True)
            out[high] = np.array([self.test(chr(c)) for c in seen.tolist()])[at]
        return out


LETTER = Table(str.isalpha)
SPACE = Table(str.isspace)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["p"]) < n:
        size = max(n, CHUNK + 4096)
        for k, base in (("p", _P), ("i", _P_INV)):
            a = np.full(size, np.uint64(base), np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["i"][:n]


def _cut(text: str, start: int, size: int) -> int:
    """Where a piece that begins at ``start`` ends: behind white space within ``size``, or else behind the next there is."""
    cut = max(text.rfind(c, start + 1, start + size) for c in " \n\t")
    if cut < 0:
        cut = min((i for c in " \n\t" if (i := text.find(c, start + size)) >= 0), default=len(text) - 1)
    return cut + 1


def _back(text: str, cut: int, low: int, words: int) -> int:
    """Where the last ``words`` runs of letters before ``cut`` begin, or ``low``."""
    i, inside = cut, False
    while i > low:
        letter = text[i - 1].isalpha()
        if inside and not letter:
            words -= 1
            if not words:
                break
        inside = letter
        i -= 1
    return i


def pieces(texts: Iterable[str | None], size: int = CHUNK, words: int = 0) -> Iterator[tuple[list[int], list[str], np.ndarray]]:
    """Runs of about ``size`` code points: numbers of texts, the texts, and how each counts.

    A text longer than ``size`` comes in pieces with the same number that end
    at white space.  With ``words``, a piece begins with so many of the words
    before it, and these come once more by themselves and count -1: sums over
    what lies within so many words, and maxima, are those of the whole text.
    """
    at, run, sign, n = [], [], [], 0
    for i, text in enumerate(texts):
        text = text or ""
        start = 0
        while True:
            end = _cut(text, start, size) if len(text) - start > size else len(text)
            back = _back(text, start, 0, words) if start and words else start
            part = text[back:end]
            if run and n + len(part) > size:
                yield at, run, np.array(sign)
                at, run, sign, n = [], [], [], 0
            for one, much in ((part, 1), (text[back:start], -1)) if back < start else ((part, 1),):
                at.append(i)
                run.append(one)
                sign.append(much)
                n += len(one) + 1
            start = end
            if start >= len(text):
                break
    if run:
        yield at, run, np.array(sign)


class Points:
    """``codes`` of a chunk and ``first[i]``, where text ``i`` begins; a space stands before each text and at the end."""

    def __init__(self, texts: list[str], lower: bool = True):
        whole = " " + " ".join(texts) + " "
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        if lower:
            low = whole.lower()
            if len(low) != len(whole):  # a few letters lower-case to two
                low = " " + " ".join(x := [t.lower() for t in texts]) + " "
                size = np.fromiter(map(len, x), np.int64, len(texts))
            whole = low
        self.codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.first = np.concatenate(([1], 1 + np.cumsum(size + 1)))[:-1]
        self.last = self.first + size

    def hashed(self, codes: np.ndarray | None = None) -> "Points":
        c = (self.codes if codes is None else codes).astype(np.uint64)
        p, self.inverse = _power(len(c) + 1)
        self.sums = np.zeros(len(c) + 1, np.uint64)
        np.cumsum((c + np.uint64(1)) * p[:-1], out=self.sums[1:])
        return self

    def hash(self, s: np.ndarray, e: np.ndarray, bits: int, salt: int = 0) -> np.ndarray:
        """``bits`` bits of the hash of each substring ``[s, e)``."""
        h = (self.sums[e] - self.sums[s]) * self.inverse[s]
        return self._mixed(h, bits, salt)

    def gram(self, n: int, bits: int, salt: int = 0) -> np.ndarray:
        """The hash of ``[i, i + n)`` for every ``i``."""
        h = (self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n]
        return self._mixed(h, bits, salt)

    @staticmethod
    def _mixed(h: np.ndarray, bits: int, salt: int) -> np.ndarray:
        h = h + np.uint64((salt * 0xA0761D6478BD642F) & (2**64 - 1))
        h ^= h >> np.uint64(32)
        h *= _MIX
        return (h >> np.uint64(64 - bits)).astype(np.int64)

    def among(self, table: Table) -> np.ndarray:
        return table.of(self.codes)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; the first and last value are false."""
    d = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return d[::2], d[1::2]
