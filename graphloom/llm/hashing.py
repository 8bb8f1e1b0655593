"""Words of many texts as hashes, in numpy: one pass over the bytes of a whole batch."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public SplitMix64 constants): every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(size, b)), dtype=np.uint64) for b in (_ODD, inverse)]
    return _powers[0], _powers[1]


class Batch:
    """Bytes, words and word hashes of a list of texts; A-Z are lower-cased unless ``keep_case``.

    ``begin`` and ``end`` are the byte places of the words, ``doc`` the text of each word, ``words``
    the number of words of each text, and ``hash`` a 64-bit hash of each word's bytes. Bytes in ``gaps`` part words too.
    """

    def __init__(self, texts: list[str], keep_case: bool = False, gaps: bytes = b""):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts = np.append(0, np.cumsum(self.sizes + 1))[:-1]
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        self.data = data if keep_case else _LOWER[data]
        if gaps:
            table = np.arange(256, dtype=np.uint8)
            table[list(gaps)] = 32
            self.data = table[self.data]
        gap = np.append(True, _BLANK[self.data]) if len(data) else np.array([True])
        gap = np.append(gap, True)
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.begin, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.starts, self.begin, "right") - 1
        self.words = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            up, down = _power(len(self.data) + 1)
            total = np.append(np.uint64(0), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], dtype=np.uint64))
            self._hash = mixed((total[self.end] - total[self.begin]) * down[self.begin])
        return self._hash

    def shingles(self, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, first word) of every run of ``n`` words inside a text; with ``short``, a text of fewer
        words gives its whole word sequence as one."""
        h, k = self.hash, len(self.hash)
        first = np.append(0, np.cumsum(self.words))[:-1]
        if k >= n:
            value = np.zeros(k - n + 1, np.uint64)
            for i in range(n):
                value = mixed(value * _ODD + h[i : k - n + 1 + i])
            ok = np.flatnonzero(self.doc[: k - n + 1] == self.doc[n - 1 :])
            value, doc, at = value[ok], self.doc[ok], ok
        else:
            value, doc, at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if short:
            few = np.flatnonzero((self.words > 0) & (self.words < n))
            extra = np.zeros(len(few), np.uint64)
            for i in range(n - 1):
                have = self.words[few] > i
                at_i = np.minimum(first[few] + i, max(k - 1, 0))
                extra = np.where(have, mixed(extra * _ODD + h[at_i]), extra)
            extra = mixed(extra + self.words[few].astype(np.uint64))
            value, doc, at = np.concatenate([value, extra]), np.concatenate([doc, few]), np.concatenate([at, first[few]])
        return value, doc, at


def per_text_sets(value: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, sorted, in one flat array, and how many each text has."""
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[keep], np.bincount(doc[keep], minlength=texts).astype(np.int64)
