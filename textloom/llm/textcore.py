"""Vectorised text primitives shared by the operators: words, shingles and rolling hashes.

Everything works on a batch of texts laid out as one code-point array, so the
per-character and per-word work is NumPy, never a Python loop.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
_MULTIPLIERS = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB))

_alnum: np.ndarray | None = None
_powers = np.ones(1, U)
_inverse = np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def alnum_table() -> np.ndarray:
    """Per code point: is it a Unicode letter or digit."""
    global _alnum
    if _alnum is None:
        _alnum = code_points(r"[^\W_]+")
    return _alnum


def code_points(pattern: str) -> np.ndarray:
    """Per code point: does the pattern of a run of characters match it."""
    table = np.zeros(0x110000, bool)
    for m in re.finditer(pattern, "".join(map(chr, range(0x110000)))):
        table[m.start() : m.end()] = True
    return table


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n + 1:
        size = max(n + 1, 1 << 16)
        p, q = np.full(size, _BASE, U), np.full(size, _BASE_INV, U)
        p[0] = q[0] = U(1)
        _powers, _inverse = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers, _inverse


def slices(sizes: Sequence[int], limit: int = 1 << 20) -> Iterator[slice]:
    """Cut a batch so that each part has about ``limit`` characters; one long text is a part of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


class Chars:
    """Code points of a batch of texts with prefix sums for Rabin-Karp window hashes; another ``salt`` gives independent hashes."""

    def __init__(self, texts: Sequence[str], salt: int = 0):
        self.code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        n = len(self.code)
        powers, self.inverse = _power_tables(n)
        self.prefix = np.zeros(n + 1, U)
        np.cumsum(mix(self.code.astype(U) + U(0x51ED27 + (salt << 32))) * powers[:n], out=self.prefix[1:])

    def window_hashes(self, width: int) -> np.ndarray:
        """Hash of the ``width`` characters that begin at each position (also across text ends)."""
        n = len(self.code)
        if n < width:
            return np.zeros(0, U)
        return mix((self.prefix[width:] - self.prefix[:-width]) * self.inverse[: n + 1 - width])

    def span_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])


class Words:
    """Words of a batch of texts: maximal runs of letters and digits of the lower-cased text."""

    def __init__(self, texts: Sequence[str]):
        chars = Chars([t.lower() for t in texts])
        n = len(chars.code)
        flag = np.zeros(n + 2, np.int8)
        flag[1:-1] = alnum_table()[chars.code]
        # a separator is assumed between texts
        edge = np.diff(flag)
        start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        inner = chars.start[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        if len(inner):
            split = np.unique(inner[(flag[inner] == 1) & (flag[inner + 1] == 1)])
            if len(split):
                start, end = np.sort(np.concatenate([start, split])), np.sort(np.concatenate([end, split]))
        self.hash = chars.span_hashes(start, end)
        self.text = np.searchsorted(chars.start, start, side="right") - 1
        self.count = np.bincount(self.text, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and word position of every run of ``width`` words inside one text."""
        n = len(self.hash)
        if n < width:
            return np.zeros(0, U), np.zeros(0, np.int64)
        total = np.zeros(n - width + 1, U)
        for j in range(width):
            total = total * _MULTIPLIERS[j % 3] + self.hash[j : n - width + 1 + j]
        where = np.nonzero(self.text[: n - width + 1] == self.text[width - 1 :])[0]
        return mix(total[where]), where


def window_minima(value: np.ndarray, span: int) -> np.ndarray:
    """Positions holding the smallest value of at least one run of ``span`` consecutive values (leftmost of ties is enough)."""
    n = len(value)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= span:
        return np.array([int(np.argmin(value))])
    low = _sliding(value, span, np.minimum)
    pad = np.zeros(span - 1, value.dtype)
    high = _sliding(np.concatenate([pad, low, pad]), span, np.maximum)
    return np.nonzero(high == value)[0]


def _sliding(a: np.ndarray, span: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every run of ``span`` values, by the two-block prefix/suffix method."""
    n = len(a)
    pad = (-n) % span
    filler = np.full(pad, a[-1], a.dtype)
    blocks = np.concatenate([a, filler]).reshape(-1, span)
    pre = op.accumulate(blocks, axis=1).ravel()
    suf = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(suf[: n - span + 1], pre[span - 1 : n])


def signed(h: np.ndarray) -> np.ndarray:
    """Spark has no unsigned 64-bit type."""
    return h.view(np.int64) if h.dtype == U else h.astype(np.int64)
