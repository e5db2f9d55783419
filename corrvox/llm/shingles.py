r"""Word shingles of many texts at once, as 64-bit hashes, in numpy.

Words are ``[^\x20\x09-\x0D]+`` after A-Z are lower-cased. A word's hash is a polynomial over its
bytes, mixed; a shingle's hash is a linear form of its words' hashes, mixed. Two different
shingles share a hash with a probability of about 2**-64.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_COEF = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more number than texts)."""
    raw = [(t or "").encode("utf-8", "ignore") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    buf = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    sep = _SEP[buf]
    first = ~sep
    first[1:] &= sep[:-1]
    at = np.flatnonzero(first)
    n_before = np.searchsorted(at, ends)
    begins = np.concatenate([[0], n_before]).astype(np.int64)
    if not len(at):
        return np.zeros(0, np.uint64), begins
    vals = _BYTE[_FOLD[buf]]
    vals[sep] = 0
    pos = np.arange(len(buf), dtype=np.int64)
    pos -= np.repeat(np.concatenate([[0], at]), np.diff(np.concatenate([[0], at, [len(buf)]])))
    powers = np.full(int(pos.max()) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    vals *= powers[pos]
    return mix(np.add.reduceat(vals, at)), begins


def shingle_hashes(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """For each text the hash of each of its ``k``-word shingles in order; with fewer words, of the whole sequence as one."""
    words, begins = word_hashes(texts)
    if len(words) >= k:
        form = words[: len(words) - k + 1] * _COEF[0]
        for j in range(1, k):
            form += words[j : len(words) - k + 1 + j] * _COEF[j]
        form = mix(form)
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(form[a : b - k + 1])
        elif b > a:
            out.append(mix((words[a:b] * _COEF[k : k + b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def blocks(texts: list[str | None], most: int = 2_000_000):
    """Ranges of ``texts`` of about ``most`` characters (one text at least)."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
