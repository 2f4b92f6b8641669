"""Word shingles as 64-bit integers, computed for a whole text at a time.

Words are runs of bytes without ASCII white space, A-Z lower-cased. A word's hash is
a polynomial over its bytes, taken from prefix sums over the text, and mixed; a
shingle combines the hashes of its words. Two different shingles are taken for one
with chance 2**-64.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

WORDS = 5
#: Bytes that are taken at a time; longer texts are cut between words.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def odd(k: int) -> int:
    """The k-th of a row of odd multipliers."""
    return (_BASE * (2 * k + 1) ^ (0xD1342543DE82EF95 * k)) % (1 << 64) | 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """A spread value for each byte, the same for a letter in both cases."""
    folded = np.arange(256, dtype=np.uint64)
    folded[65:91] += np.uint64(32)
    values = mix(folded + np.uint64(0x632BE59BD9B4E019))
    values[_SPACE] = 0
    return values


@functools.lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    space = _SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    n = max(BLOCK, 1 << (len(raw) - 1).bit_length())
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_byte_values()[raw] * _powers(n, _BASE)[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(n, pow(_BASE, -1, 1 << 64))[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= BLOCK:
        return _word_hashes(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw) and not _SPACE[raw[end]]:
            step = np.flatnonzero(_SPACE[raw[end : end + BLOCK]])
            end = end + int(step[0]) if len(step) else min(len(raw), end + BLOCK)
        parts.append(_word_hashes(raw[at:end]))
        at = end
    return np.concatenate(parts)


def n_words(text: str | None) -> int:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    space = np.concatenate(([True], _SPACE[raw]))
    return int(np.count_nonzero(space[:-1] & ~space[1:]))


def sequence(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the shingles in order; a text with fewer words has its whole sequence
    as one shingle, a text without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(_BASE) + w[k : len(w) - size + 1 + k]
        h ^= h >> np.uint64(29)
    return mix(h)


def distinct(text: str | None, words: int = WORDS) -> np.ndarray:
    return np.unique(sequence(text, words))


def signature(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a sorted set: equal sets, equal signatures."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
