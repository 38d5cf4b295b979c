"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .common import mix, utf8_bytes

WIDTH = 5

_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: One random word for each byte, A-Z as a-z.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BYTE[65:91] = _BYTE[97:123]
_RATIO = 0x9FB21C651E98DF25


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word between ASCII white space, A-Z as a-z, and each text's count of words.

    A word's hash is a polynomial in its bytes, taken from running sums over the whole block.
    """
    raw, offsets = utf8_bytes(texts)
    full = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], full[:-1]]) if len(raw) else full
    starts = np.flatnonzero(full & (~before | edge[:-1]))
    after = np.concatenate([full[1:], [False]]) if len(raw) else full
    ends = np.flatnonzero(full & (~after | edge[1:])) + 1
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    sizes = ends - starts
    power = np.full(int(sizes.max()) + 1, _RATIO, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    at = np.arange(len(raw)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(raw)]])))
    with np.errstate(over="ignore"):
        terms = _BYTE[raw] * power[np.minimum(at, len(power) - 1)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return mix(sums[ends] - sums[starts] + sizes.astype(np.uint64) * np.uint64(_RATIO)), counts


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """For each text its distinct shingles of ``width`` words, lower-cased A-Z, as sorted hashes.

    Fewer words make one shingle of the whole sequence; no words make none.
    """
    of_word, count = word_hashes(texts)
    ends = np.cumsum(count)
    n = max(len(of_word) - width + 1, 0)
    key = np.full(n, width, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(width):
            key = key * step + of_word[k : k + n]
            key ^= key >> np.uint64(29)
        key = mix(key).view(np.int64)
    sets = []
    for c, end in zip(count.tolist(), ends.tolist()):
        if c >= width:
            found = np.sort(key[end - c : end - width + 1])
            sets.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
            continue
        short = np.full(min(c, 1), c, np.uint64)
        with np.errstate(over="ignore"):
            for h in of_word[end - c : end]:
                short = mix(short * step + h)
        sets.append(short.view(np.int64))
    return sets


def signature(hashes: np.ndarray) -> int:
    """Equal for equal sets; signed 64 bits."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))
