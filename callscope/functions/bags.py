"""Character bigrams of whole texts as counts, in Arrow batches.

The column functions of ``text`` and ``vectors`` make an array of every bigram and walk it in
lambdas, which Spark interprets. Here a block of texts is one array of code points: pairs are
numbers, equal pairs of a text meet in one sort, and a pair is hashed once a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf

from ..packs import BIGRAM_NOISE

_BLOCK = 1 << 20
_ALONE = (1 << 21) - 1  # no code point: stands second where a text is a single character
_PAIR = (1 << 42) - 1
_SEED = 42  # of Spark's xxhash64

#: Hash of pairs of code points, as arrays; the second of a text that is a single character is 0.
PairHash = Callable[[np.ndarray, np.ndarray], np.ndarray]


def cleaned(text: Column, noise: str = BIGRAM_NOISE) -> Column:
    return F.regexp_replace(text, f"(?U)[{noise}]+", "")


def _number(pair: str) -> int:
    return ord(pair[0]) << 21 | (ord(pair[1]) if len(pair) > 1 else _ALONE)


def _pair_text(number: int) -> str:
    second = number & _ALONE
    return chr(number >> 21) + ("" if second == _ALONE else chr(second))


def _bucket(number: int, dim: int) -> int:
    h = xxhash.xxh64_intdigest(_pair_text(number).encode(), _SEED)
    return (h - (1 << 64) if h >> 63 else h) % dim


def pair_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and count of every different bigram of every text."""
    chars = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(t for t in texts.to_pylist() if t).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(chars)), chars)
    second = np.append(points[1:], 0)[: len(points)]
    ends = np.cumsum(chars)[chars > 0] - 1
    second[ends] = -1
    second[(np.cumsum(chars) - 1)[chars == 1]] = _ALONE
    whole = second >= 0
    pairs, counts = np.unique(row[whole] << 42 | points[whole] << 21 | second[whole], return_counts=True)
    return pairs >> 42, pairs & _PAIR, counts


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _BLOCK, side="right")))
        yield texts.slice(low, high - low)
        low = high


class _Buckets:
    """Hash buckets of pairs: by a hash of arrays, or by xxhash64 and then remembered by the worker."""

    def __init__(self, dim: int, hashed: PairHash | None = None) -> None:
        self.dim, self.known, self.hashed = dim, {}, hashed

    def of(self, pairs: np.ndarray) -> np.ndarray:
        if self.hashed is not None:
            second = pairs & _ALONE
            return self.hashed(pairs >> 21, np.where(second == _ALONE, 0, second)) % self.dim
        different, back = np.unique(pairs, return_inverse=True)
        if len(self.known) > 1_000_000:
            self.known.clear()
        found = np.zeros(len(different), np.int64)
        for i, p in enumerate(different.tolist()):
            b = self.known.get(p)
            if b is None:
                b = self.known[p] = _bucket(p, self.dim)
            found[i] = b
        return found[back]


def _bag(buckets: _Buckets, row: np.ndarray, pair: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row * buckets.dim + buckets.of(pair), count, rows * buckets.dim).astype(float).reshape(rows, buckets.dim)


def _unit(bag: np.ndarray) -> np.ndarray:
    norm = np.sqrt((bag * bag).sum(axis=1, keepdims=True))
    return np.divide(bag, norm, out=bag, where=norm > 0)


def _vectors(bag: np.ndarray) -> pa.ListArray:
    rows, dim = bag.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * dim), pa.array(bag.ravel()))


def bigram_bag(text: Column, dim: int, hashed: PairHash | None = None) -> Column:
    """Unit vector of bigram counts per bucket, by ``xxhash64`` or ``hashed``: ``hashed_bag(bigrams(text), dim)``."""

    @arrow_udf("array<double>")
    def bags(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = _Buckets(dim, hashed)
        for batch in batches:
            for block in _blocks(batch):
                yield _vectors(_unit(_bag(buckets, *pair_counts(block), len(block))))

    return bags(cleaned(text))


def bigram_shares(text: Column, dim: int, hashed: PairHash | None = None) -> Column:
    """``struct<bag, pairs>``: the bag and, of every different bigram of the text, ``bigram, share``, its bucket's part in the bag."""

    @arrow_udf("struct<bag:array<double>,pairs:array<struct<bigram:string,share:double>>>")
    def shares(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = _Buckets(dim, hashed)
        for batch in batches:
            for block in _blocks(batch):
                row, pair, count = pair_counts(block)
                bag = _unit(_bag(buckets, row, pair, count, len(block)))
                different, back = np.unique(pair, return_inverse=True)
                names = pa.array([_pair_text(p) for p in different.tolist()], pa.string()).take(pa.array(back))
                share = bag[row, buckets.of(pair)]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(block)))]).astype(np.int32)
                pairs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([names, pa.array(share)], ["bigram", "share"]))
                yield pa.StructArray.from_arrays([_vectors(bag), pairs], ["bag", "pairs"])

    return shares(cleaned(text))


def bigram_match(text: Column, wanted: Sequence[str], counts: Sequence[float], dim: int, hashed: PairHash | None = None) -> Column:
    """``struct<size, common, cosine>`` of a text with a query: different bigrams of the text, those
    among ``wanted``, and the cosine of the hashed bags, ``counts`` being the query's."""
    asked = np.array(sorted(map(_number, wanted)), np.int64)
    query = np.array(counts, float)

    @arrow_udf("struct<size:int,common:int,cosine:double>")
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = _Buckets(dim, hashed)
        for batch in batches:
            size, common, cosine = [], [], []
            for block in _blocks(batch):
                row, pair, count = pair_counts(block)
                size.append(np.bincount(row, minlength=len(block)))
                common.append(np.bincount(row[np.isin(pair, asked)], minlength=len(block)))
                bag = _bag(buckets, row, pair, count, len(block))
                norm = np.sqrt((bag * bag).sum(axis=1)) * np.sqrt((query * query).sum())
                cosine.append(np.divide(bag @ query, norm, out=np.zeros(len(block)), where=norm > 0))
            empty = [np.zeros(0)]
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate(size or empty).astype(np.int32)), pa.array(np.concatenate(common or empty).astype(np.int32)), pa.array(np.concatenate(cosine or empty))],
                ["size", "common", "cosine"],
            )

    return match(cleaned(text))
