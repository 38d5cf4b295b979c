"""Vector columns: hashed features, norms and distances, computed in double."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from .base import let, literal_array

_ZERO = 0.0
Hasher = Callable[[Column], Column]


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(_ZERO), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return let(
        vector,
        lambda v: let(
            l2_norm(v),
            lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))),
        ),
    )


def squared_distance(vector: Column, query: Column) -> Column:
    """Squared Euclidean distance of a vector column to another vector.

    Subtracting in one pass and squaring in the other halves the work of a lambda that does
    both, for any number of dimensions.
    """
    gaps = F.zip_with(vector, query, lambda a, b: a.cast("double") - b.cast("double"))
    return F.aggregate(gaps, F.lit(_ZERO), lambda acc, x: acc + x * x)


def distance_to(vector: Column, query: Sequence[float]) -> Column:
    return squared_distance(vector, literal_array([float(x) for x in query]))


def buckets(tokens: Column, dim: int, hasher: Hasher = F.xxhash64) -> Column:
    """Bucket number of every token. The hash is the same in every process and every run."""
    return F.transform(tokens, lambda token: F.pmod(hasher(token), F.lit(dim)).cast("int"))


def _runs(sorted_buckets: Column) -> Column:
    """``array<struct<bucket, n>>`` of a sorted bucket array: one entry per bucket in use.

    Only the positions where a run begins are looked for, so the one pass over all tokens
    allocates nothing; what follows is as short as the number of buckets.
    """
    first = lambda s: F.filter(
        F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
    )
    lengths = lambda s, starts: F.transform(
        starts,
        lambda p, j: F.struct(
            F.get(s, p).alias("bucket"), (F.coalesce(F.get(starts, j + 1), F.size(s)) - p).alias("n")
        ),
    )
    return let(
        sorted_buckets,
        lambda s: F.when(F.size(s) > 0, let(first(s), lambda starts: lengths(s, starts))).otherwise(
            F.array().cast("array<struct<bucket:int,n:int>>")
        ),
    )


def hashed_bag(tokens: Column, dim: int, hasher: Hasher = F.xxhash64) -> Column:
    """Unit vector of token counts per hash bucket."""

    def counts(runs: Column) -> Column:
        return let(
            F.map_from_entries(runs),
            lambda m: F.transform(
                F.sequence(F.lit(0), F.lit(dim - 1)),
                lambda b: F.coalesce(F.try_element_at(m, b), F.lit(0)).cast("double"),
            ),
        )

    return l2_normalize(counts(_runs(F.sort_array(buckets(tokens, dim, hasher)))))


def bag_cosine(
    tokens: Column, query_counts: Sequence[float], dim: int, hasher: Hasher = F.xxhash64
) -> Column:
    """Cosine between the hashed bag of a token array and a query bag given by its counts."""
    query = literal_array([float(c) for c in query_counts])
    query_norm = sum(c * c for c in query_counts) ** 0.5
    if query_norm == 0:
        return F.lit(0.0)

    def cosine(runs: Column) -> Column:
        square = F.aggregate(runs, F.lit(_ZERO), lambda acc, r: acc + r["n"].cast("double") * r["n"])
        dot = F.aggregate(runs, F.lit(_ZERO), lambda acc, r: acc + r["n"] * F.element_at(query, r["bucket"] + 1))
        return F.when(F.size(runs) > 0, dot / (F.sqrt(square) * F.lit(query_norm))).otherwise(F.lit(0.0))

    return let(_runs(F.sort_array(buckets(tokens, dim, hasher))), cosine)


def hash_embedding(text: Column, dim: int = 128) -> Column:
    """Unit vector from the 32 digest bytes of the text, padded with zeros; zeros for empty text."""
    zeros = F.array_repeat(F.lit(_ZERO), dim)
    kept = min(dim, 32)

    def from_digest(hexed: Column) -> Column:
        digits = F.transform(
            F.sequence(F.lit(0), F.lit(kept - 1)),
            lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255.0,
        )
        return F.concat(digits, F.array_repeat(F.lit(_ZERO), dim - kept)) if dim > kept else digits

    data = F.coalesce(text, F.lit("")).cast("binary")
    vector = l2_normalize(let(F.sha2(data, 256), from_digest))
    return F.when(F.length(data) == 0, zeros).otherwise(vector)
