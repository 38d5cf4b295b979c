"""Vector search over product-quantised codes.

Vectors go to the nearest of some centres; what is left of a vector is cut into sub-vectors, and each
sub-vector is stored as the number of the nearest entry of its codebook: a few bytes instead of the
vector. A query makes a table of its distances to all entries, once for each cell it visits, and a
code's distance is a sum of table cells. The vectors themselves are read for re-ranking only.

Every code carries how far it is off its vector, so the triangle inequality bounds the true distance
on both sides. ``nearest_codes`` uses that to be exact by default; with ``refine`` it re-ranks a
fixed number of codes from the nearest cells only, which reads less and may miss.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import vectors as V
from ..functions.base import constant
from ..session import stored


@dataclass(frozen=True)
class CodeIndex:
    """Codes in ``path/codes`` and vectors in ``path/vectors``, both in one folder per cell.

    ``books[s][c]`` is entry ``c`` of the codebook of sub-vector ``s``; ``reach`` the largest distance
    of a cell's vectors from its centre, -1 for an empty cell.
    """

    path: str
    key: str
    vector: str
    centers: tuple[tuple[float, ...], ...]
    reach: tuple[float, ...]
    books: tuple[tuple[tuple[float, ...], ...], ...]


def _fit(rows: DataFrame, column: str, k: int, seed: int) -> list[tuple[float, ...]]:
    """Centres learned from all rows."""
    model = KMeans(k=k, seed=seed, maxIter=10, featuresCol=column).fit(rows.select(column))
    return [tuple(float(x) for x in c) for c in model.clusterCenters()]


def _closest(vector: Column, centers: Sequence[Sequence[float]]) -> Column:
    """Number of the nearest centre; the first of equal ones."""
    gaps = F.transform(constant([list(c) for c in centers], "array<array<double>>"), lambda c: V.squared_distance(vector, c))
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def build_codes(
    df: DataFrame, path: str, key: str = "doc_id", vector: str = "embedding", cells: int = 64, parts: int = 8, entries: int = 256, seed: int = 42
) -> CodeIndex:
    """Learn the centres and the codebooks from all vectors, and write codes and vectors.

    Vectors that are null are left out; all must have one length, a multiple of ``parts``. Writing is
    ranged over cell and key hash, so a cell of a third of all rows is many files.
    """
    spark = df.sparkSession
    data = df.where(F.col(vector).isNotNull()).withColumn("_x", F.transform(vector, lambda x: x.cast("double")))
    lengths = data.select(F.size("_x").alias("n")).distinct().limit(2).collect()
    if not lengths:
        raise ValueError("no vectors to index")
    size = lengths[0]["n"]
    if len(lengths) > 1 or size % parts:
        raise ValueError(f"vectors must have one length that {parts} divides")
    width = size // parts
    centers = _fit(data.withColumn("_v", array_to_vector("_x")), "_v", cells, seed)
    placed = data.withColumn("cell", _closest(F.col("_x"), centers))
    center = lambda c: F.element_at(constant([list(x) for x in centers], "array<array<double>>"), c + 1)
    rest = stored(placed.withColumn("_rest", F.zip_with("_x", center(F.col("cell")), lambda a, b: a - b)).drop("_x"), "code-residuals")
    books = [tuple(_fit(rest.select(array_to_vector(F.slice("_rest", s * width + 1, width)).alias("_v")), "_v", entries, seed + s)) for s in range(parts)]

    coded = rest
    for s, book in enumerate(books):
        coded = coded.withColumn(f"_c{s}", _closest(F.slice("_rest", s * width + 1, width), book))
    code = F.array(*[F.col(f"_c{s}").cast("smallint") for s in range(parts)])
    decoded = F.concat(*[F.element_at(constant([list(e) for e in book], "array<array<double>>"), F.col(f"_c{s}") + 1) for s, book in enumerate(books)])
    coded = coded.select(key, "cell", code.alias("code"), F.sqrt(V.squared_distance(F.col("_rest"), decoded)).alias("off"), V.l2_norm(F.col("_rest")).alias("_far"))
    written = lambda rows, where: rows.repartitionByRange("cell", F.xxhash64(key)).write.mode("errorifexists").partitionBy("cell").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{path}/{where}")
    written(coded, "codes")
    written(rest.drop("_rest"), "vectors")
    far = {r["cell"]: r["r"] for r in spark.read.parquet(f"{path}/codes").groupBy("cell").agg(F.max("_far").alias("r")).collect()}
    return CodeIndex(path, key, vector, tuple(centers), tuple(far.get(c, -1.0) for c in range(len(centers))), tuple(books))


def _tables(index: CodeIndex, query: Sequence[float], cells: Sequence[int]) -> list[list[float]]:
    """For each cell the squared distances of the query's rest to every entry, codebook after codebook."""
    rest = np.asarray(query, float) - np.asarray(index.centers, float)[list(cells)]
    parts = np.split(rest, len(index.books), axis=1)
    return np.concatenate([((p[:, None, :] - np.asarray(b, float)[None]) ** 2).sum(axis=2) for p, b in zip(parts, index.books)], axis=1).tolist()


def code_distances(spark: SparkSession, index: CodeIndex, query: Sequence[float], cells: Sequence[int]) -> DataFrame:
    """``key, cell, _coded, off`` of the codes in some cells: the distance to what each code stands for."""
    starts = np.concatenate([[0], np.cumsum([len(b) for b in index.books])[:-1]]).tolist()
    tables = constant(_tables(index, query, cells), "array<array<double>>")
    codes = spark.read.parquet(f"{index.path}/codes").where(F.col("cell").isin(list(cells)))
    place = F.array_position(F.lit([int(c) for c in cells]), F.col("cell")).cast("int")
    own = F.element_at(tables, place)
    at = F.zip_with("code", F.lit([int(s) for s in starts]), lambda c, s: c.cast("int") + s + 1)
    # The cell's table is bound once a row.
    coded = F.transform(F.array(own), lambda t: F.aggregate(F.transform(at, lambda i: F.element_at(t, i)), F.lit(0.0), lambda a, x: a + x))[0]
    return codes.select(index.key, "cell", F.sqrt(coded).alias("_coded"), "off")


def nearest_codes(
    spark: SparkSession, index: CodeIndex, query: Sequence[float], k: int, probes: int = 4, refine: int | None = None
) -> DataFrame:
    """Nearest rows by squared Euclidean distance, as ``nearest`` gives them.

    Exact by default: the ``k``-th smallest upper bound in the nearest ``probes`` cells says which other
    cells can matter, and the ``k``-th over all of those which vectors do; only these are read. With
    ``refine`` the ``refine * k`` nearest codes of the ``probes`` cells are re-ranked, and no bound is used.
    """
    query = [float(x) for x in query]
    gap = {c: float(np.linalg.norm(np.asarray(index.centers[c]) - query)) for c, r in enumerate(index.reach) if r >= 0}
    order = sorted(gap, key=lambda c: (gap[c], c))
    if refine is not None:
        cells = order[:probes]
        near = code_distances(spark, index, query, cells).orderBy("_coded", index.key).limit(refine * k)
    else:
        upper = F.col("_coded") + F.col("off")
        bound = lambda cells: code_distances(spark, index, query, cells).select(upper.alias("u")).orderBy("u").limit(k).agg(F.count("*"), F.max("u")).first()
        slack = lambda d: d * (1 + 1e-9) + 1e-9
        first = bound(order[:probes])
        cells = order if first[0] < k else [c for c in order if gap[c] - index.reach[c] <= slack(first[1])]
        second = bound(cells)
        near = code_distances(spark, index, query, cells)
        if second[0] >= k:
            near = near.where(F.col("_coded") - F.col("off") <= slack(second[1]))
    vectors = spark.read.parquet(f"{index.path}/vectors").where(F.col("cell").isin(cells))
    found = vectors.join(near.select(index.key, "cell"), [index.key, "cell"], "left_semi")
    return found.withColumn("_distance", V.distance_to(F.col(index.vector), query)).orderBy("_distance", index.key).limit(k).drop(index.vector, "cell")
