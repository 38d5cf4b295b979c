"""Similarity search over texts and vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors as V
from ..functions.bags import PairHash, bigram_match, bigram_shares
from ..functions.base import blank_to_null, constant, let, strip
from ..functions.text import bigrams
from ..session import small_batches, stored

SEARCH_DIM = 256


def search_text(summary: Column, transcript: Column) -> Column:
    return F.coalesce(blank_to_null(strip(summary)), strip(transcript), F.lit(""))


def _in_batches(hasher: V.Hasher) -> tuple[bool, PairHash | None]:
    """Whether a hash is known in Arrow batches as well: the default, or one that has its twin in ``pairs``."""
    twin = getattr(hasher, "pairs", None)
    return hasher is F.xxhash64 or twin is not None, twin


def bigram_scores(
    df: DataFrame, query: str, text: Column, dim: int = SEARCH_DIM, hasher: V.Hasher = F.xxhash64
) -> DataFrame:
    """Add ``_jaccard`` and ``_similarity`` of a text to the query; both 0 without a common bigram.

    Bigrams are counted in Arrow batches; another hash than the default is a column function and
    keeps the work in column functions, which are several times slower, unless its attribute ``pairs`` gives
    the same hash of arrays of code points (``bags.PairHash``).
    """
    spark = df.sparkSession
    small_batches(spark)
    asked = spark.range(1).select(bigrams(F.lit(query)).alias("b"), V.buckets(bigrams(F.lit(query)), dim, hasher).alias("n")).first()
    wanted = sorted(set(asked["b"]))
    if not wanted:
        return df.withColumns({"_jaccard": F.lit(0.0), "_similarity": F.lit(0.0)})
    counts = [0.0] * dim
    for bucket in asked["n"]:
        counts[bucket] += 1.0
    fast, twin = _in_batches(hasher)
    if fast:
        matched = df.withColumn("_match", bigram_match(text, wanted, counts, dim, twin))
        share = F.col("_match.common") / (F.col("_match.size") + len(wanted) - F.col("_match.common"))
        both = F.when(F.col("_match.common") > 0, F.lit(0.85) * share + F.lit(0.15) * F.col("_match.cosine")).otherwise(F.lit(0.0))
        return matched.withColumns({"_jaccard": share, "_similarity": both}).drop("_match")
    query_set = constant(wanted, "array<string>")

    def score(tokens: Column) -> Column:
        return let(
            F.array_distinct(tokens),
            lambda seen: let(
                F.size(F.array_intersect(seen, query_set)),
                lambda common: let(
                    common / (F.size(seen) + len(wanted) - common),
                    lambda jaccard: F.struct(
                        jaccard.alias("_jaccard"),
                        F.when(
                            common > 0, F.lit(0.85) * jaccard + F.lit(0.15) * V.bag_cosine(tokens, counts, dim, hasher)
                        ).otherwise(F.lit(0.0)).alias("_similarity"),
                    ),
                ),
            ),
        )

    scored = df.withColumn("_scores", let(bigrams(text), score))
    return scored.withColumns(
        {"_jaccard": F.col("_scores._jaccard"), "_similarity": F.col("_scores._similarity")}
    ).drop("_scores")


def bigram_search(
    df: DataFrame, query: str, k: int, floor: float, key: str = "call_id", text: Column | None = None, hasher: V.Hasher = F.xxhash64,
) -> DataFrame:
    """Best matches of a query text. One narrow pass and a top-k; no text leaves its task."""
    source = search_text(F.col("summary"), F.col("transcript")) if text is None else text
    scored = bigram_scores(df, query, source, hasher=hasher)
    # The floor is applied to the k best: below the limit it would run the scoring twice.
    best = scored.orderBy(F.col("_similarity").desc(), F.col(key)).limit(k)
    return best.where((F.col("_similarity") >= floor) & (F.col("_jaccard") > 0))


#: Postings, and texts, that one folder of an index is meant to hold.
POSTINGS_A_FOLDER = 4_000_000
TEXTS_A_FOLDER = 100_000
_MOST_FOLDERS = 4096
#: Bands of text sizes, so many for each doubling.
_BANDS = 2


def _folders(rows: int, each: int) -> int:
    return min(_MOST_FOLDERS, 1 << max(3, (rows // each).bit_length()))


def _by_key(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def build_postings(df: DataFrame, path: str, key: str, text: Column, dim: int = SEARCH_DIM, hasher: V.Hasher = F.xxhash64) -> None:
    """Index of texts for repeated bigram search, written once.

    ``postings`` has a row for each different bigram of a text with what bounds the text's score:
    its number of different bigrams and its share in the bag's bucket of that bigram. Folders are
    bands of that number, and within them hash buckets of bigrams: a band is a block with a largest
    possible score. Rows are ranged over band, bucket, bigram and key, so that a hot bigram is many
    files. ``texts`` has the whole bags in folders by hash of the key, with a bloom filter on it.
    """
    small_batches(df.sparkSession)
    fast, twin = _in_batches(hasher)
    if fast:
        whole = df.select(key, bigram_shares(text, dim, twin).alias("_s")).select(key, "_s.bag", "_s.pairs")
    else:
        bags = df.select(key, F.array_distinct(bigrams(text)).alias("_b"), V.hashed_bag(bigrams(text), dim, hasher).alias("bag"))
        share = lambda b: F.element_at("bag", F.pmod(hasher(b), F.lit(dim)).cast("int") + 1)
        whole = bags.select(key, "bag", F.transform("_b", lambda b: F.struct(b.alias("bigram"), share(b).alias("share"))).alias("pairs"))
    rows = stored(whole.withColumn("size", F.size("pairs")), "posting-rows")
    sized = rows.where("size > 0").withColumn("band", F.floor(F.log2("size") * _BANDS).cast("int"))
    bands = sized.groupBy("band").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count("*").alias("texts"), F.sum("size").alias("postings"), F.max(key).alias("last_key"))
    found = bands.agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("postings"), F.lit(0))).first()
    parts, buckets = _folders(found[0], TEXTS_A_FOLDER), _folders(found[1], POSTINGS_A_FOLDER)
    bands.withColumns({"parts": F.lit(parts), "buckets": F.lit(buckets)}).write.parquet(f"{path}/bands")

    texts = sized.select(key, "size", "bag", _by_key(key, parts).alias("part"))
    texts.repartitionByRange("part", key).sortWithinPartitions("part", key).write.partitionBy("part").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{path}/texts")
    # The bag stays behind: only a bigram's own share goes with it.
    postings = sized.select(key, "size", "band", F.inline("pairs"))
    postings = postings.withColumn("bucket", F.pmod(F.xxhash64("bigram"), F.lit(buckets)).cast("int"))
    order = ("band", "bucket", "bigram", key)
    postings.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("band", "bucket").parquet(f"{path}/postings")


@dataclass(frozen=True)
class PostingSearch:
    """The rows found, and what was read for them: bands, buckets of each, and folders of texts."""

    rows: DataFrame
    bands: tuple[int, ...]
    buckets: tuple[int, ...]
    parts: tuple[int, ...]


def search_postings(
    spark, path: str, query: str, k: int, floor: float, key: str = "call_id", dim: int = SEARCH_DIM, hasher: V.Hasher = F.xxhash64
) -> DataFrame:
    """``bigram_search`` over an index; the same rows, see ``posting_search``."""
    return posting_search(spark, path, query, k, floor, key, dim, hasher).rows


def posting_search(
    spark, path: str, query: str, k: int, floor: float, key: str = "call_id", dim: int = SEARCH_DIM, hasher: V.Hasher = F.xxhash64
) -> PostingSearch:
    """The ``k`` best texts, exactly, from as few folders as bounds allow.

    Two sets share at most the smaller one's part of the larger, so a band's sizes bound its scores.
    Bands are read best first, twice as many each round, until none left can reach the ``k``-th best
    lower bound. A text's own bounds come from its postings: the Jaccard part exactly, of the cosine
    what is seen, and for the rest the product of the lengths that are left (Cauchy-Schwarz). Bags are
    read only of texts whose upper bound reaches the ``k``-th lower one, from the folders of their keys.
    """
    one = spark.range(1).select(bigrams(F.lit(query)).alias("b"))
    place = lambda b: F.pmod(hasher(b), F.lit(dim)).cast("int")
    asked = one.select(F.array_distinct("b").alias("b"), F.transform(F.array_distinct("b"), place).alias("h"), F.transform(F.array_distinct("b"), lambda b: F.xxhash64(b)).alias("x"), V.hashed_bag(F.col("b"), dim, hasher).alias("v")).first()
    table = spark.read.parquet(f"{path}/bands")
    bands = table.collect()  # a row for each band: two for each doubling of a size
    n, vector = len(asked["b"]), list(asked["v"])
    empty = lambda: table.limit(0).select(F.col("last_key").alias(key), F.lit(0.0).alias("_jaccard"), F.lit(0.0).alias("_similarity"))
    if not n or not bands:
        return PostingSearch(empty(), (), (), ())
    parts, buckets = bands[0]["parts"], sorted({x % bands[0]["buckets"] for x in asked["x"]})
    largest = {r["band"]: 0.85 * (1.0 if r["least"] <= n <= r["most"] else r["most"] / n if r["most"] < n else n / r["least"]) + 0.15 for r in bands}
    order = sorted(largest, key=lambda b: (-largest[b], b))
    weights = spark.createDataFrame([(b, h, float(vector[h])) for b, h in zip(asked["b"], asked["h"])], "bigram string, _h int, _q double")
    postings = spark.read.parquet(f"{path}/postings")

    read: list[int] = []
    bounds, kth = None, floor
    while len(read) < len(order) and largest[order[len(read)]] >= kth - 1e-9:
        some = order[len(read) : 2 * len(read) + 2]
        some = [b for b in some if largest[b] >= kth - 1e-9]
        read += some
        hits = postings.where(F.col("band").isin(some) & F.col("bucket").isin(buckets) & F.col("bigram").isin(asked["b"]))
        # A row for each bigram of the query: dealt by text once, for both steps.
        hits = hits.join(F.broadcast(weights), "bigram").select(key, "size", "share", "_h", "_q").repartition(key)
        cells = hits.groupBy(key, "_h").agg(F.count("*").alias("c"), F.first("size").alias("size"), F.first("share").alias("s"), F.first("_q").alias("q"))
        sums = cells.groupBy(key).agg(F.sum("c").alias("_common"), F.first("size").alias("size"), F.sum(F.col("s") * F.col("q")).alias("dot"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("q") * F.col("q")).alias("qq"))
        jaccard = F.col("_common") / (F.col("size") + n - F.col("_common"))
        rest = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("ss")) * F.greatest(F.lit(0.0), 1 - F.col("qq")))
        scored = sums.select(key, jaccard.alias("_jaccard"), (0.85 * jaccard + 0.15 * F.col("dot")).alias("_low"), (0.85 * jaccard + 0.15 * F.least(F.lit(1.0), F.col("dot") + rest)).alias("_high"))
        scored = stored(scored.where(F.col("_high") >= kth - 1e-9), "posting-bounds")
        bounds = scored if bounds is None else bounds.union(scored)
        best = bounds.orderBy(F.col("_low").desc()).limit(k).agg(F.count("*"), F.min("_low")).first()
        kth = max(floor, best[1]) if best[0] >= k else floor
    if bounds is None:
        return PostingSearch(empty(), (), tuple(buckets), ())
    near = bounds.where(F.col("_high") >= kth - 1e-9)
    needed = sorted(r[0] for r in near.select(_by_key(key, parts)).distinct().collect())  # a number for each folder at most
    texts = spark.read.parquet(f"{path}/texts").where(F.col("part").isin(needed)).select(key, "bag")
    # Both bags have length one, so their product is the cosine.
    dot = F.aggregate(F.zip_with("bag", constant(vector, "array<double>"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = near.join(texts, key).select(key, "_jaccard", (F.lit(0.85) * F.col("_jaccard") + F.lit(0.15) * dot).alias("_similarity"))
    rows = scored.orderBy(F.col("_similarity").desc(), F.col(key)).limit(k).where((F.col("_similarity") >= floor) & (F.col("_jaccard") > 0))
    return PostingSearch(rows, tuple(read), tuple(buckets), tuple(needed))


def _vector_of(df: DataFrame, key: str, value: object, vector: str) -> list[float]:
    if vector not in df.columns:
        raise ValueError(f"no column {vector}; run the embedding step first")
    row = df.where(F.col(key) == F.lit(value)).select(vector).first()
    if row is None or row[0] is None:
        raise LookupError(f"no vector for {key} = {value!r}")
    return [float(x) for x in row[0]]


def nearest(
    df: DataFrame,
    k: int,
    key: str = "doc_id",
    vector: str = "embedding",
    like: object | None = None,
    query: Sequence[float] | None = None,
    where: str | Column | None = None,
    include_self: bool = False,
    postfilter: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Exact nearest rows by squared Euclidean distance, as ``_distance``.

    The query is a vector or the key of a row (``like``), which is left out of its own
    result unless ``include_self``. The predicate applies before the ranking; with
    ``postfilter`` after it, which may leave fewer than k rows.
    """
    if (like is None) == (query is None):
        raise ValueError("give either like or query")
    target = list(query) if query is not None else _vector_of(df, key, like, vector)
    pool = df.where(F.col(vector).isNotNull())
    if where is not None and not postfilter:
        pool = pool.where(where)
    if like is not None and not include_self:
        pool = pool.where(F.col(key) != F.lit(like))
    best = (
        pool.withColumn("_distance", V.distance_to(F.col(vector), target))
        .orderBy("_distance", key)
        .limit(k)
    )
    if where is not None and postfilter:
        best = best.where(where)
    return best.select(*columns) if columns else best.drop(vector)


@dataclass(frozen=True)
class CellIndex:
    """Vectors written in one folder per cell, with each cell's centre and radius."""

    path: str
    key: str
    vector: str
    centers: tuple[tuple[float, ...], ...]
    radii: tuple[float, ...]

    def _gap(self, cell: int, query: Sequence[float]) -> tuple[float, float]:
        reach = sum((a - b) ** 2 for a, b in zip(self.centers[cell], query)) ** 0.5
        return reach, max(0.0, reach - self.radii[cell])


def build_cells(
    df: DataFrame, path: str, key: str = "doc_id", vector: str = "embedding",
    cells: int = 64, seed: int = 42,
) -> CellIndex:
    """Cluster the vectors and write them partitioned by cell.

    The centres are learned from all rows, and every row is written. Writing is ranged over cell and key hash, so a cell with a third of
    all rows is spread over many files and a small one fills few.
    """
    data = df.where(F.col(vector).isNotNull()).withColumn("_vec", array_to_vector(vector))
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="_vec", predictionCol="cell").fit(data.select("_vec"))
    centers = tuple(tuple(float(x) for x in c) for c in model.clusterCenters())
    assigned = model.transform(data).drop("_vec")
    ranged = assigned.repartitionByRange("cell", F.xxhash64(key))
    ranged.write.mode("errorifexists").partitionBy("cell").parquet(path)
    written = df.sparkSession.read.parquet(path)
    table = constant(centers, "array<array<double>>")
    reach = F.sqrt(V.squared_distance(F.col(vector), F.element_at(table, F.col("cell") + 1)))
    found = {r["cell"]: r["r"] for r in written.groupBy("cell").agg(F.max(reach).alias("r")).collect()}
    return CellIndex(path, key, vector, centers, tuple(found.get(i, -1.0) for i in range(len(centers))))


def nearest_cells(
    spark, index: CellIndex, query: Sequence[float], k: int, probes: int = 4
) -> DataFrame:
    """Exact nearest rows, reading only the cells that can hold one.

    The nearest cells give a k-th distance; by the triangle inequality a cell whose centre is
    farther than that plus its radius holds nothing closer and its folder is not read.
    """
    live = [i for i, r in enumerate(index.radii) if r >= 0]
    order = sorted(live, key=lambda i: index._gap(i, query)[0])
    table = spark.read.parquet(index.path)
    search = lambda cells: nearest(
        table.where(F.col("cell").isin(cells)), key=index.key, vector=index.vector, query=query, k=k
    )
    first = search(order[:probes]).select("_distance").collect()
    if len(first) < k:
        return search(order).drop("cell")
    bound = max(r[0] for r in first) ** 0.5 * (1 + 1e-9) + 1e-9
    return search([i for i in order if index._gap(i, query)[1] <= bound]).drop("cell")
