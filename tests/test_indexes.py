"""Posting search with bounds, product-quantised codes, quantile sketches, percentiles that are not finite."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.functions import vectors as V
from callscope.functions.bags import bigram_bag, pair_counts
from callscope.functions.text import bigrams
from callscope.operators import aggregates as A, quantised as P, similarity as N
from callscope.session import scratch_dir

WORDS = "the quick brown fox jumps over lazy dogs näh 日本語 while some more words stand here".split()


def texts(spark, n=400, seed=3):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choices(WORDS, k=int(r.lognormvariate(2, 1)) + 1))) for i in range(n)]
    return spark.createDataFrame([*rows, (9001, None), (9002, ""), (9003, "x"), (9004, "1 2"), (9005, rows[3][1]), (9006, "ab" * 4000)], "call_id long, t string").repartition(4)


def test_bags_equal_the_column_functions(spark):
    df = texts(spark, 120).select("call_id", bigram_bag(F.col("t"), 16).alias("a"), V.hashed_bag(bigrams(F.col("t")), 16).alias("b"), F.size(bigrams(F.col("t"))).alias("n"))
    for r in df.collect():
        assert r["a"] == pytest.approx(r["b"], abs=1e-12), r["call_id"]
        assert (sum(r["a"]) > 0) == (r["n"] > 0)


def test_pair_counts():
    import pyarrow as pa

    row, pair, count = pair_counts(pa.array(["aaa", None, "", "x", "😀é"]))
    assert row.tolist() == [0, 3, 4] and count.tolist() == [2, 1, 1]
    assert [len(x) for x in pair_counts(pa.array(["", None, "  "[:0]]))] == [0, 0, 0] and [len(x) for x in pair_counts(pa.array([], pa.string()))] == [0, 0, 0]
    assert pair.tolist() == [97 << 21 | 97, 120 << 21 | (1 << 21) - 1, 0x1F600 << 21 | 0xE9]


@pytest.mark.parametrize("query", ["the quick brown fox", "x", "näh 日本語", "zzzz qqqq", "", "ab"])
def test_scan_and_slow_path_agree(spark, query):
    df = texts(spark, 150)
    slow = lambda c: F.xxhash64(c)  # noqa: E731  the same hash, but not known to be the default
    a = {r["call_id"]: (r["_jaccard"], r["_similarity"]) for r in N.bigram_scores(df, query, F.col("t")).collect()}
    b = {r["call_id"]: (r["_jaccard"], r["_similarity"]) for r in N.bigram_scores(df, query, F.col("t"), hasher=slow).collect()}
    assert a.keys() == b.keys()
    for i in a:
        assert a[i] == pytest.approx(b[i], abs=1e-12)


def test_a_hash_with_a_twin_stays_in_batches(spark):
    from callscope.queries.search import _letter_hash

    df = texts(spark, 150)
    slow = lambda c: _letter_hash(c)  # noqa: E731  without the twin
    fast = N.bigram_scores(df, "the quick x", F.col("t"), hasher=_letter_hash)
    assert "ArrowEvalPython" in fast._jdf.queryExecution().executedPlan().toString()
    scores = lambda rows: {r["call_id"]: (r["_jaccard"], r["_similarity"]) for r in rows.collect()}
    a, b = scores(fast), scores(N.bigram_scores(df, "the quick x", F.col("t"), hasher=slow))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-12) for i in a)


def test_postings_are_alike_by_either_way(spark):
    from callscope.queries.search import _letter_hash

    found = []
    for hasher in (_letter_hash, lambda c: _letter_hash(c)):
        path = scratch_dir(spark, "posting-ways")
        N.build_postings(texts(spark, 60), path, "call_id", F.col("t"), hasher=hasher)
        rows = spark.read.parquet(f"{path}/postings").select("call_id", "size", "band", "bucket", "bigram", F.round("share", 9)).collect()
        bags = spark.read.parquet(f"{path}/texts").select("call_id", "size", F.transform("bag", lambda x: F.round(x, 9))).collect()
        found.append((sorted(map(tuple, rows)), sorted(map(tuple, bags))))
    assert found[0] == found[1] and found[0][0]


@pytest.fixture(scope="module")
def postings(spark):
    path = scratch_dir(spark, "posting-test")
    N.build_postings(texts(spark), path, "call_id", F.col("t"))
    return path


@pytest.mark.parametrize("query,k,floor", [("the quick brown fox jumps", 5, 0.05), ("some more words stand here while lazy dogs jump", 1, 0.05), ("日本語", 50, 0.0), ("the", 10_000, 0.0), ("abab", 3, 0.5), ("zzzz", 5, 0.0), ("", 5, 0.0)])
def test_postings_equal_the_scan(spark, postings, query, k, floor):
    found = [(r["call_id"], round(r["_similarity"], 9)) for r in N.search_postings(spark, postings, query, k, floor).collect()]
    wanted = [(r["call_id"], round(r["_similarity"], 9)) for r in N.bigram_search(texts(spark), query, k, floor, "call_id", F.col("t")).collect()]
    assert found == wanted


def folder_bytes(spark, path, keep):
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").collect()
    return sum(r["length"] for r in rows if all(f"/{k}={v}/" in r["path"] or v is None for k, v in [(k, next((x for x in vs if f"/{k}={x}/" in r["path"]), "absent")) for k, vs in keep.items()]))


def test_fewer_results_read_fewer_bytes(spark, postings):
    read = []
    for k in (1, 2000):
        s = N.posting_search(spark, postings, "the quick brown fox jumps over lazy dogs", k, 0.05)
        size = folder_bytes(spark, f"{postings}/postings", {"band": s.bands, "bucket": s.buckets}) + folder_bytes(spark, f"{postings}/texts", {"part": s.parts})
        read.append((len(s.bands), len(s.parts), size))
    assert read[0][0] < read[1][0] and read[0][1] < read[1][1] and read[0][2] < 0.6 * read[1][2]


def test_search_plan_reads_named_folders_only(spark, postings):
    s = N.posting_search(spark, postings, "the quick brown fox jumps over lazy dogs", 1, 0.05)
    plan = s.rows._jdf.queryExecution().executedPlan().toString()
    assert "part IN" in plan or "part = " in plan or "(part#" in plan


def test_postings_of_nothing(spark):
    path = scratch_dir(spark, "posting-empty")
    N.build_postings(spark.createDataFrame([(1, None), (2, "")], "call_id long, t string"), path, "call_id", F.col("t"))
    assert N.search_postings(spark, path, "anything", 5, 0.0).collect() == []


# Codes


def vectors(spark, n=3000, dim=32, seed=1):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(12, dim))
    data = centers[r.integers(0, 12, n)] + 0.4 * r.normal(size=(n, dim))
    data[: n // 3] = centers[0] + 0.01 * r.normal(size=(n // 3, dim))  # one cell holds a third
    rows = [(i, [float(x) for x in v], int(i % 7)) for i, v in enumerate(data)] + [(n + 1, None, 1), (n + 2, [float(x) for x in data[5]], 2)]
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>, label int").repartition(4), data


@pytest.fixture(scope="module")
def coded(spark):
    df, data = vectors(spark)
    return df, data, P.build_codes(df, scratch_dir(spark, "code-test"), cells=12, parts=8, entries=32)


def test_codes_are_exact_with_bounds(spark, coded):
    df, data, index = coded
    r = np.random.default_rng(5)
    for query in [data[7], data[2500], r.normal(size=32), np.zeros(32)]:
        found = P.nearest_codes(spark, index, query, k=15, probes=2).collect()
        wanted = N.nearest(df, 15, query=[float(x) for x in query]).collect()
        assert [x["doc_id"] for x in found] == [x["doc_id"] for x in wanted]
        assert [x["_distance"] for x in found] == pytest.approx([x["_distance"] for x in wanted])
    assert {"doc_id", "label", "_distance"} == set(found[0].asDict())


def test_recall_of_a_fixed_number_of_codes(spark, coded):
    df, data, index = coded
    r = np.random.default_rng(9)
    hits = []
    for query in data[r.integers(1000, 3000, 6)] + 0.1 * r.normal(size=(6, 32)):
        wanted = {x["doc_id"] for x in N.nearest(df, 10, query=[float(x) for x in query]).collect()}
        hits.append(len(wanted & {x["doc_id"] for x in P.nearest_codes(spark, index, query, k=10, probes=4, refine=8).collect()}) / 10)
    assert statistics.mean(hits) >= 0.9


def test_codes_are_bytes_not_vectors(spark, coded):
    _, _, index = coded
    codes = spark.read.parquet(f"{index.path}/codes")
    assert codes.count() == 3001 and set(codes.columns) == {"doc_id", "code", "off", "_far", "cell"}
    assert codes.where("size(code) <> 8 or exists(code, c -> c < 0 or c > 31)").count() == 0
    # Every code's stated distance from its vector is right.
    both = codes.join(spark.read.parquet(f"{index.path}/vectors").drop("cell"), "doc_id").limit(50).collect()
    for x in both:
        stands = np.array(index.centers[x["cell"]]) + np.concatenate([index.books[s][c] for s, c in enumerate(x["code"])])
        assert np.linalg.norm(stands - np.array(x["embedding"])) == pytest.approx(x["off"], abs=1e-6)


def test_code_index_refuses_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "doc_id int, embedding array<double>")
    with pytest.raises(ValueError, match="one length"):
        P.build_codes(df, scratch_dir(spark, "x"), parts=1)
    with pytest.raises(ValueError, match="no vectors"):
        P.build_codes(df.where("doc_id > 5"), scratch_dir(spark, "x"))


# Percentiles


def plain_quantile(values, p):
    order = sorted(values, key=lambda x: (math.isnan(x), 0 if math.isnan(x) else x))
    at = (len(order) - 1) * p
    low, high = order[int(at)], order[min(int(at) + 1, len(order) - 1)]
    part = at - int(at)
    return low if part == 0 or low == high else low + part * (high - low) if math.isfinite(low) and math.isfinite(high) else (1 - part) * low + part * high


@pytest.mark.parametrize("values", [[1.0, 2.0, math.inf], [1.0, 2.0, math.nan], [-math.inf, 0.0, 5.0, math.inf, math.nan, math.nan], [math.nan], [math.inf, math.inf], [-math.inf, math.inf], [0.0, 5e-324, 1e-323], [-1.7e308, 1.7e308, 0.0]])
def test_percentiles_that_are_not_finite(spark, values):
    points = {"a": 0.0, "b": 0.5, "c": 0.9, "d": 1.0, "e": 0.25}
    df = spark.createDataFrame([("g", x) for x in values] + [("g", None), ("h", 3.0)], "g string, x double")
    got = {r["g"]: r for r in A.exact_percentiles(df, "x", points, ["g"]).collect()}
    for name, p in points.items():
        a, b = got["g"][name], plain_quantile(values, p)
        assert (math.isnan(a) and math.isnan(b)) or a == b or a == pytest.approx(b)
    assert got["h"]["b"] == 3.0
    assert A.latency_summary(df, "x").first()["requests"] == len(values) + 1


def test_sketches_merge_and_keep_their_bound(spark):
    r = random.Random(2)
    rows = [(d, "hot" if i % 3 else "cold", r.lognormvariate(3, 1)) for d in range(10) for i in range(3000)]
    df = spark.createDataFrame([*rows, (0, "hot", None), (0, "hot", math.nan), (3, "none", None)], "day int, kind string, x double").repartition(5)
    stored = A.quantile_sketches(df, "x", ["day", "kind"])
    assert stored.count() == 21 and stored.agg(F.sum("nan_count"), F.sum("n")).first()[:] == (1, 30000)
    points = {"a": 0.01, "b": 0.5, "c": 0.99}
    for row in A.sketch_quantiles(stored.where("day between 2 and 7"), points, ["kind"]).collect():
        values = sorted(x for d, k, x in rows if 2 <= d <= 7 and k == row["kind"])
        for name, p in points.items():
            rank = sum(v <= row[name] for v in values) / len(values)
            assert abs(rank - p) <= 3 * A.sketch_error(800)
        assert row["n"] == len(values)
    assert A.sketch_quantiles(stored.where("day > 99"), points, ["kind"]).collect() == []
