import hashlib
import math

import pytest
from pyspark.sql import functions as F

from callscope.functions import vectors as V
from callscope.functions.text import bigrams
from callscope.operators import browse as B, similarity as N
from callscope.session import scratch_dir

T = F.col("t")


def test_hash_embedding(one):
    v = [b / 255 for b in hashlib.sha256("你好".encode()).digest()]
    norm = math.sqrt(sum(x * x for x in v))
    got = one(V.hash_embedding(T), row=("你好",))
    assert got == pytest.approx([x / norm for x in v] + [0.0] * 96)
    assert one(V.hash_embedding(T), row=("",)) == [0.0] * 128
    assert one(V.hash_embedding(T, 8), row=(None,)) == [0.0] * 8
    assert len(one(V.hash_embedding(T, 8), row=("x",))) == 8


def test_hashed_bag(spark, one):
    tokens = ["a", "b", "a", "c", "a"]
    slots = [r[0] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(F.pmod(F.xxhash64(T), F.lit(16))).collect()]
    counts = [0] * 16
    for s in slots:
        counts[s] += 1
    norm = math.sqrt(sum(c * c for c in counts))
    assert one(V.hashed_bag(F.split(T, ","), 16), row=(",".join(tokens),)) == pytest.approx([c / norm for c in counts])
    assert one(V.hashed_bag(bigrams(T), 16), row=("",)) == [0.0] * 16
    query = [float(i % 3) for i in range(16)]
    expected = sum(a * b for a, b in zip(counts, query)) / norm / math.sqrt(sum(q * q for q in query))
    assert one(V.bag_cosine(F.split(T, ","), query, 16), row=(",".join(tokens),)) == pytest.approx(expected)


def test_normalize(one):
    assert one(V.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])
    assert one(V.l2_normalize(F.array(F.lit(0.0)))) == [0.0]


def test_bigram_search(spark):
    rows = [("a", "我要转网", None), ("b", "  ", "转网太贵"), ("c", "今天天气", "我要转网"), ("d", None, None), ("e", "我要转网", "x")]
    df = spark.createDataFrame(rows, "call_id string, summary string, transcript string")
    got = N.bigram_search(df, "我要转网", 5, 0.05).collect()
    assert [r["call_id"] for r in got] == ["a", "e", "b"]
    assert got[0]["_similarity"] == pytest.approx(1.0) and got[0]["_jaccard"] == 1.0
    assert got[2]["_jaccard"] == pytest.approx(1 / 5)
    assert N.bigram_search(df, "哈哈哈哈", 5, 0.05).count() == 0
    assert N.bigram_search(df, "12 ", 5, 0.05).count() == 0
    assert [r["call_id"] for r in N.bigram_search(df, "我要转网", 1, 0.05).collect()] == ["a"]


def _vectors(spark):
    rows = [(i, [math.cos(i), math.sin(i * 1.7), (i % 7) / 7.0], i % 3) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id int, embedding array<float>, g int").repartition(4)


def test_nearest(spark):
    df = _vectors(spark).cache()
    table = {r["doc_id"]: r["embedding"] for r in df.collect()}
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    order = sorted((dist(table[9], v), k) for k, v in table.items())
    got = N.nearest(df, like=9, k=5).collect()
    assert [r["doc_id"] for r in got] == [k for _, k in order if k != 9][:5]
    assert got[0]["_distance"] == pytest.approx([d for d, k in order if k != 9][0])
    assert N.nearest(df, like=9, k=5, include_self=True).first()["doc_id"] == 9
    only = N.nearest(df, like=9, k=5, where="g = 1").collect()
    assert [r["doc_id"] for r in only] == [k for _, k in order if k != 9 and k % 3 == 1][:5]
    after = N.nearest(df, like=9, k=5, where="g = 1", postfilter=True).collect()
    assert [r["doc_id"] for r in after] == [k for k in [k for _, k in order if k != 9][:5] if k % 3 == 1]
    with pytest.raises(LookupError):
        N.nearest(df, 5, like=9999)
    with pytest.raises(ValueError):
        N.nearest(df.drop("embedding"), 5, like=9)
    with pytest.raises(ValueError):
        N.nearest(df, 5)


def test_cells_are_exact_and_prune(spark):
    df = _vectors(spark)
    index = N.build_cells(df, scratch_dir(spark, "cells"), cells=12)
    for like in ([0.1, 0.2, 0.3], [0.9, -0.4, 0.8], [-1.0, 1.0, 0.0]):
        exact = [(r["doc_id"], r["_distance"]) for r in N.nearest(df, query=like, k=7).collect()]
        found = N.nearest_cells(spark, index, like, k=7, probes=2)
        assert [(r["doc_id"], r["_distance"]) for r in found.collect()] == exact
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    assert N.nearest_cells(spark, index, [0.0, 0.0, 0.0], k=1000).count() == 300


def test_scalar_query(spark):
    df = spark.range(30).selectExpr("id AS doc_id", "id % 2 = 0 AS bad_tone", "'x' AS audio_blob")
    found = B.scalar_query(df, "bad_tone = true", 5, drop=("audio_blob",))
    assert (found.matched(), found.returned(), found.rows.columns) == (15, 5, ["doc_id", "bad_tone"])
    for wrong in ("no_such = 1", "doc_id >>> 3 ("):
        with pytest.raises(ValueError):
            B.scalar_query(df, wrong, 5)
        assert B.scalar_query(df, wrong, 5, lenient=True).returned() == 30
    assert B.scalar_query(df, None, 5).returned() == 5
    assert B.scalar_query(df, None, 5, B.RESULT_COLUMNS).rows.columns == ["doc_id", "bad_tone"]


def test_browse(spark):
    a = spark.range(5).selectExpr("id AS call_id")
    b = spark.range(4).selectExpr("id AS doc_id", "'u' AS url")
    got = B.unified_browse({"audio": a, "image": b, "gone": None}, 3)
    assert got.columns == ["_dataset", "call_id", "doc_id", "url"] and got.count() == 6
    for bad in (0, 201):
        with pytest.raises(ValueError):
            B.unified_browse({"audio": a}, bad)
    with pytest.raises(ValueError):
        B.unified_browse({"x": None}, 3)
    view = B.public_view(b.withColumn("image_blob", F.lit("x")))
    assert view.columns == ["doc_id", "url", "preview_url"] and view.first()["preview_url"] == "/api/image/assets/0"
    named = a.select(a.call_id.cast("string"))
    assert B.lookup(named, "call_id", "3").count() == 1
    assert B.lookup(named, "call_id", "3' OR '1'='1").count() == 0
