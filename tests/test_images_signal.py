import math
import random

import pytest
from pyspark.sql import functions as F

from callscope.operators import images as I
from callscope.operators.signal import BLOCK, signal_features
from callscope.plans.jobs import image_batch

FACE = "array<struct<x1:double,y1:double,x2:double,y2:double,score:double>>"
METRICS = f"doc_id string, faces {FACE}, width int, height int, blur_score double, face_blur_score double"


def box(side, score, x=0.0):
    return (x, 0.0, x + side, side, score)


CASES = [
    # faces on a 100 x 100 image, blur, face blur -> has_face, is_avatar, reason
    ("none", [], 200.0, None, False, False, "未检测到有效人脸"),
    ("good", [box(50.0, 0.9)], 100.0, 80.0, True, True, "单人脸清晰且占比合理"),
    ("two", [box(50.0, 0.9), box(20.0, 0.9, 60.0)], 200.0, 90.0, True, False, "头像必须恰好包含一张人脸"),
    ("largest_weak", [box(50.0, 0.40), box(20.0, 0.90, 60.0)], 200.0, 90.0, False, False, "未检测到有效人脸"),
    ("small", [box(math.sqrt(200), 0.9)], 200.0, 90.0, True, False, "人脸占画面比例过小"),
    ("blurry", [box(50.0, 0.9)], 99.9, 90.0, True, False, "整张图片明显模糊"),
    ("face_blurry", [box(50.0, 0.9)], 200.0, 79.9, True, False, "人脸区域明显模糊"),
    ("no_crop", [box(50.0, 0.9)], 200.0, None, True, True, "单人脸清晰且占比合理"),
    ("all_bad", [], 5.0, None, False, False, "未检测到有效人脸；整张图片明显模糊"),
]


def test_rules(spark):
    df = spark.createDataFrame([(n, f, 100, 100, b, fb) for n, f, b, fb, *_ in CASES], METRICS)
    got = {r["doc_id"]: r for r in I.avatar_rules(df).collect()}
    for name, faces, _, _, has_face, avatar, reason in CASES:
        row = got[name]
        assert (row["face_count"], row["has_face"], row["is_avatar"], row["analysis_reason"]) == (len(faces), has_face, avatar, reason), name
    assert got["largest_weak"]["face_score"] == 0.40


def test_largest_face_tie_keeps_the_first(spark):
    df = spark.createDataFrame([([box(10.0, 0.1), box(10.0, 0.2, 5.0)],)], f"f {FACE}")
    assert df.select(I.largest_face(F.col("f")).alias("x")).first()["x"]["score"] == 0.1


def test_geometry(spark):
    dims = lambda w, h: tuple(spark.range(1).select(I.resized_dims(F.lit(w), F.lit(h)).alias("s")).first()["s"])
    assert dims(1024, 10) == (1024, 10)
    assert dims(2048, 1001) == (1024, 500)
    assert dims(100000, 1) == (1024, 1)
    clip = lambda b: spark.createDataFrame([(b,)], "b struct<x1:double,y1:double,x2:double,y2:double>").select(
        I.clip_box(F.col("b"), F.lit(100), F.lit(50)).alias("c")).first()["c"]
    assert tuple(clip((-3.7, 4.9, 120.0, 20.2))) == (0, 4, 100, 20)
    assert clip((100.0, 0.0, 130.0, 20.0)) is None


def test_status_and_counts(spark):
    rows = [("a", b"x", True, None), ("b", b"x", False, None), ("c", None, None, None), ("d", b"x", True, "e" * 600)]
    df = spark.createDataFrame(rows, "doc_id string, image_blob binary, decodable boolean, err string")
    got = {r["doc_id"]: r for r in I.assign_status(df, model_error="err", error_chars=500).collect()}
    assert [got[k]["analysis_status"] for k in "abcd"] == ["ok", "decode_failed", "download_failed", "llm_failed"]
    assert len(got["d"]["analysis_error"]) == 500 and got["a"]["analysis_error"] is None
    vec = df.withColumn("image_embedding", F.when(F.col("doc_id") != "d", F.array(F.lit(1.0).cast("float"))))
    done = I.embedding_status(vec, "m", 1)
    assert {r["doc_id"]: r["embedding_status"] for r in done.collect()} == {"a": "ok", "b": "failed", "c": "skipped", "d": "failed"}
    assert I.require_embedded(done) == 1
    with pytest.raises(RuntimeError):
        I.require_embedded(done.where("doc_id = 'c'"))
    with pytest.raises(ValueError):
        I.reset_analysis(df, "other")


def test_local_then_vlm_leaves_no_local_scores(spark):
    rows = [("a", [box(50.0, 0.9)], 100, 100, 200.0, 90.0, b"x", True, None)]
    df = spark.createDataFrame(rows, METRICS + ", image_blob binary, decodable boolean, answer string")
    local = image_batch(df)
    assert local.first()["face_score"] == 0.9
    vlm = image_batch(local, "vlm").first()
    assert (vlm["face_score"], vlm["is_avatar"], vlm["analysis_status"], vlm["analysis_backend"]) == (None, None, "llm_failed", "vlm")


def test_accuracy(spark):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", None)], "doc_id string, is_avatar boolean")
    labels = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", True), ("e", False)], "doc_id string, expected_avatar boolean")
    assert tuple(I.accuracy(I.label_accuracy(df, labels)).first())[:2] == (2, 3)


def laplacian(grid):
    h, w = len(grid), len(grid[0])
    mirror = lambda i, n: 0 if n == 1 else -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    values = [
        grid[mirror(y - 1, h)][x] + grid[mirror(y + 1, h)][x] + grid[y][mirror(x - 1, w)] + grid[y][mirror(x + 1, w)] - 4 * grid[y][x]
        for y in range(h) for x in range(w)
    ]
    mean = sum(values) / len(values)
    return sum((v - mean) ** 2 for v in values) / len(values)


def test_laplacian(spark):
    rng = random.Random(1)
    grids = {"a": [[rng.randint(0, 255) for _ in range(7)] for _ in range(5)], "b": [[3, 9, 1]], "c": [[4]], "d": [[1], [5]]}
    rows = [(k, y, x, v) for k, g in grids.items() for y, line in enumerate(g) for x, v in enumerate(line)]
    df = spark.createDataFrame(rows, "img string, y int, x int, luma int").repartition(3)
    got = {r["img"]: r["blur_score"] for r in I.laplacian_variance(df, "img").collect()}
    for key, grid in grids.items():
        assert got[key] == pytest.approx(laplacian(grid)), key


def features(signal, buckets=64):
    n = len(signal)
    peak = max(abs(v) for v in signal) or 1.0
    parts, start = [], 0
    for b in range(buckets):
        size = n // buckets + (b < n % buckets)
        parts.append([v / peak for v in signal[start : start + size]])
        start += size
    rms = [math.sqrt(sum(v * v for v in p) / len(p)) if p else 0.0 for p in parts]
    zcr = [sum((a < 0) != (b < 0) for a, b in zip(p, p[1:])) / (len(p) - 1) if len(p) > 1 else 0.0 for p in parts]
    norm = math.sqrt(sum(v * v for v in rms + zcr))
    return [v / norm for v in rms + zcr] if norm else rms + zcr


def test_signal_features(spark):
    rng = random.Random(2)
    signals = {
        "hot": [rng.uniform(-3, 3) for _ in range(3 * BLOCK + 17)], "short": [1.0, -2.0, 3.0], "exact": [rng.uniform(-1, 1) for _ in range(128)],
        "silent": [0.0] * 70,
    }
    rows = [(k, i, v) for k, s in signals.items() for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "signal_id string, idx int, value double").repartition(6)
    got = {r["signal_id"]: r["features"] for r in signal_features(df).collect()}
    for key, signal in signals.items():
        assert got[key] == pytest.approx(features(signal), abs=1e-6), key
