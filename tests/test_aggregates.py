import random
import statistics

import pytest
from pyspark.sql import functions as F

from callscope.operators import aggregates as A

CALLS = "date string, caller_intent string, switch_reason string, risk_level string, sentiment string, sentiment_score double"


def test_daily(spark):
    rows = [
        ("d1", "销户", "b", "high", "negative", -0.5), ("d1", "转网/携号转网", "a", "medium", "neutral", None),
        ("d1", "投诉", "b", "low", "positive", 0.5), ("d1", "转网", "a", "odd", "negative", 0.3),
        ("d2", "投诉", None, None, None, None), ("d2", "投诉", "", "high", "neutral", None),
    ]
    got = {r["date"]: r for r in A.daily_aggregate(spark.createDataFrame(rows, CALLS)).collect()}
    d1, d2 = got["d1"], got["d2"]
    assert (d1["total_calls"], d1["churn_intent_count"], d1["high_risk_count"], d1["medium_risk_count"], d1["low_risk_count"]) == (4, 2, 1, 1, 1)
    assert (d1["negative_sentiment_count"], d1["top_switch_reason"], d1["avg_sentiment_score"]) == (2, "a", pytest.approx(0.1))
    assert (d2["top_switch_reason"], d2["avg_sentiment_score"], d2["total_calls"]) == ("N/A", 0.0, 2)
    mixed = {r["date"]: r for r in A.daily_aggregate_mixed(spark.createDataFrame(rows, CALLS)).collect()}
    assert (mixed["d1"]["churn_intent_count"], mixed["d1"]["top_switch_reason"], mixed["d1"]["avg_sentiment_score"]) == (3, "多种原因", 0.0)
    running = A.running_totals(A.daily_aggregate(spark.createDataFrame(rows, CALLS))).orderBy("date").collect()
    assert [r["total_calls"] for r in running] == [4, 6]


def test_distribution(spark):
    df = spark.createDataFrame([("high",), ("high",), (None,), ("odd",)], "risk_level string")
    got = {r[0]: r[1] for r in A.distribution(df, "risk_level", ("high", "medium", "low"), missing="low").collect()}
    assert got == {"high": 2, "medium": 0, "low": 1, "odd": 1}


def test_image_summaries(spark):
    rows = [("ok", True, "ok"), ("ok", False, "failed"), ("decode_failed", None, "skipped"), ("pending", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "analysis_status string, is_avatar boolean, embedding_status string")
    assert A.image_summary(df).first().asDict() == {"total": 5, "analyzed": 2, "avatars": 1, "rejected": 1, "failed": 1, "embedded": 1}
    assert A.image_summary(df, pending_is_failure=True).first()["failed"] == 2


def test_latency_small(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "ms double")
    got = A.latency_summary(df, "ms", wall_ms=1500).first()
    assert (got["p50"], got["stdev"], got["requests"], got["throughput_qps"]) == (2.0, 1.0, 3, 2.0)
    assert got["p95"] == pytest.approx(2.9)
    single = A.latency_summary(df.where("ms = 1"), "ms").first()
    assert (single["stdev"], single["p50"], single["p99"]) == (0.0, 1.0, 1.0)
    empty = A.latency_summary(df.where("ms > 9"), "ms").first()
    assert (empty["requests"], empty["p50"]) == (0, None)


def test_percentiles_with_a_hot_group_and_hot_values(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.choice([5, 5, 5, rng.randint(0, 400)]))) for _ in range(6000)]
    rows += [(None, rng.random()) for _ in range(501)] + [("lone", 7.0)] + [("far", 1e6 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    points = {"a": 0.0, "b": 0.123, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r["g"]: r for r in A.exact_percentiles(df, "v", points, ["g"], bins=16).collect()}
    for group in ("hot", None, "lone", "far"):
        values = sorted(v for g, v in rows if g == group)
        for name, p in points.items():
            k = (len(values) - 1) * p
            low = int(k)
            high = min(low + 1, len(values) - 1)
            assert got[group][name] == pytest.approx(values[low] + (k - low) * (values[high] - values[low])), (group, name)
    values = [v for g, v in rows if g == "hot"]
    out = A.latency_summary(df, "v", ["g"]).where("g = 'hot'").first()
    assert (out["requests"], out["stdev"]) == (6000, pytest.approx(statistics.stdev(values)))


def test_guard(spark):
    schema = "embedding_status string, embedding_model string, image_embedding array<float>"
    check = lambda rows: A.check_embeddings(spark.createDataFrame(rows, schema), "m", 2).first()["problem"]
    assert check([("ok", "m", [1.0, 2.0]), ("failed", None, None)]) is None
    assert check([("failed", "m", [1.0, 2.0])]) == "no_vectors"
    assert check([("ok", "m", [1.0, 2.0]), ("ok", None, [1.0, 2.0])]) == "model_mismatch"
    assert check([("ok", "m", None)]) == "bad_vector"
    assert check([("ok", "m", [1.0])]) == "bad_vector"
    with pytest.raises(RuntimeError):
        A.require_embeddings(spark.createDataFrame([("ok", "x", [1.0, 2.0])], schema), "m", 2)


def test_reports(spark):
    rows = {r["counter"]: (r["before"], r["after"], r["delta"]) for r in A.etl_report({"a": 1}, {"a": 3, "b": 2}, spark).collect()}
    assert rows == {"a": (1, 3, 2), "b": (0, 2, 2)}
    df = spark.createDataFrame([(None,), ("x",)], "error string")
    assert tuple(A.batch_outcome(df).first()) == (2, 1, 1)
    df = spark.createDataFrame([(True, "negative", True), (None, "不满", False)], "bad_tone boolean, text_emotion string, downgrade_related boolean")
    assert tuple(A.search_summary(df).first()) == (1, 1, 1)
