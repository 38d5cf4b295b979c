import json

import pytest
from pyspark.sql import functions as F

from callscope.operators import models as M
from callscope.plans import jobs as P, sqlgate as Q
from callscope.streaming import live as R

ALLOWED = [
    "SELECT 1", "  with t as (select 1) select * from t", "-- c\nSELECT 1", "/* x */ SELECT 1;", "SHOW TABLES", "SELECT 'update'",
    "select \"drop\" from t", "EXPLAIN SELECT 1", "DESCRIBE t", "SELECT replace(a, 'x', 'y') FROM t", "(SELECT 1)",
    "SELECT credit_limit, reset_at, updated FROM t",
]
REFUSED = [
    "DROP TABLE t", "INSERT INTO t SELECT 1", "SELECT 1; DROP TABLE t", "", "-- SELECT", "CREATE TABLE t AS SELECT 1", "SET x=1",
    "WITH t AS (SELECT 1) INSERT INTO x SELECT * FROM t", "MERGE INTO t", "REFRESH TABLE t", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT JAVA_METHOD ('a', 'b')", "EXPLAIN INSERT INTO t SELECT 1", "/* SELECT */ TRUNCATE TABLE t",
    "SELECT r'\\', reflect('java.lang.System', 'exit', 0)", "SELECT R\"\\\", reflect('java.lang.System', 'exit', 0)",
]


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(sql):
    assert Q.is_read_only(sql)


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(sql):
    assert not Q.is_read_only(sql)


def test_run_sql(spark):
    Q.register_views(spark, {"numbers": spark.range(600).toDF("credit_limit")})
    got = Q.run_sql(spark, "SELECT credit_limit FROM numbers ORDER BY credit_limit;", 500)
    assert got.success and got.truncated and got.row_count == 500 and got.columns == ["credit_limit"]
    got = Q.run_sql(spark, "SELECT date'2024-01-02' AS d, X'41' AS b", 500)
    assert got.rows == [{"d": "2024-01-02", "b": "A"}] and not got.truncated
    assert "numbers" in got.available_tables
    assert not Q.run_sql(spark, "DROP TABLE numbers", 500).success
    assert "nope" in Q.run_sql(spark, "SELECT nope FROM numbers", 500).error
    assert Q.schemas(spark)["numbers"] == [{"column": "credit_limit", "type": "bigint"}]
    slow = Q.run_sql(spark, "SELECT sum(a.id * b.id % 7) AS s FROM range(3000000) a JOIN range(3000000) b ON a.id % 3 = b.id % 3", 500, timeout_s=2)
    assert not slow.success and slow.elapsed_ms < 60000


def _model():
    def answer(texts):
        if any("boom" in t for t in texts):
            raise ValueError("no answer")
        return [json.dumps({"caller_intent": "销户", "switch_reason": "信号差", "sentiment": "negative", "sentiment_score": -1, "summary": "s"}) if "ask" in t else "?" for t in texts]

    return answer


def test_enrich(spark):
    rows = [("a", "ask 投诉"), ("b", "投诉 boom"), ("c", "降档"), ("d", None), ("e", "ask 13812345678")]
    df = spark.createDataFrame(rows, "doc_id string, t string").coalesce(1)
    got = {r["doc_id"]: r for r in M.enrich(df, "doc_id", "t", _model).collect()}
    assert [got[k]["model_used"] for k in "abcde"] == [True, False, False, False, True]
    assert got["a"]["bad_tone"] and got["a"]["confidence"] == 0.85 and got["a"]["emotion_score"] == 1.0
    assert got["b"]["model_error"] == "ValueError: no answer" and got["b"]["confidence"] == 0.5 and got["b"]["bad_tone"]
    assert got["c"]["downgrade_related"] and got["c"]["model_error"] is None
    assert got["e"]["transcript_redacted"] == "ask [PHONE_REDACTED]" and got["e"]["primary_reason"] == "服务体验差"
    for odd in ("{}", "[1]", "3"):
        answers = M.enrich(df, "doc_id", "t", lambda odd=odd: lambda texts: [odd] * len(texts), partitions=2)
        assert not any(r["model_used"] for r in answers.collect())
    ruled = M.enrich(df, "doc_id", "t", None)
    assert not any(r["model_used"] for r in ruled.collect())


def test_model_hands_answers_on_in_small_parts(spark):
    """A task holds a few hundred answers, not a batch of ten thousand; every row keeps its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    call = M.call_model([F.col("t")], lambda: lambda texts: [t + "!" for t in texts], micro_batch=7)
    df = spark.range(3000).coalesce(1).select(F.col("id").cast("string").alias("t"))
    assert all(r["v"] == r["t"] + "!" for r in df.select("t", call["value"].alias("v")).collect())
    M.enrich(df, "t", "t", _model)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def test_map_with_errors(spark):
    df = spark.createDataFrame([(1, 2), (1, 0)], "a int, b int")
    got = M.map_with_errors(df, ["a", "b"], lambda a, b: a / b, "double").collect()
    assert got[0]["result"] == 0.5 and got[0]["error"] is None
    assert got[1]["result"] is None and got[1]["error"].startswith("ZeroDivisionError")


def test_call_batch(spark):
    rows = [("a", "我要投诉13812345678", None), ("b", "", "降档".encode()), ("c", None, b"RIFFxx"), ("d", None, b"\xff\xfe")]
    df = spark.createDataFrame(rows, "doc_id string, transcript string, audio_blob binary")
    got = {r["doc_id"]: r for r in P.call_batch(df).collect()}
    assert got["a"]["acoustic_emotion"] == "ANGRY" and got["a"]["transcript_redacted"].endswith("[PHONE_REDACTED]")
    assert got["b"]["transcript"] == "降档" and got["b"]["downgrade_related"] and got["b"]["duration_s"] == 0.5
    assert got["c"]["audio_mime"] == "audio/wav" and got["c"]["audio_embedding"] == [0.0] * 128
    assert got["d"]["transcript"] == ""
    asked = {r["doc_id"]: r for r in P.call_batch(df, _model).collect()}
    assert asked["a"]["confidence"] == 0.5 and len(asked) == 4


def test_quality_job(spark):
    schema = "doc_id string, audio_blob binary, duration_s double, transcript string, acoustic_emotion string"
    rows = [("a", b"x", 10.0, "9138123456789", "SAD"), ("b", b"x", 2000.0, "t", "SAD"), ("c", None, 10.0, "t", "SAD")]
    df = spark.createDataFrame(rows, schema)
    got = P.quality_job(df, 0, 1800).collect()
    assert [r["doc_id"] for r in got] == ["a"] and got[0]["transcript"] == "9[PHONE_REDACTED]9" and got[0]["primary_reason"] == "其他"
    model = lambda: lambda prompts: ['{"primary_reason": "价格敏感", "bad_tone": true}' if "SAD" in p else "" for p in prompts]
    got = P.quality_job(df, 0, 1800, model).first()
    assert (got["primary_reason"], got["bad_tone"], got["text_emotion"], got["confidence"]) == ("价格敏感", True, "未知", 0.0)


def test_analyze_stream(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([("a", " 我要销户 "), ("b", "  ")], "call_id string, transcript string").coalesce(1).write.json(source)
    events = []
    read = lambda: spark.readStream.schema("call_id string, transcript string").json(source)
    start = lambda: R.analyze_stream(read(), sink, state, emit=lambda e: events.extend(e.collect()), archive_to=str(tmp_path / "lake"))
    start().awaitTermination()
    spark.createDataFrame([("", "我要投诉")], "call_id string, transcript string").coalesce(1).write.mode("append").json(source)
    start().awaitTermination()
    start().awaitTermination()
    rows = sorted(spark.read.parquet(sink).select("call_id", "transcript", "caller_intent").collect())
    assert [tuple(r)[1:] for r in rows] == [("我要销户", "销户"), ("我要投诉", "投诉")]
    assert rows[1]["call_id"].startswith("call_20")
    assert [e["data"]["intent"] for e in events] == ["销户", "投诉"] and events[0]["type"] == "voice_analysis"
    assert spark.read.json(str(tmp_path / "lake" / "raw_audio")).count() == 2


def test_daily_stream_equals_batch(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "ts timestamp, caller_intent string, risk_level string, sentiment string, sentiment_score double"
    day = lambda d, h, *rest: (f"2024-01-0{d} {h:02d}:00:00", *rest)
    parts = [
        [day(1, 1, "销户", "high", "negative", -0.5), day(1, 9, "投诉", "low", "neutral", 0.0)],
        [day(1, 23, "转网/携号转网", "medium", "negative", -0.4), day(2, 5, "投诉", "high", "positive", 0.4)],
        [day(3, 5, "投诉", "high", "positive", None)],
    ]
    names = ", ".join(c.replace("timestamp", "string") for c in schema.split(", "))
    for part in parts:
        frame = spark.createDataFrame(part, names).withColumn("ts", F.to_timestamp("ts"))
        frame.coalesce(1).write.mode("append").parquet(source)
        R.daily_stream(spark.readStream.schema(schema).parquet(source), sink, state, "1 day").awaitTermination()
    got = R.read_daily_stream(spark, sink).orderBy("date")
    expected = R.daily_counts(spark.read.parquet(source), "1 day").orderBy("date")
    assert got.select(expected.columns).collect() == expected.collect()
    assert [r["total_calls"] for r in got.collect()] == [3, 1, 1]
