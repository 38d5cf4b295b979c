"""Guarded SQL over the given tables, the archive and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A, calls as C
from ..plans import sqlgate as Q
from ..plans.jobs import call_batch, quality_job
from ..session import scratch_dir
from ..sources import archive as Z, tables as K
from ..streaming import live as R
from . import fixtures as fx
from .registry import query, scan, table
from .reports import EXACT
from .texts import DOCS, RULE_SQL, ruled

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _sql(name: str, sql: str) -> None:
    """A statement that both engines understand, run through the guard."""

    @query(name, sql)
    def run(spark, d):
        Q.register_views(spark, {t: table(spark, d, t) for t in STAR})
        return Q.guarded(spark, sql)


_sql("sql_surface_join", """
SELECT r_name, n_name, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE l_discount BETWEEN 0.02 AND 0.08 GROUP BY r_name, n_name ORDER BY revenue DESC""")

_sql("sql_surface_semi_anti", """
SELECT c_mktsegment, count(*) AS customers, round(avg(c_acctbal), 4) AS balance FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)
AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')
GROUP BY c_mktsegment ORDER BY c_mktsegment""")

_sql("sql_surface_outer_join", """
SELECT s.s_suppkey, s.s_name, count(l.l_orderkey) AS lines FROM supplier s
LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey AND l.l_quantity > 45 GROUP BY s.s_suppkey, s.s_name""")

_sql("sql_surface_window_rank", """
SELECT c_nationkey, c_custkey, spent, place FROM (
  SELECT c_nationkey, c_custkey, spent, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY spent DESC, c_custkey) AS BIGINT) AS place
  FROM (SELECT c_nationkey, c_custkey, round(sum(o_totalprice), 2) AS spent FROM customer JOIN orders ON o_custkey = c_custkey
        GROUP BY c_nationkey, c_custkey) t) u WHERE place <= 3""")

_sql("sql_surface_rollup", """
SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS lines, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")

_sql("sql_surface_set_ops", """
SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0
EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")

_sql("sql_surface_cte_subquery", """
WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, round(total, 2) AS total FROM customer JOIN spent ON o_custkey = c_custkey
WHERE total > (SELECT 2 * avg(total) FROM spent)""")

_sql("sql_surface_scalar_functions", """
SELECT p_partkey, upper(p_brand) AS brand, CAST(length(p_name) AS BIGINT) AS n, substr(p_type, 1, 5) AS kind,
CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size, round(p_retailprice * 1.1, 2) AS price,
coalesce(nullif(p_brand, 'Brand#11'), 'first') AS shown FROM part""")

_sql("sql_surface_pricing", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS lines
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")


PRESET_SQL = f"WITH {fx.CALL_ROWS_SQL} "


def _preset(name: str, oracle: str) -> None:
    @query(f"sql_preset_{name}", PRESET_SQL + oracle)
    def run(spark, d):
        Q.register_views(spark, {"voice_analysis": fx.call_rows(table(spark, d, "events"))})
        out = Q.guarded(spark, Q.PRESETS[name])
        return out.withColumn("avg_score", F.round("avg_score", 6)) if "avg_score" in out.columns else out


_preset("stats", "SELECT risk_level, count(*) AS cnt FROM calls GROUP BY 1")
_preset("churn", "SELECT caller_intent, count(*) AS cnt FROM calls WHERE caller_intent LIKE '%转网%' OR caller_intent LIKE '%销户%' GROUP BY 1")
_preset("sentiment", "SELECT sentiment, count(*) AS cnt, round(avg(sentiment_score), 6) AS avg_score FROM calls GROUP BY 1")


@query("sql_preset_daily", f"""WITH {fx.CALL_ROWS_SQL} SELECT date, {EXACT} FROM calls GROUP BY date""")
def sql_preset_daily(spark, d):
    """The stored daily table, by way of its view."""
    path = scratch_dir(spark, "daily-view")
    A.daily_aggregate(fx.call_rows(table(spark, d, "events")), "date").write.parquet(path)
    Q.register_views(spark, {"churn_predictions": spark.read.parquet(path)})
    return Q.guarded(spark, Q.PRESETS["daily"]).select("date", *A.COUNTS)


@query("stream_deduplicated", f"""WITH turns AS (SELECT conv_id || '-' || turn AS call_id, text FROM conversations WHERE trim(text) <> ''),
{fx.analysis_sql('turns', 'call_id', 'text')} SELECT call_id, caller_intent, risk_level FROM analysed""")
def stream_deduplicated(spark, d):
    """Every second call comes in two batches; each is analysed once."""
    source, sink = scratch_dir(spark, "repeats"), scratch_dir(spark, "once")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn") * 60)
    turns = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("call_id"), F.col("text").alias("transcript"), at.alias("ts"), "turn")
    turns.where("turn % 2 = 0").drop("turn").coalesce(1).write.mode("append").parquet(source)
    turns.drop("turn").coalesce(1).write.mode("append").parquet(source)
    calls = spark.readStream.schema("call_id string, transcript string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    R.analyze_stream(calls, sink, scratch_dir(spark, "once-checkpoint"), pack=fx.PACK, once_within="10 days").awaitTermination()
    return spark.read.parquet(sink).select("call_id", "caller_intent", "risk_level")


@query("guarded_sql", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def guarded_sql(spark, d):
    Q.register_views(spark, {"events": table(spark, d, "events")})
    return Q.guarded(spark, "-- 'drop' in a comment\nSELECT event_type, count(*) AS n FROM events GROUP BY event_type;", cap=501)


@query("guarded_sql_capped", "SELECT event_id FROM events ORDER BY event_id LIMIT 501")
def guarded_sql_capped(spark, d):
    Q.register_views(spark, {"events": table(spark, d, "events")})
    return Q.guarded(spark, "SELECT event_id FROM events ORDER BY event_id", cap=501)


# ---- archive and stored tables -----------------------------------------------------------


@query("archive_roundtrip", """SELECT conv_id || '-' || turn AS call_id, md5(text) AS transcript FROM conversations""")
def archive_roundtrip(spark, d):
    folder = scratch_dir(spark, "archive")
    calls = table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("call_id"), F.col("text").alias("transcript")
    )
    Z.archive(Z.raw_documents(calls), folder, "raw_audio")
    return Z.read_archive(spark, folder, "raw_audio").select("call_id", F.md5("transcript").alias("transcript"))


@query("stored_analysis", f"""WITH {DOCS} SELECT doc_id::VARCHAR AS call_id, caller_intent, switch_reason, risk_level, '{{}}' AS key_entities, duration_seconds, 16 AS dim FROM analysed""")
def stored_analysis(spark, d):
    path = scratch_dir(spark, "analysis")
    docs = scan(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("call_id"), F.col("text").alias("transcript"))
    K.append_analysis(C.analyze_calls(docs, pack=fx.PACK, rules=None), path)
    stored = spark.read.parquet(path)
    return stored.select(
        "call_id", "caller_intent", "switch_reason", "risk_level", "key_entities", "duration_seconds", F.size("embedding").alias("dim")
    )


@query("compacted_table", "SELECT count(*) AS rows, sum(n_chars)::BIGINT AS chars, 1::BIGINT AS files FROM documents")
def compacted_table(spark, d):
    """Documents' sizes in 64 files, compacted to files of 256 MB: one here, more for a larger table."""
    path = scratch_dir(spark, "fragments")
    table(spark, d, "documents").select("doc_id", "lang", "n_chars").repartition(64, "doc_id").write.parquet(path)
    merged = spark.read.parquet(K.compact(spark, path))
    return merged.agg(
        F.count("*").alias("rows"), F.sum("n_chars").alias("chars"), F.count_distinct(F.col("_metadata.file_path")).alias("files")
    )


# ---- whole jobs --------------------------------------------------------------------------


@query("call_batch_job", f"""WITH r AS (SELECT doc_id, {fx.any_of('text', fx.RULES.downgrade)} AS down, {fx.any_of('text', fx.RULES.bad_tone)} AS bad, text FROM documents)
SELECT doc_id, round_even(length(replace(text, chr(10), '')) / 4.0::DOUBLE, 1) AS duration_s,
CASE WHEN {fx.any_of('text', fx.ACOUSTIC.angry)} THEN 'ANGRY' WHEN {fx.any_of('text', fx.ACOUSTIC.sad)} THEN 'SAD' ELSE 'NEUTRAL' END AS acoustic_emotion,
down AS downgrade_related, bad AS bad_tone, 128 AS dim FROM r""")
def call_batch_job(spark, d):
    calls = scan(spark, d, "documents", "doc_id", "text", "n_chars").select("doc_id", F.lit(None).cast("string").alias("transcript"), F.col("text").cast("binary").alias("audio_blob"))
    out = call_batch(calls, acoustic=fx.ACOUSTIC, reasons=fx.REASONS, rules=fx.RULES)
    return out.select("doc_id", "duration_s", "acoustic_emotion", "downgrade_related", "bad_tone", F.size("audio_embedding").alias("dim"))


def _short_model():
    def answer(texts):
        return ['{"caller_intent": "close", "sentiment": null}' if fx.spoken_length(t) % 2 else "no" for t in texts]

    return answer


@query("call_batch_model", f"""WITH r AS (SELECT CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id // 3 END AS doc_id, length(text) % 2 = 1 AS used,
{fx.any_of('text', fx.RULES.downgrade)} AS down, {fx.any_of('text', fx.RULES.bad_tone)} AS bad FROM documents)
SELECT doc_id, used AS model_used, CASE WHEN used THEN true ELSE down END AS downgrade_related, CASE WHEN used THEN false ELSE bad END AS bad_tone,
CASE WHEN used THEN 'unknown' WHEN bad THEN 'upset' WHEN down THEN 'anxious' ELSE 'calm' END AS text_emotion FROM r""")
def call_batch_model(spark, d):
    """Repeated and null ids keep a row each."""
    key = F.when(F.col("doc_id") % 10 != 0, F.floor(F.col("doc_id") / 3))
    calls = scan(spark, d, "documents", "doc_id", "text").select(key.alias("doc_id"), F.col("text").alias("transcript"))
    out = call_batch(calls, _short_model, blob=None, acoustic=fx.ACOUSTIC, reasons=fx.REASONS, rules=fx.RULES)
    return out.select("doc_id", "model_used", "downgrade_related", "bad_tone", "text_emotion")


def _quality_model():
    def answer(prompts):
        return ['{"downgrade_related": true, "primary_reason": "价格敏感", "confidence": 0.7}' if "hatt" in p else "no" for p in prompts]

    return answer


@query("quality_job", """SELECT doc_id, n_chars / 4.0::DOUBLE AS duration_s, contains(text, 'hatt') AS downgrade_related,
CASE WHEN contains(text, 'hatt') THEN '价格敏感' ELSE '其他' END AS primary_reason, CASE WHEN contains(text, 'hatt') THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
'未知' AS text_emotion, '' AS secondary_reason FROM documents WHERE n_chars BETWEEN 40 AND 7200""")
def quality(spark, d):
    calls = scan(spark, d, "documents", "doc_id", "text", "n_chars").select(
        "doc_id", F.col("text").cast("binary").alias("audio_blob"), (F.col("n_chars") / 4.0).alias("duration_s"),
        F.col("text").alias("transcript"), F.lit("NEUTRAL").alias("acoustic_emotion"),
    )
    out = quality_job(calls, 10, 1800, _quality_model)
    return out.select("doc_id", "duration_s", "downgrade_related", "primary_reason", "confidence", "text_emotion", "secondary_reason")


@query("jsonl_output", f"""WITH {RULE_SQL} SELECT doc_id, downgrade_related, primary_reason, summary, confidence FROM ruled""")
def jsonl_output(spark, d):
    path = scratch_dir(spark, "jsonl")
    K.write_jsonl(ruled(spark, d), path)
    written = spark.read.schema("doc_id bigint, downgrade_related boolean, primary_reason string, summary string, confidence double").json(path)
    return written.select("doc_id", "downgrade_related", "primary_reason", "summary", "confidence")


# ---- streams -----------------------------------------------------------------------------


def _stream(spark, d, name):
    # A pattern fits a table that is one file as well as one that is a folder of files.
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


@query("stream_analyze", f"""WITH turns AS (SELECT conv_id || '-' || turn AS call_id, trim(text) AS text FROM conversations WHERE trim(text) <> ''),
{fx.analysis_sql('turns', 'call_id', 'text')} SELECT call_id, caller_intent, switch_reason, sentiment, risk_level, duration_seconds FROM analysed""")
def stream_analyze(spark, d):
    sink = scratch_dir(spark, "live")
    calls = _stream(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("call_id"), F.col("text").alias("transcript"))
    R.analyze_stream(calls, sink, scratch_dir(spark, "live-checkpoint"), pack=fx.PACK).awaitTermination()
    stored = spark.read.parquet(sink)
    return stored.select("call_id", "caller_intent", "switch_reason", "sentiment", "risk_level", "duration_seconds")


@query("stream_analyze_model", f"""WITH turns AS (SELECT conv_id || '-' || turn AS call_id, text FROM conversations WHERE turn % 5 <> 0),
{fx.analysis_sql('turns', 'call_id', 'text')} SELECT call_id, CASE WHEN length(t.text) % 2 = 0 THEN 'close' ELSE caller_intent END AS caller_intent,
CASE WHEN length(t.text) % 2 = 0 THEN 'high' ELSE risk_level END AS risk_level, switch_reason FROM analysed JOIN turns t USING (call_id)""")
def stream_analyze_model(spark, d):
    """A model answers for some calls, the rules for the others; calls of blanks, newlines and tabs are none."""
    sink = scratch_dir(spark, "live-model")
    text = F.when(F.col("turn") % 5 == 0, " \n\t ").otherwise(F.col("text"))
    calls = _stream(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("call_id"), text.alias("transcript"))
    answer = F.struct(F.lit("close").alias("caller_intent"), F.lit("high").alias("risk_level"))
    model = lambda batch: batch.withColumn("_model", F.when(F.length("transcript") % 2 == 0, answer))
    R.analyze_stream(calls, sink, scratch_dir(spark, "live-model-checkpoint"), pack=fx.PACK, model=model).awaitTermination()
    return spark.read.parquet(sink).select("call_id", "caller_intent", "risk_level", "switch_reason")


@query("stream_daily", f"""WITH {fx.CALL_ROWS_SQL} SELECT date, {EXACT}, round(avg(sentiment_score), 6) AS avg_sentiment_score FROM calls GROUP BY date""")
def stream_daily(spark, d):
    sink = scratch_dir(spark, "daily-live")
    calls = fx.call_rows(_stream(spark, d, "events")).drop("date")
    R.daily_stream(calls, sink, scratch_dir(spark, "daily-live-checkpoint"), "1 day").awaitTermination()
    daily = R.read_daily_stream(spark, sink)
    return daily.withColumn("avg_sentiment_score", F.round("avg_sentiment_score", 6))
