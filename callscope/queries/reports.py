"""Daily aggregates, distributions, latency, agreement and batch reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A, calls as C
from ..operators.ledger import answered, read_ledger
from ..operators.models import enrich, map_model, map_with_errors
from ..operators.ranges import range_join
from ..session import scratch_dir
from ..sources import tables as K
from . import fixtures as fx
from .registry import ORACLES, query, scan, table
from .texts import RULE_SQL, ruled

DAY_COUNTS = """count(*) AS total_calls,
count(*) FILTER (WHERE {churn}) AS churn_intent_count,
count(*) FILTER (WHERE risk_level = 'high') AS high_risk_count,
count(*) FILTER (WHERE risk_level = 'medium') AS medium_risk_count,
count(*) FILTER (WHERE risk_level = 'low') AS low_risk_count,
count(*) FILTER (WHERE sentiment = 'negative') AS negative_sentiment_count"""
EXACT = DAY_COUNTS.format(churn="caller_intent IN ('转网/携号转网', '销户')")
LOOSE = DAY_COUNTS.format(churn="contains(caller_intent, '转网') OR contains(caller_intent, '销户')")
TOP = """tops AS (SELECT date, switch_reason FROM (SELECT date, switch_reason, row_number() OVER (PARTITION BY date
ORDER BY count(*) DESC, switch_reason) AS r FROM calls WHERE switch_reason <> '' GROUP BY 1, 2) WHERE r = 1)"""
DAILY = f"""WITH {fx.CALL_ROWS_SQL}, {TOP}, days AS (SELECT date, {EXACT}, avg(sentiment_score) AS score FROM calls GROUP BY date),
daily AS (SELECT d.*, coalesce(t.switch_reason, 'N/A') AS top_switch_reason FROM days d LEFT JOIN tops t ON d.date = t.date)"""


def _calls(spark, d):
    return fx.call_rows(table(spark, d, "events"))


@query("daily_aggregate", f"{DAILY} SELECT * EXCLUDE (score), round(score, 6) AS avg_sentiment_score FROM daily")
def daily_aggregate(spark, d):
    daily = A.daily_aggregate(_calls(spark, d))
    return daily.withColumn("avg_sentiment_score", F.round("avg_sentiment_score", 6))


@query("daily_aggregate_variant", f"""WITH {fx.CALL_ROWS_SQL} SELECT date, {LOOSE}, '多种原因' AS top_switch_reason,
0.0::DOUBLE AS avg_sentiment_score FROM calls GROUP BY date""")
def daily_aggregate_variant(spark, d):
    return A.daily_aggregate_mixed(_calls(spark, d))


RUNNING = ", ".join(f"(sum({c}) OVER (ORDER BY date))::BIGINT AS {c}" for c in A.COUNTS)


@query("daily_running_totals", f"{DAILY} SELECT date, {RUNNING} FROM daily")
def daily_running_totals(spark, d):
    return A.running_totals(A.daily_aggregate(_calls(spark, d)))


@query("daily_totals", f"""{DAILY} SELECT count(*) AS records, 1::BIGINT AS snapshots, sum(high_risk_count)::BIGINT AS high,
sum(medium_risk_count)::BIGINT AS medium, sum(low_risk_count)::BIGINT AS low FROM daily""")
def daily_totals(spark, d):
    path = scratch_dir(spark, "daily")
    K.append_daily(A.daily_aggregate(_calls(spark, d)), path, "first")
    return A.daily_totals(K.read_daily(spark, path))


@query("daily_snapshots", f"""{DAILY} SELECT 'a' AS snapshot_id, count(*) FILTER (WHERE date < DATE '2024-01-16') AS rows FROM daily
UNION ALL SELECT 'b', count(*) FILTER (WHERE date >= DATE '2024-01-16') FROM daily""")
def daily_snapshots(spark, d):
    path = scratch_dir(spark, "snapshots")
    daily = A.daily_aggregate(_calls(spark, d))
    for name, part in (("a", daily.where("date < '2024-01-16'")), ("b", daily.where("date >= '2024-01-16'"))):
        K.append_daily(part, path, name)
    return K.snapshots(K.read_daily(spark, path)).select("snapshot_id", "rows")


@query("daily_as_of", f"""{DAILY} SELECT date, total_calls::INT AS total_calls, high_risk_count::INT AS high_risk_count, top_switch_reason
FROM daily WHERE date < DATE '2024-01-16'""")
def daily_as_of(spark, d):
    path = scratch_dir(spark, "as-of")
    daily = A.daily_aggregate(_calls(spark, d))
    K.append_daily(daily.where("date < '2024-01-16'"), path, "a")
    K.append_daily(daily.where("date >= '2024-01-16'"), path, "b")
    then = K.as_of(K.read_daily(spark, path), "a")
    return then.select("date", "total_calls", "high_risk_count", "top_switch_reason")


@query("risk_distribution_zero_filled", f"""WITH {fx.CALL_ROWS_SQL}, seen AS (SELECT CASE WHEN value > 480 THEN 'severe' WHEN value > 60 THEN 'high' ELSE 'low' END AS risk_level FROM events),
levels AS (SELECT unnest(['high', 'medium', 'low']) AS risk_level)
SELECT risk_level, count(*) - count(*) FILTER (WHERE z) AS count FROM (SELECT risk_level, false AS z FROM seen UNION ALL SELECT risk_level, true FROM levels) GROUP BY 1""")
def risk_distribution(spark, d):
    value = F.col("value")
    level = F.when(value > 480, "severe").when(value > 60, "high").otherwise("low")
    rows = table(spark, d, "events").select(level.alias("risk_level"))
    return A.distribution(rows, "risk_level", ("high", "medium", "low"))


@query("intent_distribution", """SELECT coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'unknown') AS caller_intent, count(*) AS count FROM events GROUP BY 1""")
def intent_distribution(spark, d):
    rows = table(spark, d, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("caller_intent"))
    return A.distribution(rows, "caller_intent", missing="unknown")


@query("emotion_histogram", f"""SELECT CASE WHEN {fx.any_of('text', fx.ACOUSTIC.angry)} THEN 'ANGRY' WHEN {fx.any_of('text', fx.ACOUSTIC.sad)} THEN 'SAD' ELSE 'NEUTRAL' END AS acoustic_emotion,
count(*) AS count FROM documents GROUP BY 1""")
def emotion_histogram(spark, d):
    from ..functions.rules import acoustic_emotion

    heard = acoustic_emotion(F.col("text"), None, fx.ACOUSTIC)
    # A neutral call has no tag in the stored column; the histogram puts it back.
    rows = scan(spark, d, "documents", "doc_id", "text").select(F.nullif(heard, F.lit("NEUTRAL")).alias("acoustic_emotion"))
    return A.distribution(rows, "acoustic_emotion", missing="NEUTRAL")


@query("reason_histogram", f"WITH {RULE_SQL} SELECT primary_reason, count(*) AS count FROM ruled GROUP BY 1")
def reason_histogram(spark, d):
    return A.distribution(ruled(spark, d), "primary_reason")


@query("search_summary", f"""WITH {RULE_SQL} SELECT count(*) FILTER (WHERE bad_tone) AS bad_tone,
count(*) FILTER (WHERE text_emotion = 'upset') AS negative, count(*) FILTER (WHERE downgrade_related) AS downgrade FROM ruled""")
def search_summary(spark, d):
    return A.search_summary(ruled(spark, d), negative="upset")


@query("latency_summary", """SELECT event_type, count(value) AS requests, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg,
round(coalesce(stddev_samp(value), 0), 6) AS stdev, count(*) FILTER (WHERE user_id % 10 = 0) AS errors,
round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def latency_summary(spark, d):
    out = A.latency_summary(table(spark, d, "events"), "value", ["event_type"], error=F.col("user_id") % 10 == 0)
    return _rounded(out)


def _rounded(out):
    six = ("avg", "stdev", "p50", "p75", "p95", "p99")
    return out.drop("throughput_qps").withColumns({c: F.round(c, 6) for c in six})


@query("latency_overall", """SELECT count(value) AS requests, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg,
round(coalesce(stddev_samp(value), 0), 6) AS stdev, 0::BIGINT AS errors,
round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events""")
def latency_overall(spark, d):
    return _rounded(A.latency_summary(table(spark, d, "events"), "value"))


AGREE = f"""WITH {fx.analysis_sql('documents', 'doc_id', 'text')}, {fx.analysis_sql('documents', 'doc_id', 'text', fx.OTHER_PACK, 'other')},
same AS (SELECT a.doc_id, {", ".join(f"a.{f} = b.{f} AS {f}_same" for f in C.AGREEMENT_FIELDS)} FROM analysed a JOIN other b ON a.doc_id = b.doc_id),
scored AS (SELECT *, {" + ".join(f"{f}_same::INT" for f in C.AGREEMENT_FIELDS)} AS matches FROM same)"""


def _agreement(spark, d):
    docs = scan(spark, d, "documents", "doc_id", "text")
    return C.compare_packs(docs, "doc_id", "text", fx.PACK, fx.OTHER_PACK)


@query("agreement_score", f"""{AGREE} SELECT *, CASE WHEN matches >= 4 THEN 'high' WHEN matches >= 2 THEN 'partial' ELSE 'low' END AS band FROM scored""")
def agreement_score(spark, d):
    return _agreement(spark, d)


@query("agreement_rates", f"""{AGREE} SELECT count(*) AS calls, {", ".join(f"round(avg({f}_same::INT), 6) AS {f}_rate" for f in C.AGREEMENT_FIELDS)} FROM scored""")
def agreement_rates(spark, d):
    rates = C.agreement_rates(_agreement(spark, d))
    return rates.select("calls", *[F.round(f"{f}_rate", 6).alias(f"{f}_rate") for f in C.AGREEMENT_FIELDS])


def _checked_length(text: str) -> str:
    if "hatt" in text:
        raise ValueError("unreadable")
    return str(len(text))


@query("batch_outcome", """SELECT count(*) AS total, count(*) FILTER (WHERE NOT contains(text, 'hatt')) AS completed,
count(*) FILTER (WHERE contains(text, 'hatt')) AS failed FROM documents""")
def batch_outcome(spark, d):
    return A.batch_outcome(map_with_errors(scan(spark, d, "documents", "doc_id", "text"), ["text"], _checked_length))


@query("map_with_errors", """SELECT doc_id, CASE WHEN NOT contains(text, 'hatt') THEN length(text)::VARCHAR END AS result,
CASE WHEN contains(text, 'hatt') THEN 'ValueError: unreadable' END AS error FROM documents""")
def error_rows(spark, d):
    return map_with_errors(scan(spark, d, "documents", "doc_id", "text"), ["text"], _checked_length).drop("text")


def _answering():
    """Stands in for a model: answers long texts, in prose around JSON; fails on others."""
    import json

    def answer(texts):
        out = []
        for text in texts:
            if fx.spoken_length(text) < 400:
                raise ValueError("too short")
            if "quement" in text:
                out.append("I cannot say.")
                continue
            mood = "negative" if "hatt" in text else "positive"
            reply = {"caller_intent": "close", "switch_reason": "rival,price", "sentiment": mood,
                     "sentiment_score": -0.5, "summary": "answered"}
            out.append("Here it is: " + json.dumps(reply) + " Good luck.")
        return out

    return answer


@query("model_enrich", f"""WITH {RULE_SQL}, m AS (SELECT doc_id, length({{text}}) >= 400 AND NOT contains(text, 'quement') AS used,
length({{text}}) < 400 AS short, contains(text, 'hatt') AS bad FROM documents)
SELECT m.doc_id, m.used AS model_used, CASE WHEN m.short THEN 'ValueError: too short' END AS model_error,
CASE WHEN m.used THEN true ELSE r.downgrade_related END AS downgrade_related,
CASE WHEN m.used THEN 'market' ELSE r.primary_reason END AS primary_reason,
CASE WHEN m.used THEN 0.85::DOUBLE ELSE r.confidence END AS confidence,
CASE WHEN m.used THEN (CASE WHEN m.bad THEN 'upset' ELSE 'calm' END) ELSE r.text_emotion END AS text_emotion,
CASE WHEN m.used THEN 0.75::DOUBLE ELSE r.emotion_score END AS emotion_score
FROM m JOIN ruled r ON m.doc_id = r.doc_id""".replace("{text}", "text"))
def model_enrich(spark, d):
    out = enrich(scan(spark, d, "documents", "doc_id", "text"), "doc_id", "text", _answering, fx.REASONS, fx.RULES)
    return out.select(
        "doc_id", "model_used", "model_error", "downgrade_related", "primary_reason", "confidence", "text_emotion", "emotion_score"
    )


@query("model_ledger", ORACLES["model_enrich"].replace("SELECT m.doc_id,", "SELECT 0::BIGINT AS asked_again, m.doc_id,"))
def model_ledger(spark, d):
    """The second of two runs over one ledger: same rows, and no text is asked again."""
    path = scratch_dir(spark, "answers")
    run = lambda batch: enrich(
        scan(spark, d, "documents", "doc_id", "text"), "doc_id", "text", _answering, fx.REASONS, fx.RULES,
        ledger=lambda rows, text: answered(rows, text, _answering, path, "v1", batch),
    )
    run("first")
    out = run("second")
    again = read_ledger(spark, path, "v1").agg(F.count_if(F.col("batch") == "second").alias("asked_again"))
    return out.select(
        F.coalesce(again.scalar(), F.lit(0).cast("bigint")).alias("asked_again"), "doc_id", "model_used", "model_error", "downgrade_related", "primary_reason", "confidence", "text_emotion", "emotion_score"
    )


@query("spans_of_events", """SELECT s.event_id AS span_id, count(*) AS events, round(sum(e.value), 4) AS total FROM events s
JOIN events e ON e.ts BETWEEN s.ts AND s.ts + INTERVAL 30 MINUTE WHERE s.event_type = 'signup' GROUP BY 1""")
def spans_of_events(spark, d):
    """Events within half an hour of each signup, by bins of time."""
    events = table(spark, d, "events")
    spans = events.where("event_type = 'signup'").select(F.col("event_id").alias("span_id"), F.col("ts").alias("opens"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("closes"))
    met = range_join(events.select("ts", "value"), spans, "ts", "opens", "closes", least=60)
    return met.groupBy("span_id").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))


def _counter():
    """Built once per task, as a heavy model would be."""
    import pandas as pd

    def run(batch):
        return pd.DataFrame({"conv_id": batch["conv_id"], "turn": batch["turn"], "words": batch["text"].str.split().str.len()})

    return run


@query("map_model", """SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words FROM conversations""")
def batch_model(spark, d):
    turns = scan(spark, d, "conversations", "conv_id", "turn", "text")
    return map_model(turns, _counter, "conv_id bigint, turn bigint, words bigint")


@query("etl_report", f"""WITH {fx.CALL_ROWS_SQL} SELECT 'daily_rows' AS counter, count(DISTINCT date) FILTER (WHERE date < DATE '2024-01-16') AS before, count(DISTINCT date) AS after,
count(DISTINCT date) FILTER (WHERE date >= DATE '2024-01-16') AS delta FROM calls UNION ALL SELECT 'snapshots', 1, 2, 1""")
def etl_report(spark, d):
    path = scratch_dir(spark, "etl")
    daily = A.daily_aggregate(_calls(spark, d))

    def counters():
        found = A.daily_totals(K.read_daily(spark, path)).first()
        return {"daily_rows": found["records"], "snapshots": found["snapshots"]}

    K.append_daily(daily.where("date < '2024-01-16'"), path, "first")
    before = counters()
    K.append_daily(daily.where("date >= '2024-01-16'"), path, "second")
    return A.etl_report(before, counters(), spark)


EMBEDDED = "CASE WHEN label = 9 THEN 'failed' WHEN label = 8 THEN 'skipped' ELSE 'ok' END"


@query("embedding_guard", f"""SELECT count(*) AS ok_rows, count(*) FILTER (WHERE label = 7) AS other_model,
count(*) FILTER (WHERE label = 6) AS bad_vector, 'model_mismatch' AS problem FROM embeddings WHERE {EMBEDDED} = 'ok'""")
def embedding_guard(spark, d):
    label = F.col("label")
    rows = table(spark, d, "embeddings").select(
        F.when(label == 9, "failed").when(label == 8, "skipped").otherwise("ok").alias("embedding_status"),
        F.when(label == 7, "old-model").otherwise("clip").alias("embedding_model"),
        F.when(label == 6, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("image_embedding"),
    )
    return A.check_embeddings(rows, "clip", 64)
