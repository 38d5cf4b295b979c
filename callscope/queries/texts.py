"""Text rules over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R, scalars as S, text as X
from ..functions.keywords import keyword_scores
from ..operators import calls as C
from ..operators.alignment import align, match_rate
from ..operators.aggregates import asr_summary
from ..operators.browse import duration_gate
from ..packs import ANALYSIS_DEFAULTS
from . import fixtures as fx
from .fixtures import PACK
from .registry import query, scan, table

DOCS = fx.analysis_sql("documents", "doc_id", "text")


@query("keyword_hits", " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS category, {fx.hits('lower(text)', w)} AS score FROM documents "
    f"WHERE {fx.any_of('lower(text)', w)}" for c, w in PACK.intents.items()))
def keyword_hits(spark, d):
    scores = keyword_scores(F.col("text"), PACK.intents)
    return scan(spark, d, "documents", "doc_id", "text").select("doc_id", F.inline(scores))


@query("keyword_intent", f"WITH {DOCS} SELECT doc_id, caller_intent, risk_level FROM analysed")
def keyword_intent(spark, d):
    df = scan(spark, d, "documents", "doc_id", "text").select("doc_id", X.intent(F.col("text"), PACK).alias("caller_intent"))
    return df.withColumn("risk_level", X.risk(F.col("caller_intent"), PACK))


@query("keyword_reasons", f"WITH {DOCS} SELECT doc_id, switch_reason FROM analysed")
def keyword_reasons(spark, d):
    return scan(spark, d, "documents", "doc_id", "text").select("doc_id", X.reasons(F.col("text"), PACK).alias("switch_reason"))


@query("sentiment_rule", f"WITH {DOCS} SELECT doc_id, sentiment, round(sentiment_score, 4) AS sentiment_score FROM analysed")
def sentiment_rule(spark, d):
    df = scan(spark, d, "documents", "doc_id", "text").select("doc_id", X.sentiment(F.col("text"), PACK).alias("m"))
    return df.select("doc_id", "m.sentiment", F.round("m.sentiment_score", 4).alias("sentiment_score"))


@query("retention_action", f"WITH {DOCS} SELECT doc_id, switch_reason, suggested_action FROM analysed")
def retention_action(spark, d):
    df = scan(spark, d, "documents", "doc_id", "text").select("doc_id", X.reasons(F.col("text"), PACK).alias("switch_reason"))
    return df.withColumn("suggested_action", X.retention_action(F.col("switch_reason"), PACK))


@query("call_analysis_full", f"""WITH {DOCS} SELECT doc_id, caller_intent, switch_reason, sentiment,
round(sentiment_score, 4) AS sentiment_score, risk_level, suggested_action, summary, duration_seconds FROM analysed""")
def call_analysis_full(spark, d):
    docs = scan(spark, d, "documents", "doc_id", "text")
    out = C.analyze_calls(docs, "doc_id", "text", PACK, rules=None)
    return out.drop("text").withColumn("sentiment_score", F.round("sentiment_score", 4))


LINES = """
lines AS (SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN 'assistant: ' WHEN 'user' THEN 'user: ' ELSE '' END
          || text, chr(10) ORDER BY turn) AS transcript, count(*) AS turns FROM conversations GROUP BY conv_id)"""
CALLS = f"WITH {LINES}, {fx.analysis_sql('lines', 'conv_id, turns', 'transcript')}"


@query("call_analysis_turns", f"""{CALLS} SELECT conv_id, turns, caller_intent, switch_reason, sentiment,
round(sentiment_score, 4) AS sentiment_score, risk_level, suggested_action, summary, duration_seconds FROM analysed""")
def call_analysis_turns(spark, d):
    out = C.analyze_turns(scan(spark, d, "conversations", "conv_id", "turn", "role", "text"), "conv_id", "role", "text", PACK)
    return out.withColumn("sentiment_score", F.round("sentiment_score", 4))


@query("customer_turns_only", f"""WITH said AS (SELECT conv_id, string_agg('user: ' || text, chr(10) ORDER BY turn) AS transcript
FROM conversations WHERE role = 'user' GROUP BY conv_id), {fx.analysis_sql('said', 'conv_id', 'transcript')}
SELECT conv_id, caller_intent, switch_reason, sentiment FROM analysed""")
def customer_turns_only(spark, d):
    turns = scan(spark, d, "conversations", "conv_id", "turn", "role", "text")
    out = C.analyze_turns(turns, "conv_id", "role", "text", PACK, speaker="user")
    return out.select("conv_id", "caller_intent", "switch_reason", "sentiment")


@query("call_risk_report", f"""{CALLS} SELECT caller_intent, risk_level, count(*) AS calls, sum(turns)::BIGINT AS turns,
round(avg(sentiment_score), 6) AS avg_score, count(*) FILTER (WHERE sentiment = 'negative') AS negative,
sum(duration_seconds)::BIGINT AS seconds FROM analysed GROUP BY 1, 2 ORDER BY calls DESC, caller_intent""")
def call_risk_report(spark, d):
    """Flagship: turns to calls to a risk report, two shuffles of small rows."""
    calls = C.analyze_turns(scan(spark, d, "conversations", "conv_id", "turn", "role", "text"), "conv_id", "role", "text", PACK)
    return (
        calls.groupBy("caller_intent", "risk_level")
        .agg(
            F.count("*").alias("calls"),
            F.sum("turns").alias("turns"),
            F.round(F.avg("sentiment_score"), 6).alias("avg_score"),
            F.count_if(F.col("sentiment") == "negative").alias("negative"),
            F.sum("duration_seconds").alias("seconds"),
        )
        .orderBy(F.desc("calls"), "caller_intent")
    )


ENTITY_COLUMNS = ", ".join(
    f"nullif(regexp_extract(text, '{p}', {g}), '') AS {n}" for n, (p, g) in fx.ENTITIES.captures.items()
)
RIVALS = "list_filter([" + ", ".join(
    f"CASE WHEN contains(text, '{c}') THEN '{c}' END" for c in fx.ENTITIES.competitors) + "], lambda x: x IS NOT NULL)"


@query("entities_extract", f"""SELECT doc_id, {ENTITY_COLUMNS},
{", ".join(f"CASE WHEN {fx.any_of('text', w)} THEN true END AS {n}" for n, w in fx.ENTITIES.flags.items())},
nullif(array_to_string({RIVALS}, ','), '') AS competitors,
nullif(regexp_extract(text, '{"|".join(fx.ENTITIES.places)}'), '') AS location FROM documents""")
def entities_extract(spark, d):
    df = scan(spark, d, "documents", "doc_id", "text").select("doc_id", X.entities(F.col("text"), fx.ENTITIES).alias("e"))
    return df.select("doc_id", "e.*").withColumn("competitors", F.array_join("competitors", ","))


@query("analysis_prompt", """SELECT conv_id, turn, md5('ask' || chr(10) || coalesce(text, '') || chr(10) || '{"a": 1}') AS prompt
FROM conversations""")
def analysis_prompt(spark, d):
    template = 'ask\n{transcript}\n{{"a": 1}}'
    return scan(spark, d, "conversations", "conv_id", "turn", "role", "text").select("conv_id", "turn", F.md5(X.call_prompt(F.col("text"), template)).alias("prompt"))


@query("quality_prompt", """SELECT conv_id, turn, md5('r=价格敏感、套餐不匹配、服务体验差、竞品影响、账户或设备变化、非本人办理、其他'
|| chr(10) || 'e=' || (CASE WHEN role = 'user' THEN 'SAD' ELSE 'NEUTRAL' END) || chr(10) || text) AS prompt FROM conversations""")
def quality_prompt(spark, d):
    emotion = F.when(F.col("role") == "user", "SAD").otherwise("")
    prompt = X.quality_prompt(F.col("text"), emotion, "r={reasons}\ne={emotion}\n{transcript}")
    return scan(spark, d, "conversations", "conv_id", "turn", "role", "text").select("conv_id", "turn", F.md5(prompt).alias("prompt"))


def _plain(sql: str) -> str:
    for pattern, token in fx.PII:
        sql = f"regexp_replace({sql}, '{pattern}', '{token}', 'g')"
    return sql


def _bounded(sql: str) -> str:
    # Without look-around the neighbours are part of the match, so a second pass is needed
    # for numbers that share a neighbour.
    for pattern, token in fx.PII:
        for _ in range(2):
            sql = f"regexp_replace({sql}, '(^|[^0-9])({pattern})($|[^0-9])', '\\1{token}\\3', 'g')"
    return sql


@query("pii_redact_plain", f"SELECT doc_id, md5({_plain('text')}) AS redacted, length({_plain('text')}) AS n FROM documents")
def pii_redact_plain(spark, d):
    df = scan(spark, d, "documents", "doc_id", "text").select("doc_id", X.redact(F.col("text"), fx.PII, boundaries=False).alias("t"))
    return df.select("doc_id", F.md5("t").alias("redacted"), F.length("t").cast("bigint").alias("n"))


@query("pii_redact_bounded", f"SELECT doc_id, md5({_bounded('text')}) AS redacted, length({_bounded('text')}) AS n FROM documents")
def pii_redact_bounded(spark, d):
    df = scan(spark, d, "documents", "doc_id", "text").select("doc_id", X.redact(F.col("text"), fx.PII).alias("t"))
    return df.select("doc_id", F.md5("t").alias("redacted"), F.length("t").cast("bigint").alias("n"))


_R = fx.RULES
RULE_SQL = f"""
ruled_a AS (SELECT doc_id, text, {fx.any_of('text', _R.downgrade)} AS down, {fx.any_of('text', _R.bad_tone)} AS bad,
            {fx.any_of('text', _R.price)} AS price FROM documents),
ruled AS (SELECT doc_id, down AS downgrade_related,
  CASE WHEN bad THEN 'service' WHEN price THEN 'price' ELSE 'other' END AS primary_reason, '' AS secondary_reason,
  replace(substr(text, 1, 80), chr(10), ' ') AS summary,
  CASE WHEN down AND bad THEN 0.8::DOUBLE WHEN down OR bad THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS confidence,
  CASE WHEN bad THEN 'upset' WHEN down THEN 'anxious' ELSE 'calm' END AS text_emotion, bad AS bad_tone,
  CASE WHEN bad THEN 0.8::DOUBLE WHEN down THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS emotion_score FROM ruled_a)"""


@query("rule_analysis", f"WITH {RULE_SQL} SELECT * FROM ruled")
def rule_analysis(spark, d):
    return ruled(spark, d)


def ruled(spark, d):
    return scan(spark, d, "documents", "doc_id", "text").select(
        "doc_id", *[c.alias(n) for n, c in R.rule_analysis(F.col("text"), fx.RULES, 80).items()]
    )


ANSWERS = f"""WITH {DOCS}, answers AS (SELECT doc_id, text, caller_intent, replace(switch_reason, '、', ',') AS switch_reason,
sentiment, CAST(sentiment_score AS VARCHAR) AS sentiment_score, summary FROM analysed)"""


@query("model_output_map", f"""{ANSWERS} SELECT doc_id, caller_intent IN ('port_out', 'close', 'downgrade') AS downgrade_related,
CASE {" ".join(f"WHEN contains(string_split(switch_reason, ',')[{i}], '{k}') THEN '{v}'" for i in (1, 2) for k, v in fx.REASONS.mapping.items())} ELSE 'other' END AS primary_reason,
0.85::DOUBLE AS confidence, {fx.exact('sentiment', fx.REASONS.emotions, 'unknown')} AS text_emotion,
sentiment = 'negative' AND contains(text, 'hatt') AS bad_tone,
round(greatest(0, least(1, (1 - sentiment_score::DOUBLE) / 2)), 2) AS emotion_score FROM answers""")
def model_output_map(spark, d):
    docs = C.analyze_calls(scan(spark, d, "documents", "doc_id", "text"), "doc_id", "text", PACK, rules=None)
    answer = F.struct(
        "caller_intent", F.translate("switch_reason", "、", ",").alias("switch_reason"), "sentiment",
        F.col("sentiment_score").cast("string").alias("sentiment_score"), "summary",
    )
    df = docs.select("doc_id", "text", answer.alias("a"))
    columns = R.model_columns(F.col("a"), F.col("text"), fx.REASONS)
    kept = ("downgrade_related", "primary_reason", "confidence", "text_emotion", "bad_tone", "emotion_score")
    return df.select("doc_id", *[columns[n].alias(n) for n in kept])


@query("reason_map", f"""WITH {DOCS} SELECT doc_id, CASE
{" ".join(f"WHEN contains(string_split(switch_reason, '、')[{i}], '{k}') THEN '{v}'" for i in (1, 2) for k, v in fx.REASONS.mapping.items())}
ELSE 'other' END AS primary_reason FROM analysed""")
def reason_map(spark, d):
    df = scan(spark, d, "documents", "doc_id", "text").select("doc_id", X.reasons(F.col("text"), PACK).alias("r"))
    return df.select("doc_id", R.map_reason(F.col("r"), fx.REASONS).alias("primary_reason"))


@query("reason_explode", f"""WITH {DOCS} SELECT doc_id, trim(tag) AS reason_tag FROM (SELECT doc_id, unnest(string_split(
CASE WHEN switch_reason = 'not said' THEN caller_intent ELSE switch_reason END, '、')) AS tag FROM analysed)""")
def reason_explode(spark, d):
    docs = C.analyze_calls(scan(spark, d, "documents", "doc_id", "text"), "doc_id", "text", PACK, rules=None)
    return C.explode_reasons(docs, unknown="not said", other="other").select("doc_id", "reason_tag")


@query("score_normalize", """SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE
round_even(greatest(0, least(1, (1 - (floor(value) / 64)) / 2)), 2) END AS emotion_score FROM events""")
def score_normalize(spark, d):
    raw = F.when(F.col("event_type") == "error", "n/a").otherwise((F.floor("value") / 64).cast("string"))
    df = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return df.select("event_id", R.normalize_score(F.col("raw")).alias("emotion_score"))


@query("emotion_map", f"WITH {DOCS} SELECT doc_id, {fx.exact('sentiment', fx.REASONS.emotions, 'unknown')} AS text_emotion FROM analysed")
def emotion_map(spark, d):
    df = scan(spark, d, "documents", "doc_id", "text").select("doc_id", X.sentiment(F.col("text"), PACK).alias("m"))
    return df.select("doc_id", R.map_emotion(F.col("m.sentiment"), fx.REASONS).alias("text_emotion"))


@query("acoustic_emotion", f"""SELECT d.doc_id, CASE WHEN l.quality = 1 AND l.toxic = 1 THEN 'ANGRY' WHEN l.quality = 0 AND l.toxic = 0 THEN 'SAD'
WHEN {fx.any_of('d.text', fx.ACOUSTIC.angry)} THEN 'ANGRY' WHEN {fx.any_of('d.text', fx.ACOUSTIC.sad)} THEN 'SAD' ELSE 'NEUTRAL' END AS acoustic_emotion
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def acoustic_emotion(spark, d):
    labels = table(spark, d, "labels").withColumn("rms", (F.col("quality") + F.col("toxic")) * 0.2)
    joined = scan(spark, d, "documents", "doc_id", "text").join(labels, "doc_id", "left")
    return joined.select("doc_id", R.acoustic_emotion(F.col("text"), F.col("rms"), fx.ACOUSTIC).alias("acoustic_emotion"))




@query("duration_gate", f"""SELECT doc_id, duration_s FROM (SELECT doc_id,
round_even(length(replace(text, chr(10), '')) / 4.0::DOUBLE, 1) AS duration_s FROM documents) WHERE duration_s BETWEEN 100 AND 900""")
def duration_rows(spark, d):
    df = table(spark, d, "documents").select("doc_id", X.duration(F.col("text")).alias("duration_s"))
    return duration_gate(df, 100, 900)


@query("turns_split", """WITH parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
unnest(range(len(string_split(text, chr(10))))) AS n FROM documents), kept AS (SELECT doc_id, trim(line) AS line, n FROM parts WHERE trim(line) <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS turn, CASE WHEN line LIKE 'The%' THEN 'user' ELSE 'assistant' END AS role,
md5(line) AS text FROM kept WHERE line NOT LIKE 'The%' OR length(line) > 3""".replace("md5(line)", "md5(trim(CASE WHEN line LIKE 'The%' THEN substr(line, 4) ELSE line END))"))
def turns_split(spark, d):
    from dataclasses import replace

    pack = replace(PACK, speakers={"The": "user"})
    turns = C.split_turns(scan(spark, d, "documents", "doc_id", "text"), "doc_id", "text", pack)
    return turns.select("doc_id", F.col("turn").cast("bigint").alias("turn"), "role", F.md5("text").alias("text"))


@query("transcript_assemble", f"""SELECT conv_id, md5(string_agg(CASE role WHEN 'assistant' THEN 'assistant: '
WHEN 'user' THEN 'user: ' ELSE '' END || text, chr(10) ORDER BY turn)) AS transcript FROM conversations GROUP BY 1""")
def transcript_assemble(spark, d):
    whole = C.assemble(scan(spark, d, "conversations", "conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text", PACK)
    return whole.select("conv_id", F.md5("transcript").alias("transcript"))


# Transcriptions with errors of which the counts are known: every h is lost and every i is
# heard as 3; where neither occurs in a user's turn, ~ is put in after each e instead.
def _heard(role, text):
    lost = F.translate(F.replace(text, F.lit("h"), F.lit("")), "i", "3")
    return F.when(role == "user", F.replace(text, F.lit("e"), F.lit("e~"))).otherwise(lost)


ASR_SQL = """asr AS (SELECT conv_id, turn, text AS a, CASE WHEN role = 'user' THEN replace(text, 'e', 'e~')
ELSE replace(replace(text, 'h', ''), 'i', '3') END AS b, role FROM conversations),
counted AS (SELECT conv_id, turn, a, b, CASE WHEN role = 'user' THEN length(b) - length(a) ELSE 0 END AS ins_count,
CASE WHEN role = 'user' THEN 0 ELSE length(a) - length(b) END AS del_count,
CASE WHEN role = 'user' THEN 0 ELSE length(a) - length(replace(a, 'i', '')) END AS sub_count FROM asr),
matched AS (SELECT *, length(a) - del_count - sub_count AS match_count FROM counted)"""


def _asr(spark, d, segments=False):
    df = scan(spark, d, "conversations", "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.col("text").alias("a"), _heard(F.col("role"), F.col("text")).alias("b")
    )
    return match_rate(align(df, "a", "b", segments), "a", "b")


@query("asr_diff", f"""WITH {ASR_SQL} SELECT conv_id, turn, match_count, sub_count, ins_count, del_count,
levenshtein(a, b) AS distance, md5(a) AS original, md5(b) AS transcribed,
match_count AS match_chars, sub_count AS sub_chars, del_count AS del_chars, ins_count AS ins_chars, true AS equal FROM matched""")
def asr_diff(spark, d):
    out = _asr(spark, d, segments=True)
    chars = lambda kind, field: F.aggregate(
        F.filter("diff_segments", lambda s: s["type"] == kind), F.lit(0).cast("bigint"), lambda n, s: n + F.length(s[field])
    )
    rebuilt = lambda field: F.md5(F.array_join(F.transform("diff_segments", lambda s: s[field]), ""))
    return out.select(
        "conv_id", "turn", "match_count", "sub_count", "ins_count", "del_count",
        (F.col("sub_count") + F.col("ins_count") + F.col("del_count")).alias("distance"),
        rebuilt("original").alias("original"), rebuilt("transcribed").alias("transcribed"),
        # What each kind of segment holds, and that matches match and others do not.
        chars("match", "original").alias("match_chars"), chars("sub", "transcribed").alias("sub_chars"),
        chars("del", "original").alias("del_chars"), chars("ins", "transcribed").alias("ins_chars"),
        F.forall("diff_segments", lambda s: (s["type"] == "match") == (s["original"] == s["transcribed"])).alias("equal"),
    )


@query("asr_match", f"""WITH {ASR_SQL}, w AS (SELECT *, round_even(match_count / length(a) * 100, 1) AS char_accuracy FROM matched)
SELECT conv_id, turn, char_accuracy, round_even(0.80::DOUBLE + 0.19::DOUBLE * char_accuracy / 100, 2) AS asr_confidence,
len(list_filter(string_split_regex(a, '\\s+'), lambda x: x <> ''))::INT AS word_count_original,
len(list_filter(string_split_regex(b, '\\s+'), lambda x: x <> ''))::INT AS word_count_transcribed FROM w""")
def asr_match(spark, d):
    return _asr(spark, d).select(
        "conv_id", "turn", "char_accuracy", "asr_confidence", "word_count_original", "word_count_transcribed"
    )


@query("asr_summary", f"""WITH {ASR_SQL}, w AS (SELECT round_even(match_count / length(a) * 100, 1) AS acc FROM matched),
v AS (SELECT acc, round_even(0.80::DOUBLE + 0.19::DOUBLE * acc / 100, 2) AS conf FROM w)
SELECT round(avg(acc), 1) AS overall_char_accuracy, min(acc) AS min_accuracy, max(acc) AS max_accuracy,
round(avg(conf), 2) AS avg_confidence, count(*) AS sample_count FROM v""")
def asr_report(spark, d):
    return asr_summary(_asr(spark, d))


@query("emotion_vote", """WITH t AS (SELECT doc_id, regexp_extract_all(replace(replace(replace(replace(text, 'the', '<|ANGRY|>'), 'and', '<|SAD|>'),
'lich', '<|HAPPY|>'), 'de', '<|NEUTRAL|>'), '<\\|(HAPPY|SAD|ANGRY|NEUTRAL)\\|>', 1) AS tags FROM documents),
u AS (SELECT doc_id, unnest(tags) AS tag, unnest(range(len(tags))) AS n FROM t),
c AS (SELECT doc_id, tag, count(*) AS k, min(n) AS f FROM u WHERE tag <> 'NEUTRAL' GROUP BY 1, 2),
best AS (SELECT doc_id, tag FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, f) AS r FROM c) WHERE r = 1)
SELECT d.doc_id, coalesce(b.tag, 'NEUTRAL') AS acoustic_emotion FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id""")
def emotion_vote(spark, d):
    raw = F.col("text")
    for word, tag in (("the", "ANGRY"), ("and", "SAD"), ("lich", "HAPPY"), ("de", "NEUTRAL")):
        raw = F.replace(raw, F.lit(word), F.lit(f"<|{tag}|>"))
    return scan(spark, d, "documents", "doc_id", "text").select("doc_id", X.emotion_vote(raw).alias("acoustic_emotion"))


@query("analysis_defaults", """SELECT d.doc_id, coalesce(l.toxic = 1, false) AS bad_tone, CASE WHEN l.quality = 1 THEN '价格敏感' ELSE '其他' END AS primary_reason,
coalesce(l.quality * 0.5::DOUBLE, 0.0::DOUBLE) AS confidence, CASE WHEN l.toxic = 0 THEN '平静' ELSE '未知' END AS text_emotion
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def analysis_defaults(spark, d):
    labels = table(spark, d, "labels").select(
        "doc_id",
        (F.col("toxic") == 1).alias("bad_tone"),
        F.when(F.col("quality") == 1, "价格敏感").alias("primary_reason"),
        (F.col("quality") * 0.5).alias("confidence"),
        F.when(F.col("toxic") == 0, "平静").alias("text_emotion"),
    )
    joined = table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left")
    kept = ("bad_tone", "primary_reason", "confidence", "text_emotion")
    return joined.withColumns(R.fill_defaults({n: ANALYSIS_DEFAULTS[n] for n in kept}))


@query("small_scalars", """SELECT doc_id, substr(text, 1, 60) AS preview, substr(doc_id || '1380000', 1, 3) || '****' || right(doc_id || '1380000', 4) AS masked,
CASE WHEN lang = 'en' THEN 'call_20240102_030405' ELSE source END AS call_id FROM documents""")
def small_scalars(spark, d):
    at = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    given = F.when(F.col("lang") == "en", "").otherwise(F.col("source"))
    return table(spark, d, "documents").select(
        "doc_id",
        S.preview(F.col("text"), 60).alias("preview"),
        S.mask_id(F.concat(F.col("doc_id").cast("string"), F.lit("1380000"))).alias("masked"),
        S.call_id_or_default(given, at).alias("call_id"),
    )


# What is left of a text without its ASCII letters and sentence marks; blank for many.
_LETTERS = "abcdefghijklmnopqrstuvwxyz.,|"


@query("reject_blank", f"""SELECT count(*) FILTER (WHERE t <> '') AS accepted, count(*) FILTER (WHERE t = '') AS rejected, sum(length(t))::BIGINT AS chars
FROM (SELECT regexp_replace(translate(lower(text), '{_LETTERS}', ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents)""")
def reject_blank(spark, d):
    text = F.translate(F.lower("text"), _LETTERS, "")
    good, bad = S.split_blank(table(spark, d, "documents").select(text.alias("t")), "t")
    both = good.select(F.lit(1).alias("ok"), "t").unionAll(bad.select(F.lit(0).alias("ok"), "t"))
    return both.agg(
        F.sum("ok").alias("accepted"), F.count_if(F.col("ok") == 0).alias("rejected"), F.sum(F.length("t")).alias("chars")
    )


@query("blob_text", """SELECT page_id, CASE WHEN url LIKE 'https%' THEN 'audio/wav' END AS mime, CASE WHEN url LIKE 'https%' THEN '' ELSE md5(html) END AS text_md5
FROM pages""")
def blob_text(spark, d):
    # A RIFF head and a byte that is no UTF-8 in front of some pages, plain text in the rest.
    page = F.col("html").cast("binary")
    blob = F.when(F.col("url").startswith("https"), F.concat(F.lit(bytearray(b"RIFF\xff")), page)).otherwise(page)
    df = table(spark, d, "pages").select("page_id", blob.alias("b"))
    text = S.blob_text(F.col("b"))
    return df.select(
        "page_id", S.audio_mime(F.col("b")).alias("mime"), F.when(text == "", "").otherwise(F.md5(text)).alias("text_md5")
    )
