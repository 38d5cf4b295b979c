"""Dictionaries that occur in the given tables, and the call rows derived from events.

The tables hold invented prose, so the words below are letter runs of it. They play the part
of the telecom packs: same shape, same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..packs import AcousticPack, CallPack, EntityRules, ReasonPack, RulePack, SummaryStyle

PACK = CallPack(
    intents={
        "port_out": ("rtione", "therble", "quement"),
        "complaint": ("hatt", "htionn", "ungein"),
        "close": ("schlich", "theain", "ellean"),
        "downgrade": ("eringe", "thndly", "lement"),
        "question": ("thesre", "geheit", "thater"),
        "order": ("ungung", "thoush", "verkei"),
    },
    risks={
        "port_out": "high",
        "complaint": "high",
        "close": "medium",
        "downgrade": "medium",
        "question": "low",
        "order": "low",
    },
    reasons={
        "price": ("rthing", "thhawh", "lement"),
        "signal": ("onoron", "theden", "ungein"),
        "service": ("hering", "ningbl", "heitt"),
        "plan": ("thenou", "einber"),
        "rival": ("nwhing", "erheea", "quement"),
        "move": ("ntionth", "thinsh"),
        "quality": ("erwhou", "retion"),
        "contract": ("inglyo", "ungung"),
    },
    negative=("hatt", "retion", "keit", "eauen", "Thti"),
    positive=("thti", "lich", "ment", "nuevo"),
    actions={
        "price": "offer a discount",
        "signal": "check the network",
        "service": "assign a manager",
        "plan": "suggest another plan",
        "rival": "match the offer",
        "move": "help to move",
        "quality": "raise the case",
    },
    style=SummaryStyle(
        intent="caller wants [{}]",
        reason="because of {}",
        mood="mood {} ({})",
        risk="risk {}",
        separator="; ",
        reason_when="port",
    ),
    unknown_intent="other",
    unknown_reason="not said",
    default_action="look at the case",
    speakers={"assistant:": "assistant", "user:": "user"},
    default_speaker="assistant",
)

# A second opinion on the same texts, for the agreement of two analyses.
OTHER_PACK = CallPack(
    intents={**PACK.intents, "complaint": ("hatt", "ungein")},
    risks={**PACK.risks, "close": "high"},
    reasons={**PACK.reasons, "quality": ("erwhou",)},
    negative=("hatt", "keit", "eauen"),
    positive=PACK.positive,
    actions={**PACK.actions, "rival": "offer a gift"},
    style=PACK.style,
    unknown_intent=PACK.unknown_intent,
    unknown_reason=PACK.unknown_reason,
    default_action=PACK.default_action,
    speakers=PACK.speakers,
)

ENTITIES = EntityRules(
    captures={
        "phone": (r"\+1 \(\d{3}\) \d{3}-\d{4}", 0),
        "area_code": (r"\+1 \((\d{3})\)", 1),
        "card": (r"\d{16}", 0),
        "mail": (r"[a-z0-9.]+@[a-z0-9]+\.example\.com", 0),
    },
    flags={"has_license": ("License", "license"), "urgent": ("hatt", "retion")},
    competitors=("quement", "schlich", "therble"),
    places=("hering", "ellean", "einber", "thater"),
)

PII = ((r"\d{16}", "[CARD]"), (r"\+1 \(\d{3}\) \d{3}-\d{4}", "[PHONE]"), (r"\d{4}", "[PIN]"))

RULES = RulePack(
    downgrade=("eringe", "thndly", "lement", "quement"),
    bad_tone=("hatt", "ungein", "htionn"),
    price=("rthing", "thhawh", "heitt", "79"),
    reason_price="price",
    reason_service="service",
    reason_other="other",
    emotion_angry="upset",
    emotion_anxious="anxious",
    emotion_calm="calm",
)

REASONS = ReasonPack(
    mapping={
        "price": "money",
        "signal": "network",
        "service": "people",
        "plan": "fit",
        "rival": "market",
        "move": "account",
    },
    other="other",
    emotions={"negative": "upset", "positive": "calm", "neutral": "calm"},
    unknown_emotion="unknown",
    churn_intents=("port_out", "close", "downgrade"),
    complaint_word="hatt",
)

ACOUSTIC = AcousticPack(angry=("hatt", "ungein"), sad=("eringe", "lement"))


def call_rows(events: DataFrame) -> DataFrame:
    """Analysis rows with a day and a time, from events.

    The prime divisor keeps averages off the exact halves that two engines round apart.
    """
    kind, value = F.col("event_type"), F.col("value")
    intent = (
        F.when(kind == "signup", "转网/携号转网")
        .when(kind == "error", "投诉")
        .when(kind == "click", "销户")
        .when(kind == "view", "业务咨询")
        .otherwise("业务办理")
    )
    return events.select(
        F.col("event_id").alias("call_id"),
        "ts",
        F.to_date("ts").alias("date"),
        intent.alias("caller_intent"),
        F.when(value < 2, F.lit("")).otherwise(
            F.concat(F.lit("reason_"), (F.col("user_id") % 7).cast("string"))
        ).alias("switch_reason"),
        F.when(value > 60, "high").when(value > 20, "medium").otherwise("low").alias("risk_level"),
        F.when(value > 40, "negative").when(value > 10, "neutral").otherwise("positive").alias("sentiment"),
        (F.lit(0.5) - value / 397).alias("sentiment_score"),
    )


CALL_ROWS_SQL = """
calls AS (
  SELECT event_id AS call_id, ts, CAST(ts AS DATE) AS date,
         CASE event_type WHEN 'signup' THEN '转网/携号转网' WHEN 'error' THEN '投诉'
              WHEN 'click' THEN '销户' WHEN 'view' THEN '业务咨询' ELSE '业务办理' END AS caller_intent,
         CASE WHEN value < 2 THEN '' ELSE 'reason_' || (user_id % 7) END AS switch_reason,
         CASE WHEN value > 60 THEN 'high' WHEN value > 20 THEN 'medium' ELSE 'low' END AS risk_level,
         CASE WHEN value > 40 THEN 'negative' WHEN value > 10 THEN 'neutral' ELSE 'positive' END AS sentiment,
         0.5 - value / 397 AS sentiment_score
  FROM events
)
"""


# ---- SQL texts of the keyword rules ------------------------------------------------------
def hits(text: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words) + ")"


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def first_of(text: str, mapping, default: str) -> str:
    cases = " ".join(f"WHEN contains({text}, '{k}') THEN '{v}'" for k, v in mapping.items())
    return f"CASE {cases} ELSE '{default}' END"


def exact(value: str, mapping, default: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {value} {cases} ELSE '{default}' END"


#: What stands for personal data in a redacted text, and the characters it replaced.
_REDACTED = {"[ID_REDACTED]": 18, "[PHONE_REDACTED]": 11}


def spoken_length(redacted: str) -> int:
    """Characters of a text before it was redacted: the models below see it only after, SQL only before."""
    return len(redacted) + sum(redacted.count(mark) * (length - len(mark)) for mark, length in _REDACTED.items())


def analysis_sql(source: str, key: str, text: str, pack: CallPack = PACK, name: str = "analysed") -> str:
    """CTEs that end in one with the columns of a full call analysis."""
    intents = ", ".join(f"{hits(f'lower({text})', w)} AS i{n}" for n, w in enumerate(pack.intents.values()))
    reasons = ", ".join(f"{hits(f'lower({text})', w)} AS r{n}" for n, w in enumerate(pack.reasons.values()))
    best = "greatest(" + ", ".join(f"i{n}" for n in range(len(pack.intents))) + ")"
    intent = " ".join(f"WHEN i{n} = {best} THEN '{c}'" for n, c in enumerate(pack.intents))
    listed = ", ".join(
        f"{{'s': -r{n}, 'p': {n}, 'c': '{c}'}}" for n, c in enumerate(pack.reasons)
    )
    top = f"list_sort(list_filter([{listed}], lambda x: x.s < 0))[1:2]"
    style = pack.style
    part = lambda template, *values: "'" + template.format(*[f"' || {v} || '" for v in values]) + "'"
    mood = f"printf('%.2f', sentiment_score)"
    return f"""
{name}_a AS (
  SELECT {key}, {text}, {intents}, {reasons},
         {hits(text, pack.negative)} AS neg, {hits(text, pack.positive)} AS pos
  FROM {source}
),
{name}_b AS (
  SELECT {key}, {text},
         CASE WHEN {best} = 0 THEN '{pack.unknown_intent}' {intent} END AS caller_intent,
         coalesce(nullif(array_to_string(list_transform({top}, lambda x: x.c), '{pack.reason_separator}'), ''),
                  '{pack.unknown_reason}') AS switch_reason,
         CASE WHEN neg > pos THEN 'negative' WHEN pos > 0 THEN 'positive' ELSE 'neutral' END AS sentiment,
         CASE WHEN neg > pos THEN greatest(-1.0::DOUBLE, -0.3::DOUBLE - 0.1::DOUBLE * neg)
              WHEN pos > 0 THEN least(1.0::DOUBLE, 0.3::DOUBLE + 0.1::DOUBLE * pos)
              ELSE 0.0::DOUBLE END AS sentiment_score,
         greatest(30, length({text}) // 3)::INT AS duration_seconds
  FROM {name}_a
),
{name}_c AS (
  SELECT *, {exact('caller_intent', pack.risks, pack.default_risk)} AS risk_level,
         {first_of('switch_reason', pack.actions, pack.default_action)} AS suggested_action
  FROM {name}_b
),
{name} AS (
  SELECT *, concat_ws('{style.separator}', {part(style.intent, 'caller_intent')},
         CASE WHEN contains(caller_intent, '{style.reason_when}') THEN {part(style.reason, 'switch_reason')} END,
         {part(style.mood, 'sentiment', mood)}, {part(style.risk, 'upper(risk_level)')}) AS summary
  FROM {name}_c
)"""
