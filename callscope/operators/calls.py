"""Call analysis over transcripts, one row per call or one row per turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions.keywords import KeywordIndex, joined_categories, top_category
from ..packs import TELECOM, TELECOM_ENTITIES, CallPack, EntityRules


def _indexes(pack: CallPack) -> dict[str, KeywordIndex]:
    return {"i": KeywordIndex(pack.intents), "r": KeywordIndex(pack.reasons), "m": X.mood_index(pack)}


def _mask_columns(line: Column, pack: CallPack) -> dict[str, Column]:
    lowered = F.lower(line)
    columns = {}
    for key, index in _indexes(pack).items():
        source = line if key == "m" else lowered
        for n, mask in enumerate(index.masks(source)):
            columns[f"_{key}{n}"] = mask
    return columns


def _from_masks(df: DataFrame, n_chars: Column, pack: CallPack) -> DataFrame:
    """Add the analysis columns to a frame that carries the keyword masks."""
    index = _indexes(pack)
    masks = {k: [F.col(f"_{k}{n}") for n in range(ix.words)] for k, ix in index.items()}
    df = df.withColumns(
        {
            "caller_intent": top_category(index["i"].ranked(masks["i"]), pack.unknown_intent),
            "switch_reason": joined_categories(
                index["r"].ranked(masks["r"]), 2, pack.reason_separator, pack.unknown_reason
            ),
            "_mood": X.mood_from_counts(
                index["m"].count(masks["m"], "negative"), index["m"].count(masks["m"], "positive")
            ),
            "duration_seconds": X.call_duration(n_chars),
        }
    )
    df = df.withColumns(
        {
            "sentiment": F.col("_mood.sentiment"),
            "sentiment_score": F.col("_mood.sentiment_score"),
            "risk_level": X.risk(F.col("caller_intent"), pack),
            "suggested_action": X.retention_action(F.col("switch_reason"), pack),
        }
    )
    return df.withColumn(
        "summary",
        X.call_summary(
            F.col("caller_intent"), F.col("switch_reason"), F.col("sentiment"),
            F.col("sentiment_score"), F.col("risk_level"), pack,
        ),
    )


_RESULT = (
    "caller_intent", "switch_reason", "sentiment", "sentiment_score", "risk_level",
    "suggested_action", "summary", "duration_seconds",
)


def analyze_calls(
    df: DataFrame,
    id: str = "call_id",
    text: str = "transcript",
    pack: CallPack = TELECOM,
    rules: EntityRules | None = TELECOM_ENTITIES,
) -> DataFrame:
    """Intent, reasons, sentiment, risk, entities, action, summary and duration of every call.

    Narrow: no shuffle, one pass over the text column. Other columns are kept.
    """
    carried = [F.col(c) for c in df.columns]
    extra = {} if rules is None else {"key_entities": X.entities(F.col(text), rules)}
    masked = df.select(*carried, *[c.alias(n) for n, c in _mask_columns(F.col(text), pack).items()])
    n_chars = F.coalesce(F.length(F.col(text)), F.lit(0))
    out = _from_masks(masked, n_chars, pack).withColumns(extra)
    return out.select(*df.columns, *_RESULT, *extra)


def spoken_line(role: Column, text: Column, pack: CallPack) -> Column:
    """A turn as the line it forms in a transcript: speaker prefix and text."""
    prefix = F.coalesce(*[F.when(role == r, F.lit(p + " ")) for p, r in pack.speakers.items()], F.lit(""))
    return F.concat(prefix, F.coalesce(text, F.lit("")))


def analyze_turns(
    df: DataFrame,
    call: str,
    role: str,
    text: str,
    pack: CallPack = TELECOM,
    speaker: str | None = None,
    turn: str | None = None,
    rules: EntityRules | None = None,
) -> DataFrame:
    """``analyze_calls`` for calls stored as one row per turn, without building transcripts.

    Masks and lengths combine on the map side, so a call with a third of all turns still
    reaches the reducer as one small row per map task. Equal to analysing the assembled
    transcript as long as no keyword spans two turns. ``speaker`` scores one role only.

    With ``turn`` and ``rules`` the entities are found as well: the match in the earliest
    turn stands, and listed competitors are united.
    """
    if speaker is not None:
        df = df.where(F.col(role) == speaker)
    line = spoken_line(F.col(role), F.col(text), pack)
    base = df.select(F.col(call), *([F.col(turn)] if turn else []), line.alias("_line"))
    columns = _mask_columns(F.col("_line"), pack)
    found: dict[str, Column] = {}
    if turn and rules:
        found = X.entity_fields(F.col("_line"), rules)
    masked = base.select(
        call, *([turn] if turn else []),
        F.length("_line").alias("_n"),
        *[c.alias(n) for n, c in columns.items()],
        *[c.alias(f"_e_{n}") for n, c in found.items()],
    )
    entity_aggs = []
    for name in found:
        col = F.col(f"_e_{name}")
        if name == "competitors":
            for i, rival in enumerate(rules.competitors):
                entity_aggs.append(F.bool_or(F.array_contains(col, rival)).alias(f"_c{i}"))
        elif name in rules.flags:
            entity_aggs.append(F.bool_or(col).alias(f"_e_{name}"))
        else:
            entity_aggs.append(F.min_by(col, F.when(col.isNotNull(), F.col(turn))).alias(f"_e_{name}"))
    per_call = masked.groupBy(call).agg(
        *[F.bit_or(n).alias(n) for n in columns],
        (F.sum("_n") + F.count("*") - 1).alias("_n"),
        F.count("*").alias("turns"),
        *entity_aggs,
    )
    out = _from_masks(per_call, F.col("_n"), pack)
    extra = []
    if found:
        rivals = F.array_compact(
            F.array(*[F.when(F.col(f"_c{i}"), F.lit(r)) for i, r in enumerate(rules.competitors)])
        )
        fields = [
            (F.when(F.size(rivals) > 0, rivals) if n == "competitors" else F.col(f"_e_{n}")).alias(n)
            for n in found
        ]
        extra = [F.struct(*fields).alias("key_entities")]
    return out.select(call, "turns", *_RESULT, *extra)


def split_turns(df: DataFrame, id: str, text: str, pack: CallPack = TELECOM) -> DataFrame:
    """One row per non-empty line of a transcript: id, turn number, role, text."""
    exploded = df.select(F.col(id), F.posexplode(X.turns(F.col(text), pack)).alias("turn", "_t"))
    return exploded.select(id, "turn", F.col("_t.role").alias("role"), F.col("_t.text").alias("text"))


def assemble(
    df: DataFrame, call: str, turn: str, role: str, text: str,
    pack: CallPack = TELECOM, part_turns: int | None = None,
) -> DataFrame:
    """One transcript for each call, from its turns.

    With ``part_turns`` a call becomes rows of that many consecutive turn numbers, numbered in
    ``part``, for calls too long for one row. Scoring needs neither: ``analyze_turns``.
    """
    line = F.struct(F.col(turn).alias("t"), spoken_line(F.col(role), F.col(text), pack).alias("line"))
    part = [F.floor(F.col(turn) / part_turns).cast("bigint").alias("part")] if part_turns else []
    grouped = df.groupBy(F.col(call), *part).agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    return grouped.select(
        call, *(["part"] if part else []), F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("transcript")
    )


def explode_reasons(
    df: DataFrame, reason: str = "switch_reason", intent: str = "caller_intent",
    unknown: str = TELECOM.unknown_reason, other: str = "其他",
) -> DataFrame:
    tags = X.reason_tags(F.col(reason), F.col(intent), unknown, other)
    return df.withColumn("reason_tag", F.explode(tags))


AGREEMENT_FIELDS = ("caller_intent", "switch_reason", "sentiment", "risk_level", "suggested_action")


def agreement(
    ours: DataFrame, model: DataFrame, key: str = "call_id", fields: tuple[str, ...] = AGREEMENT_FIELDS
) -> DataFrame:
    """Field-wise equality of two analyses of the same calls, their number and its band."""
    left = ours.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields])
    right = model.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields])
    return _compared(left.join(right, key), key, fields)


def compare_packs(
    df: DataFrame, id: str, text: str, ours: CallPack, other: CallPack, fields: tuple[str, ...] = AGREEMENT_FIELDS
) -> DataFrame:
    """``agreement`` of two packs on the same texts: both score a text in one pass, and nothing is joined."""
    first = analyze_calls(df.select(id, text), id, text, ours, rules=None).select(id, text, *[F.col(f).alias(f"_a_{f}") for f in fields])
    second = analyze_calls(first, id, text, other, rules=None)
    return _compared(second.select(id, *[f"_a_{f}" for f in fields], *[F.col(f).alias(f"_b_{f}") for f in fields]), id, fields)


def _compared(both: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    same = {
        f"{f}_same": F.coalesce(
            F.col(f"_a_{f}").cast("string") == F.col(f"_b_{f}").cast("string"), F.lit(False)
        )
        for f in fields
    }
    joined = both.select(key, *[c.alias(n) for n, c in same.items()])
    matches = sum((F.col(n).cast("int") for n in same), F.lit(0))
    band = F.when(F.col("matches") >= 4, "high").when(F.col("matches") >= 2, "partial").otherwise("low")
    return joined.withColumn("matches", matches).withColumn("band", band)


def agreement_rates(scored: DataFrame, fields: tuple[str, ...] = AGREEMENT_FIELDS) -> DataFrame:
    return scored.agg(
        F.count("*").alias("calls"),
        *[F.avg(F.col(f"{f}_same").cast("int")).alias(f"{f}_rate") for f in fields],
    )
