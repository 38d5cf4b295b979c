"""Rule-based analysis columns and the mapping of model answers onto them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..packs import (
    ANALYSIS_DEFAULTS,
    TELECOM_ACOUSTIC,
    TELECOM_REASONS,
    TELECOM_RULES,
    AcousticPack,
    ReasonPack,
    RulePack,
)
from .base import contains_any, first_contained, lookup


def rule_analysis(text: Column, pack: RulePack = TELECOM_RULES, summary_chars: int | None = None) -> dict[str, Column]:
    """The eight analysis columns from keyword rules alone. ``summary_chars`` cuts the summary."""
    downgrade = contains_any(text, pack.downgrade)
    bad_tone = contains_any(text, pack.bad_tone)
    price = contains_any(text, pack.price)
    summary = F.coalesce(text, F.lit(""))
    summary = summary if summary_chars is None else F.substring(summary, 1, summary_chars)
    level = lambda both, angry, anxious, calm: (
        F.when(downgrade & bad_tone, F.lit(both))
        .when(bad_tone, F.lit(angry))
        .when(downgrade, F.lit(anxious))
        .otherwise(F.lit(calm))
    )
    angry, anxious, calm = pack.emotion_angry, pack.emotion_anxious, pack.emotion_calm
    return {
        "downgrade_related": downgrade,
        "primary_reason": F.when(bad_tone, F.lit(pack.reason_service))
        .when(price, F.lit(pack.reason_price))
        .otherwise(F.lit(pack.reason_other)),
        "secondary_reason": F.lit(""),
        "summary": F.translate(summary, "\n", " "),
        "confidence": level(0.8, 0.5, 0.5, 0.3),
        "text_emotion": level(angry, angry, anxious, calm),
        "bad_tone": bad_tone,
        "emotion_score": level(0.8, 0.8, 0.5, 0.2),
    }


def map_reason(reason: Column, pack: ReasonPack = TELECOM_REASONS) -> Column:
    """Primary reason of the first listed reason that names a known one."""
    mapped = F.transform(F.split(reason, "[、，,]"), lambda part: first_contained(part, pack.mapping))
    return F.coalesce(F.get(F.array_compact(mapped), F.lit(0)), F.lit(pack.other))


def normalize_score(score: Column) -> Column:
    """Model score in [-1, 1] to a negativity in [0, 1]; 0 for anything that is no number."""
    number = score.try_cast("double")
    # greatest and least skip nulls, so a missing number has to be set aside first.
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(1.0) - number) / 2))
    return F.when(number.isNull(), F.lit(0.0)).otherwise(F.bround(clipped, 2))


def map_emotion(sentiment: Column, pack: ReasonPack = TELECOM_REASONS) -> Column:
    return lookup(sentiment, pack.emotions, pack.unknown_emotion)


def model_columns(
    answer: Column, redacted: Column, pack: ReasonPack = TELECOM_REASONS, nulls: Column | None = None
) -> dict[str, Column]:
    """The eight analysis columns from a model answer with the fields caller_intent,
    switch_reason, sentiment, sentiment_score and summary.

    A field that is absent has a default. ``nulls`` tells which were given as JSON null: they
    stay null, which is an unknown emotion and a score of 0.
    """
    given = (lambda name: F.coalesce(F.array_contains(nulls, name), F.lit(False))) if nulls is not None else (lambda name: F.lit(False))
    mood = F.when(given("sentiment"), F.lit(None).cast("string")).otherwise(F.coalesce(answer["sentiment"], F.lit("neutral")))
    return {
        "downgrade_related": F.coalesce(answer["caller_intent"].isin(*pack.churn_intents), F.lit(False)),
        "primary_reason": map_reason(F.coalesce(answer["switch_reason"], F.lit("")), pack),
        "secondary_reason": F.lit(""),
        "summary": F.coalesce(answer["summary"], F.lit("")),
        "confidence": F.lit(0.85),
        "text_emotion": map_emotion(mood, pack),
        "bad_tone": F.coalesce(mood == "negative", F.lit(False)) & F.coalesce(redacted.contains(pack.complaint_word), F.lit(False)),
        "emotion_score": normalize_score(
            F.when(given("sentiment_score"), F.lit(None).cast("string")).otherwise(F.coalesce(answer["sentiment_score"], F.lit("0.5")))
        ),
    }


def acoustic_emotion(
    text: Column, rms: Column | None = None, pack: AcousticPack = TELECOM_ACOUSTIC
) -> Column:
    """Emotion from the loudness of the recording, or from words where it does not decide."""
    by_word = (
        F.when(contains_any(text, pack.angry), "ANGRY")
        .when(contains_any(text, pack.sad), "SAD")
        .otherwise("NEUTRAL")
    )
    if rms is None:
        return by_word
    return F.when(rms > pack.loud, "ANGRY").when(rms < pack.quiet, "SAD").otherwise(by_word)


def fill_defaults(defaults: dict = ANALYSIS_DEFAULTS) -> dict[str, Column]:
    """Replacement columns that turn nulls of the analysis columns into their defaults."""
    return {name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()}
