"""Text functions over one transcript column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..packs import (
    AUDIO_SUFFIXES,
    BIGRAM_NOISE,
    CALL_PROMPT,
    EMOTION_NOISE,
    EMOTION_TAGS,
    PII_RULES,
    PRIMARY_REASONS,
    QUALITY_PROMPT,
    TELECOM,
    TELECOM_ENTITIES,
    TEXT_EMOTIONS,
    CallPack,
    EntityRules,
)
from .base import blank_to_null, contains_any, first_contained, let, lookup, strip
from .keywords import KeywordIndex, joined_categories, keyword_scores, top_category, unpack


def intent(text: Column, pack: CallPack = TELECOM) -> Column:
    return top_category(keyword_scores(text, pack.intents), pack.unknown_intent)


def risk(intent_col: Column, pack: CallPack = TELECOM) -> Column:
    return lookup(intent_col, pack.risks, pack.default_risk)


def reasons(text: Column, pack: CallPack = TELECOM, n: int = 2) -> Column:
    ranked = keyword_scores(text, pack.reasons)
    return joined_categories(ranked, n, pack.reason_separator, pack.unknown_reason)


def mood_index(pack: CallPack) -> KeywordIndex:
    return KeywordIndex({"negative": pack.negative, "positive": pack.positive})


def mood_from_counts(negative: Column, positive: Column) -> Column:
    """``struct<sentiment, sentiment_score>`` from the two keyword counts."""
    label = (
        F.when(negative > positive, "negative").when(positive > 0, "positive").otherwise("neutral")
    )
    score = (
        F.when(negative > positive, F.greatest(F.lit(-1.0), F.lit(-0.3) - F.lit(0.1) * negative))
        .when(positive > 0, F.least(F.lit(1.0), F.lit(0.3) + F.lit(0.1) * positive))
        .otherwise(F.lit(0.0))
    )
    return F.struct(label.alias("sentiment"), score.alias("sentiment_score"))


def sentiment(text: Column, pack: CallPack = TELECOM) -> Column:
    """Label and score; unlike intent and reasons the text is not lower-cased."""
    index = mood_index(pack)

    def mood(masks: Column) -> Column:
        words = unpack(masks, index.words)
        counts = F.struct(index.count(words, "negative").alias("n"), index.count(words, "positive").alias("p"))
        return let(counts, lambda c: mood_from_counts(c["n"], c["p"]))

    return let(F.array(*index.masks(text)), mood)


def entity_fields(text: Column, rules: EntityRules = TELECOM_ENTITIES) -> dict[str, Column]:
    """Every entity as its own nullable column; what is absent stays null."""
    fields = {
        name: blank_to_null(F.regexp_extract(text, f"(?U){pattern}", group))
        for name, (pattern, group) in rules.captures.items()
    }
    for name, words in rules.flags.items():
        fields[name] = F.when(contains_any(text, words), F.lit(True))
    rivals = F.array_compact(F.array(*[F.when(text.contains(w), F.lit(w)) for w in rules.competitors]))
    fields["competitors"] = let(rivals, lambda r: F.when(F.size(r) > 0, r))
    fields["location"] = blank_to_null(F.regexp_extract(text, "|".join(rules.places), 0))
    return fields


def entities(text: Column, rules: EntityRules = TELECOM_ENTITIES) -> Column:
    """Struct of entities. ``to_json`` of it leaves the absent ones out."""
    return let(text, lambda t: F.struct(*[c.alias(n) for n, c in entity_fields(t, rules).items()]))


def retention_action(reason: Column, pack: CallPack = TELECOM) -> Column:
    """Action of the first reason in dictionary order that the reason text names."""
    return F.coalesce(first_contained(reason, pack.actions), F.lit(pack.default_action))


def _fill(template: str, *values: Column) -> Column:
    pieces = template.split("{}")
    parts: list[Column] = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [value, F.lit(piece)]
    return F.concat(*parts)


def call_summary(
    intent_col: Column, reason: Column, mood: Column, score: Column, risk_col: Column,
    pack: CallPack = TELECOM,
) -> Column:
    style = pack.style
    return F.concat_ws(
        style.separator,
        _fill(style.intent, intent_col),
        F.when(intent_col.contains(style.reason_when), _fill(style.reason, reason)),
        _fill(style.mood, mood, F.format_string("%.2f", score)),
        _fill(style.risk, F.upper(risk_col)),
    )


def call_duration(n_chars: Column) -> Column:
    """Seconds guessed from the number of characters, at least half a minute."""
    return F.greatest(F.lit(30), F.floor(n_chars / 3)).cast("int")


def call_prompt(transcript: Column, template: str = CALL_PROMPT) -> Column:
    head, tail = template.split("{transcript}")
    unescape = lambda s: s.replace("{{", "{").replace("}}", "}")
    return F.concat(F.lit(unescape(head)), F.coalesce(transcript, F.lit("")), F.lit(unescape(tail)))


def quality_prompt(transcript: Column, emotion: Column, template: str = QUALITY_PROMPT) -> Column:
    filled = template.replace("{reasons}", "、".join(PRIMARY_REASONS)).replace(
        "{emotions}", "、".join(TEXT_EMOTIONS)
    )
    head, rest = filled.split("{emotion}")
    middle, tail = rest.split("{transcript}")
    return F.concat(
        F.lit(head),
        F.coalesce(blank_to_null(emotion), F.lit("NEUTRAL")),
        F.lit(middle),
        F.coalesce(transcript, F.lit("")),
        F.lit(tail),
    )


def redact(
    text: Column, rules: Sequence[tuple[str, str]] = PII_RULES, boundaries: bool = True
) -> Column:
    """Replace personal data. With ``boundaries`` a match may not sit inside a longer number."""
    for pattern, token in rules:
        guarded = rf"(?<!\d)(?:{pattern})(?!\d)" if boundaries else pattern
        text = F.regexp_replace(text, f"(?U){guarded}", token)
    return text


def duration(text: Column, measured: Column | None = None) -> Column:
    """Measured seconds where there are any, else four characters a second; one decimal."""
    chars = F.length(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit("")))
    guess = chars / 4.0
    return F.bround(guess if measured is None else F.coalesce(measured.cast("double"), guess), 1)


def reason_tags(reason: Column, intent_col: Column, unknown: str, other: str) -> Column:
    """Array of display tags; a missing reason falls back to the intent."""
    usable = F.when((reason == "") | (reason == unknown), None).otherwise(reason)
    source = F.coalesce(usable, blank_to_null(intent_col), F.lit(other))
    return F.filter(
        F.transform(F.split(source, "[、，,/]"), strip), lambda tag: F.length(tag) > 0
    )


def turns(text: Column, pack: CallPack = TELECOM) -> Column:
    """``array<struct<role, text>>`` of the non-empty lines, prefixes removed."""

    def parse(line: Column) -> Column:
        prefixes = [F.when(line.startswith(p), F.lit(len(p))) for p in pack.speakers]
        roles = [F.when(line.startswith(p), F.lit(r)) for p, r in pack.speakers.items()]
        cut = F.coalesce(*prefixes, F.lit(0))
        role = F.coalesce(*roles, F.lit(pack.default_speaker))
        return F.struct(
            role.alias("role"), strip(F.substring(line, cut + 1, F.length(line))).alias("text")
        )

    lines = F.transform(F.split(text, "\n"), strip)
    return F.filter(F.transform(lines, parse), lambda t: F.length(t["text"]) > 0)


def bigrams(text: Column, noise: str = BIGRAM_NOISE) -> Column:
    """Overlapping character pairs of the cleaned text; a single character stands for itself.

    The look-ahead walks the text once. Taking ``substring`` at every position would scan
    from the start each time, which is quadratic for long transcripts.
    """
    clean = F.regexp_replace(text, f"(?U)[{noise}]+", "")
    return let(
        clean,
        lambda t: F.when(F.length(t) >= 2, F.regexp_extract_all(t, F.lit("(?s)(?=(..))."), F.lit(1)))
        .when(F.length(t) == 1, F.array(t))
        .otherwise(F.array().cast("array<string>")),
    )


def emotion_vote(raw: Column) -> Column:
    """Most frequent meaningful emotion tag; the one seen first wins a tie."""
    tags = F.regexp_extract_all(
        F.coalesce(raw, F.lit("")), F.lit(r"<\|(" + "|".join(EMOTION_TAGS) + r")\|>"), F.lit(1)
    )
    meaningful = F.filter(tags, lambda tag: ~tag.isin(*EMOTION_NOISE))

    def vote(seen: Column) -> Column:
        scored = F.transform(
            F.array_distinct(seen),
            lambda tag, i: F.struct(
                F.size(F.filter(seen, lambda other: other == tag)).alias("n"),
                (-i).alias("first"),
                tag.alias("tag"),
            ),
        )
        return F.coalesce(F.array_max(scored)["tag"], F.lit("NEUTRAL"))

    return let(meaningful, vote)


def has_audio_suffix(path: Column, suffixes: Sequence[str] = AUDIO_SUFFIXES) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*suffixes)


