"""JSON that models return: cleaning, parsing and strict validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from ..schemas import MODEL_ANALYSIS
from .base import blank_to_null, let, strip


def unfence(text: Column) -> Column:
    """Drop a surrounding code fence and its language tag."""

    def clean(t: Column) -> Column:
        body = F.regexp_replace(t, r"^```[^\n]*\n?", "")
        body = F.regexp_replace(body, r"(?U)```\s*$", "")
        body = F.regexp_replace(strip(body), r"(?U)^json\s*", "")
        return F.when(t.startswith("```"), body).otherwise(t)

    return let(strip(text), clean)


def _valid(json: Column) -> Column:
    """The text itself when it is JSON, else null."""
    return let(json, lambda t: F.when(F.try_parse_json(t).isNotNull(), t))


def rescue_json(text: Column) -> Column:
    """JSON text of a model answer: the unfenced text, else its widest braces; null if neither parses."""
    return let(
        text,
        lambda t: F.coalesce(
            _valid(unfence(t)), _valid(blank_to_null(F.regexp_extract(t, r"(?s)\{.*\}", 0)))
        ),
    )


def strict_json(text: Column) -> Column:
    """JSON text of an answer that must be an object as it stands; null otherwise."""
    return let(
        unfence(text),
        lambda t: F.when(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), t),
    )


def parse_struct(text: Column, schema: T.StructType = MODEL_ANALYSIS) -> Column:
    """JSON text to a struct. Anything that is no object gives null instead of a struct of nulls;
    a field of another type than asked is null in its struct."""
    shape = F.schema_of_variant(F.try_parse_json(text))
    return F.when(shape.startswith("OBJECT"), F.from_json(text, schema))


@dataclass(frozen=True)
class ResponseContract:
    booleans: tuple[str, ...]
    unit_numbers: tuple[str, ...]
    reason: str
    # (claim, what it requires, what it excludes)
    implications: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]

    @property
    def fields(self) -> tuple[str, ...]:
        return (*self.booleans, *self.unit_numbers, self.reason)


# ---- fixed values: fields of the avatar answer ------------------------------------------
AVATAR_CONTRACT = ResponseContract(
    booleans=("has_face", "is_blurry", "is_face_blurry", "is_avatar"),
    unit_numbers=("clarity_confidence", "avatar_confidence"),
    reason="reason",
    implications=(
        ("is_face_blurry", ("has_face",), ()),
        ("is_avatar", ("has_face",), ("is_blurry", "is_face_blurry")),
    ),
)


def validate_response(text: Column, contract: ResponseContract = AVATAR_CONTRACT) -> Column:
    """``struct<error, value>``: why an answer was refused, or its typed fields.

    Types are judged on the variant itself: a cast would accept the string "true".
    """
    value_type = T.StructType(
        [T.StructField(n, T.BooleanType()) for n in contract.booleans]
        + [T.StructField(n, T.DoubleType()) for n in contract.unit_numbers]
        + [T.StructField(contract.reason, T.StringType())]
    )
    expected = F.array(*[F.lit(n) for n in sorted(contract.fields)])
    numeric = r"(?:BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))"
    kinds = {
        **{n: "BOOLEAN" for n in contract.booleans},
        **{n: numeric for n in contract.unit_numbers},
        contract.reason: "STRING",
    }
    # Fields of a variant object are sorted by name, so one pattern covers keys and types.
    well_typed = "^OBJECT<" + ", ".join(f"{n}: {kinds[n]}" for n in sorted(kinds)) + ">$"

    def refused(json: Column, variant: Column, shape: Column) -> Column:
        """First fault of an answer that has not the right keys and types."""
        is_a = lambda name: F.coalesce(
            F.schema_of_variant(F.try_variant_get(variant, f"$.{name}", "variant")), F.lit("VOID")
        ).rlike(f"^{kinds[name]}$")
        faulty = lambda names: F.exists(F.array(*[is_a(n) for n in names]), lambda right: ~right)
        return (
            F.when(~F.coalesce(shape.startswith("OBJECT"), F.lit(False)), "not_object")
            .when(~F.coalesce(F.array_sort(F.json_object_keys(json)) == expected, F.lit(False)), "fields")
            .when(faulty(contract.booleans), "boolean")
            .when(faulty(contract.unit_numbers), "number")
            .otherwise("reason")
        )

    def judge(answer: Column) -> Column:
        outside, contradiction = F.lit(False), F.lit(False)
        for name in contract.unit_numbers:
            outside = outside | ~answer[name].between(0, 1)
        for claim, needs, excludes in contract.implications:
            broken = F.lit(False)
            for name in needs:
                broken = broken | ~answer[name]
            for name in excludes:
                broken = broken | answer[name]
            contradiction = contradiction | (answer[claim] & broken)
        return (
            F.when(outside, "number")
            .when(contradiction, "contradiction")
            .when(F.length(answer[contract.reason]) == 0, "reason")
        )

    def typed(variant: Column) -> Column:
        get = lambda name, to: F.try_variant_get(variant, f"$.{name}", to)
        return F.struct(
            *[get(n, "boolean").alias(n) for n in contract.booleans],
            *[get(n, "double").alias(n) for n in contract.unit_numbers],
            strip(get(contract.reason, "string")).alias(contract.reason),
        ).cast(value_type)

    def outcome(error: Column, value: Column) -> Column:
        return F.struct(error.alias("error"), value.alias("value"))

    nothing = F.lit(None).cast(value_type)

    def accepted(answer: Column) -> Column:
        return let(judge(answer), lambda e: outcome(e, F.when(e.isNull(), answer).otherwise(nothing)))

    def check(json: Column) -> Column:
        return let(
            F.try_parse_json(json),
            lambda variant: let(
                F.schema_of_variant(variant),
                lambda shape: F.when(shape.rlike(well_typed), let(typed(variant), accepted)).otherwise(
                    outcome(refused(json, variant, shape), nothing)
                ),
            ),
        )

    return let(unfence(text), check)
