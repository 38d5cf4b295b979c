"""Table schemas and status vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<float>": T.ArrayType(T.FloatType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def struct(columns: str) -> T.StructType:
    """Schema from ``name type [not null], ...``; unlike a DDL string it needs no session."""
    fields = []
    for column in columns.split(", "):
        name, kind, *rest = column.split(" ")
        fields.append(T.StructField(name, _TYPES[kind], not rest))
    return T.StructType(fields)


CALL_ANALYSIS = struct(
    "call_id string not null, transcript string, caller_intent string, switch_reason string, "
    "sentiment string, sentiment_score float, risk_level string, key_entities string, "
    "suggested_action string, summary string, duration_seconds int, embedding array<float>, "
    "processed_at string"
)
CALL_EMBEDDING_DIM = 16

DAILY_CHURN = struct(
    "date date, total_calls int, churn_intent_count int, high_risk_count int, "
    "medium_risk_count int, low_risk_count int, negative_sentiment_count int, "
    "top_switch_reason string, avg_sentiment_score float, processed_at timestamp_ntz"
)


IMAGE = struct(
    "doc_id string not null, description string, source_path string, mime_type string, "
    "image_blob binary, width int, height int, analysis_status string, analysis_backend string, "
    "analysis_error string, face_count int, face_score double, face_area_ratio double, "
    "blur_score double, face_blur_score double, has_face boolean, is_blurry boolean, "
    "is_face_blurry boolean, is_avatar boolean, clarity_confidence double, "
    "avatar_confidence double, analysis_reason string, embedding_status string, "
    "embedding_error string, embedding_model string, image_embedding array<float>"
)

MODEL_ANALYSIS = struct(
    "downgrade_related boolean, primary_reason string, secondary_reason string, summary string, "
    "confidence double, text_emotion string, bad_tone boolean, emotion_score double"
)

IMAGE_MANIFEST = struct(
    "doc_id string, file string, scenario string, expected_avatar boolean, description string, "
    "mime_type string"
)

RAW_TRANSCRIPT = struct("call_id string, transcript string, timestamp string, metadata map<string,string>")

# Fixed vocabularies.
RISK_LEVELS = ("high", "medium", "low")
OBJECT_PREFIXES = ("raw_audio", "voice_analysis", "analytics")
