"""The batch jobs, each one lazy plan from its source to its result columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules as R
from ..functions.jsontext import parse_struct, validate_response
from ..functions.scalars import audio_mime, blob_text, is_audio
from ..functions.text import duration, quality_prompt, redact
from ..functions.vectors import hash_embedding
from ..operators.browse import duration_gate
from ..operators.images import assign_status, avatar_rules, reset_analysis
from ..operators.models import call_model, enrich
from ..packs import (
    AvatarLimits, TELECOM_ACOUSTIC, TELECOM_REASONS, TELECOM_RULES,
    AcousticPack, ReasonPack, RulePack,
)
from ..schemas import MODEL_ANALYSIS


def call_batch(
    calls: DataFrame, factory: Callable[[], Callable[..., Any]] | None = None, blob: str | None = "audio_blob",
    measured: Column | None = None, rms: Column | None = None, acoustic: AcousticPack = TELECOM_ACOUSTIC,
    reasons: ReasonPack = TELECOM_REASONS, rules: RulePack = TELECOM_RULES, summary_chars: int | None = None,
) -> DataFrame:
    """Duration, acoustic emotion, redaction, analysis and embedding of calls, in one pass.

    Input: ``doc_id``, ``transcript`` and, optionally, a blob that holds audio or the text.
    """
    text = F.coalesce(F.col("transcript"), F.lit(""))
    if blob:
        text = F.when(F.length(text) > 0, text).when(~is_audio(F.col(blob)), blob_text(F.col(blob))).otherwise("")
    base = calls.select("doc_id", text.alias("transcript"), *([audio_mime(F.col(blob)).alias("audio_mime")] if blob else []),
                        *([measured.alias("_measured")] if measured is not None else []),
                        *([rms.alias("_rms")] if rms is not None else []))
    own = F.col("transcript")
    tagged = base.withColumns(
        {
            "duration_s": duration(own, F.col("_measured") if measured is not None else None),
            "acoustic_emotion": R.acoustic_emotion(own, F.col("_rms") if rms is not None else None, acoustic),
            "audio_embedding": F.transform(hash_embedding(own), lambda x: x.cast("float")),
        }
    ).drop("_measured", "_rms")
    if factory is None:
        redacted = tagged.withColumn("transcript_redacted", redact(own))
        return redacted.withColumns(
            {**R.rule_analysis(F.col("transcript_redacted"), rules, summary_chars), "model_used": F.lit(False)}
        )
    # The input columns go along, so that repeated and null ids keep a row each.
    kept = [c for c in tagged.columns if c != "doc_id"]
    return enrich(tagged, "doc_id", "transcript", factory, reasons, rules, keep=kept, summary_chars=summary_chars)


QUALITY_COLUMNS = (
    "doc_id", "duration_s", "transcript", "acoustic_emotion", *[f.name for f in MODEL_ANALYSIS.fields], "model_error",
)


def quality_job(
    calls: DataFrame, low: float, high: float, factory: Callable[[], Callable[..., Any]] | None = None,
) -> DataFrame:
    """Toolkit job: gate by duration, redact without boundaries, prompt a model, parse, fill.

    Input: ``doc_id, audio_blob, duration_s, transcript, acoustic_emotion`` (speech
    recognition has run). Without a model every analysis column gets its default. ``model_error``
    tells why the model failed on a row, which then has the defaults.
    """
    gated = duration_gate(calls.where(F.col("audio_blob").isNotNull()), low, high)
    clean = gated.withColumn("transcript", redact(F.col("transcript"), boundaries=False))
    if factory is None:
        answered = clean.withColumns({"_json": F.lit(None).cast("string"), "model_error": F.lit(None).cast("string")})
    else:
        asked = call_model([quality_prompt(F.col("transcript"), F.col("acoustic_emotion"))], factory)
        called = clean.withColumn("_called", asked)
        answered = called.withColumns({"_json": F.col("_called.value"), "model_error": F.col("_called.error")})
    parsed = answered.withColumn("_a", parse_struct(F.col("_json")))
    opened = parsed.withColumns({f.name: F.col(f"_a.{f.name}") for f in MODEL_ANALYSIS.fields})
    return opened.withColumns(R.fill_defaults()).select(*QUALITY_COLUMNS)


def image_batch(images: DataFrame, backend: str = "local", limits: AvatarLimits = AvatarLimits()) -> DataFrame:
    """Analysis stage of the image table.

    ``local`` needs ``decodable, faces, width, height, blur_score, face_blur_score``;
    ``vlm`` needs ``decodable`` and the model's answer text as ``answer``. A failed row keeps
    its status and gets no result of the other backend.
    """
    names = ("width", "height", "blur_score", "face_blur_score")
    kept = images.withColumns({f"_in_{n}": F.col(n) for n in names if n in images.columns})
    reset = reset_analysis(kept, backend)
    restored = reset.withColumns({n: F.col(f"_in_{n}") for n in names if n in images.columns})
    if backend == "vlm":
        checked = restored.withColumn("_checked", validate_response(F.col("answer"))).withColumn(
            "_error", F.coalesce(F.col("_checked.error"), F.when(F.col("answer").isNull(), "no answer"))
        )
        done = assign_status(checked, model_error="_error")
        ok = F.col("analysis_status") == "ok"
        flags = ("has_face", "is_blurry", "is_face_blurry", "is_avatar", "clarity_confidence", "avatar_confidence")
        values = {n: F.when(ok, F.col(f"_checked.value.{n}")) for n in flags}
        values["analysis_reason"] = F.when(ok, F.col("_checked.value.reason"))
        return done.withColumns(values).drop("_checked", "_error", *[f"_in_{n}" for n in names])
    done = assign_status(avatar_rules(restored, limits=limits))
    ok = F.col("analysis_status") == "ok"
    results = (
        "face_count", "face_score", "face_area_ratio", "has_face", "is_blurry", "is_face_blurry",
        "is_avatar", "analysis_reason", *names,
    )
    return done.withColumns({n: F.when(ok, F.col(n)) for n in results}).drop(*[f"_in_{n}" for n in names])
