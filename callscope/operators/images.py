"""Image policy over metrics that a detector or a vision model delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.base import let
from ..packs import AVATAR_MESSAGES, AvatarLimits

LONG_EDGE = 1024

ANALYSIS_COLUMNS = {
    "width": "int", "height": "int", "face_count": "int", "face_score": "double",
    "face_area_ratio": "double", "blur_score": "double", "face_blur_score": "double",
    "has_face": "boolean", "is_blurry": "boolean", "is_face_blurry": "boolean",
    "is_avatar": "boolean", "clarity_confidence": "double", "avatar_confidence": "double",
    "analysis_reason": "string",
}


def largest_face(faces: Column) -> Column:
    """The box with the largest area, the first one on a tie; null without faces."""
    area = lambda f: (f["x2"] - f["x1"]) * (f["y2"] - f["y1"])
    ranked = F.transform(faces, lambda f, i: F.struct(area(f).alias("area"), (-i).alias("first"), f.alias("face")))
    return F.array_max(ranked)["face"]


def resized_dims(width: Column, height: Column, edge: int = LONG_EDGE) -> Column:
    """``struct<width, height>`` after shrinking the long edge; smaller images keep their size."""
    longest = F.greatest(width, height)
    scaled = lambda side: F.when(longest <= edge, side.cast("int")).otherwise(
        F.greatest(F.lit(1), F.bround(side * (F.lit(float(edge)) / longest), 0).cast("int"))
    )
    return F.struct(scaled(width).alias("width"), scaled(height).alias("height"))


def clip_box(box: Column, width: Column, height: Column) -> Column:
    """Box cut to the image in whole pixels; null when nothing of it is left."""
    whole = lambda c: c.cast("int")
    cut = F.struct(
        F.greatest(F.lit(0), whole(box["x1"])).alias("x1"),
        F.greatest(F.lit(0), whole(box["y1"])).alias("y1"),
        F.least(whole(width), whole(box["x2"])).alias("x2"),
        F.least(whole(height), whole(box["y2"])).alias("y2"),
    )
    return let(cut, lambda b: F.when((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), b))


def avatar_rules(
    df: DataFrame, faces: str = "faces", limits: AvatarLimits = AvatarLimits(),
    messages: dict[str, str] = AVATAR_MESSAGES,
) -> DataFrame:
    """Face, blur and avatar flags with the reason, from faces, width, height and sharpness.

    Score and ratio come from the largest face even when another one passes; the count is
    that of all boxes.
    """
    size = resized_dims(F.col("width"), F.col("height"))
    df = df.withColumns({"_face": largest_face(F.col(faces)), "_size": size})
    area = F.greatest(
        F.lit(0.0), (F.col("_face.x2") - F.col("_face.x1")) * (F.col("_face.y2") - F.col("_face.y1"))
    )
    pixels = (F.col("_size.width").cast("double") * F.col("_size.height"))
    df = df.withColumns(
        {
            "face_count": F.coalesce(F.size(faces), F.lit(0)),
            "face_score": F.coalesce(F.col("_face.score").cast("double"), F.lit(0.0)),
            "face_area_ratio": F.coalesce(area / pixels, F.lit(0.0)),
        }
    )
    has_face = (
        (F.col("face_count") > 0)
        & (F.col("face_score") >= limits.score_min)
        & (F.col("face_area_ratio") >= limits.face_ratio_min)
    )
    df = df.withColumns({"has_face": has_face, "is_blurry": F.col("blur_score") < limits.blur_min})
    df = df.withColumn(
        "is_face_blurry",
        F.col("has_face") & F.coalesce(F.col("face_blur_score") < limits.face_blur_min, F.lit(False)),
    )
    small = F.col("face_area_ratio") < limits.avatar_ratio_min
    df = df.withColumn(
        "is_avatar",
        (F.col("face_count") == 1) & F.col("has_face") & ~small & ~F.col("is_blurry") & ~F.col("is_face_blurry"),
    )
    text = lambda name: F.lit(messages[name])
    listed = F.concat_ws(
        "；",
        F.when(~F.col("has_face"), text("no_face")).when(F.col("face_count") != 1, text("not_single")),
        F.when(F.col("has_face") & small, text("too_small")),
        F.when(F.col("is_blurry"), text("blurry")),
        F.when(F.col("is_face_blurry"), text("face_blurry")),
    )
    reason = F.when(F.length(listed) > 0, listed).otherwise(text("pass"))
    return df.withColumn("analysis_reason", reason).drop("_face", "_size")


def reset_analysis(df: DataFrame, backend: str) -> DataFrame:
    """Clear every analysis column, so that results of two backends never mix."""
    if backend not in ("local", "vlm"):
        raise ValueError("backend must be local or vlm")
    blank = {name: F.lit(None).cast(kind) for name, kind in ANALYSIS_COLUMNS.items()}
    return df.withColumns(
        {**blank, "analysis_backend": F.lit(backend), "analysis_error": F.lit(None).cast("string")}
    )


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def assign_status(
    df: DataFrame, blob: str = "image_blob", decodable: str = "decodable", model_error: str | None = None,
    messages: dict[str, str] = AVATAR_MESSAGES, error_chars: int | None = None,
) -> DataFrame:
    """Row outcome: no blob, undecodable, model failure or ok, with the error text, cut to ``error_chars``."""
    present = F.coalesce(F.length(F.col(blob)) > 0, F.lit(False))
    readable = F.coalesce(F.col(decodable), F.lit(False))
    error = F.lit(None).cast("string") if model_error is None else F.col(model_error)
    status = (
        F.when(~present, "download_failed")
        .when(~readable, "decode_failed")
        .when(error.isNotNull(), "llm_failed")
        .otherwise("ok")
    )
    detail = (
        F.when(~present, F.lit(messages["missing"]))
        .when(~readable, F.lit(messages["undecodable"]))
        .otherwise(_cut(error, error_chars))
    )
    return df.withColumns({"analysis_status": status, "analysis_error": detail})


def embedding_status(
    df: DataFrame, model: str, dim: int, blob: str = "image_blob", decodable: str = "decodable",
    vector: str = "image_embedding", error: str | None = None,
    messages: dict[str, str] = AVATAR_MESSAGES, error_chars: int | None = None,
) -> DataFrame:
    """Row outcome of the embedding stage: skipped, failed or ok; only ok rows keep a vector."""
    present = F.coalesce(F.length(F.col(blob)) > 0, F.lit(False))
    readable = F.coalesce(F.col(decodable), F.lit(False))
    right = F.coalesce(F.size(F.col(vector)) == dim, F.lit(False))
    given = F.lit(None).cast("string") if error is None else F.col(error)
    fine = present & readable & right & given.isNull()
    status = F.when(~present, "skipped").when(fine, "ok").otherwise("failed")
    detail = (
        F.when(~present, F.lit(messages["missing"]))
        .when(~readable, F.lit(messages["undecodable"]))
        .when(given.isNotNull(), _cut(given, error_chars))
        .when(~right, F.lit("vector missing or of the wrong length"))
    )
    return df.withColumns(
        {
            "embedding_status": status,
            "embedding_error": detail,
            "embedding_model": F.lit(model),
            vector: F.when(fine, F.col(vector)),
        }
    )


def require_embedded(df: DataFrame) -> int:
    """Number of embedded rows; raises when the whole stage produced none."""
    done = df.agg(F.count_if(F.col("embedding_status") == "ok")).first()[0]
    if done == 0:
        raise RuntimeError("no image was embedded")
    return done


def label_accuracy(df: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Confusion counts of expected and actual avatar flags, rows without either left out."""
    joined = df.select(key, "is_avatar").join(labels.select(key, "expected_avatar"), key)
    known = joined.where(F.col("is_avatar").isNotNull() & F.col("expected_avatar").isNotNull())
    return known.groupBy("expected_avatar", "is_avatar").agg(F.count("*").alias("images"))


def accuracy(confusion: DataFrame) -> DataFrame:
    right = F.sum(F.when(F.col("expected_avatar") == F.col("is_avatar"), F.col("images")).otherwise(0))
    return confusion.agg(
        right.alias("correct"), F.sum("images").alias("total"), (right / F.sum("images")).alias("accuracy")
    )


def laplacian_variance(pixels: DataFrame, image: str, y: str = "y", x: str = "x", luma: str = "luma") -> DataFrame:
    """Sharpness per image from a pixel table: population variance of the four-neighbour Laplacian.

    A border pixel sees its inner neighbour twice. The windows run over one row or column of
    one image, so no task holds a whole image.
    """
    row, column = Window.partitionBy(image, y).orderBy(x), Window.partitionBy(image, x).orderBy(y)

    def around(window) -> Column:
        before, after = F.lag(luma).over(window), F.lead(luma).over(window)
        own = F.col(luma)
        return F.coalesce(before, after, own) + F.coalesce(after, before, own)

    sums = pixels.select(image, y, x, F.col(luma).cast("double").alias(luma)).withColumn("_h", around(row))
    sums = sums.withColumn("_v", around(column))
    return sums.groupBy(image).agg(
        F.var_pop(F.col("_h") + F.col("_v") - 4 * F.col(luma)).alias("blur_score")
    )
