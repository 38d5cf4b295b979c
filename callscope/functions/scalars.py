"""Small scalar columns: ids, previews, masks, blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .base import blank_to_null, strip

# ---- fixed values: first bytes of the audio formats, and MIME types by extension ---------
AUDIO_MAGIC = {"52494646": "audio/wav", "494433": "audio/mpeg", "FFFB": "audio/mpeg", "FFF3": "audio/mpeg"}
MIME_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "bmp": "image/bmp",
    "webp": "image/webp",
    "wav": "audio/x-wav",
    "mp3": "audio/mpeg",
    "txt": "text/plain",
    "json": "application/json",
    "html": "text/html",
    "csv": "text/csv",
}
DEFAULT_MIME = "application/octet-stream"


def preview(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def mask_id(value: Column, head: int = 3, tail: int = 4) -> Column:
    return F.concat(F.substring(value, 1, head), F.lit("****"), F.right(value, F.lit(tail)))


def call_id_or_default(call_id: Column, at: Column) -> Column:
    return F.coalesce(blank_to_null(call_id), F.concat(F.lit("call_"), F.date_format(at, "yyyyMMdd_HHmmss")))


def split_blank(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a trimmed, non-empty text, and the rejected rest."""
    trimmed = df.withColumn(text, strip(F.col(text)))
    filled = F.coalesce(F.length(text) > 0, F.lit(False))
    return trimmed.where(filled), trimmed.where(~filled)


def audio_mime(blob: Column) -> Column:
    """MIME type by the first bytes; null when the blob is no audio."""
    head = F.hex(F.substring(blob, 1, 4))
    return F.coalesce(*[F.when(head.startswith(m), F.lit(t)) for m, t in AUDIO_MAGIC.items()])


def is_audio(blob: Column) -> Column:
    return F.coalesce(audio_mime(blob).isNotNull(), F.lit(False))


def blob_text(blob: Column) -> Column:
    """UTF-8 text of a blob, empty when it is not valid UTF-8."""
    return F.coalesce(F.try_validate_utf8(blob.cast("string")), F.lit(""))


def guess_mime(path: Column, given: Column | None = None) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    pairs = [F.lit(x) for pair in MIME_TYPES.items() for x in pair]
    guessed = F.coalesce(F.try_element_at(F.create_map(*pairs), suffix), F.lit(DEFAULT_MIME))
    return guessed if given is None else F.coalesce(blank_to_null(given), guessed)


def rendered(df: DataFrame) -> DataFrame:
    """Every column as a value JSON can carry: text for bytes, ISO text for dates and times."""

    def one(field: T.StructField) -> Column:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.BinaryType):
            return F.make_valid_utf8(col.cast("string"))
        if isinstance(field.dataType, T.DateType):
            return F.date_format(col, "yyyy-MM-dd")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.concat(
                F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"),
                F.when(F.date_format(col, "SSSSSS") == "000000", "").otherwise(F.date_format(col, ".SSSSSS")),
            )
        return col

    return df.select(*[one(f).alias(f.name) for f in df.schema.fields])
