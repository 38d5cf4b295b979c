"""Filtered reading of tables: predicates, top-k, projections, union browse."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, functions as F

MAX_BROWSE = 200
MAX_TOP_K = 20

# ---- fixed values: columns of results, ready-made predicates -----------------------------
RESULT_COLUMNS = (
    "doc_id", "text_emotion", "bad_tone", "emotion_score", "downgrade_related",
    "primary_reason", "secondary_reason",
)
PREDICATES = {
    "avatars": "is_avatar = true",
    "not_ok": "analysis_status != 'ok'",
    "bad_tone": "bad_tone = true",
    "at_risk": "bad_tone = true OR downgrade_related = true",
}


def check_limit(limit: int, most: int = MAX_BROWSE) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return limit


@dataclass(frozen=True)
class Result:
    """Rows of a query and, on request, how many rows matched before the limit."""

    rows: DataFrame
    matching: DataFrame
    where: str | None

    def matched(self) -> int:
        return self.matching.count()

    def returned(self) -> int:
        return self.rows.count()


def scalar_query(
    df: DataFrame,
    where: str | None,
    top_k: int | None,
    columns: Sequence[str] | None = None,
    lenient: bool = False,
    order_by: Sequence[str] = (),
    drop: Sequence[str] = (),
    most_k: int | None = None,
) -> Result:
    """Rows that satisfy a predicate written as SQL.

    ``top_k`` limits them; None takes all, and a number must be 1 to ``most_k`` if that is given.
    A predicate that does not resolve raises ``ValueError``. With ``lenient`` it is dropped
    instead and, as for no predicate at all in that mode, every row is returned.
    """
    if top_k is not None and most_k is not None:
        check_limit(top_k, most_k)
    kept = [c for c in (columns or df.columns) if c in df.columns and c not in drop]
    matching, used = df, None
    if where:
        try:
            matching, used = df.where(where), where
        except (AnalysisException, ParseException) as error:
            if not lenient:
                raise ValueError(f"invalid predicate: {where}") from error
    ordered = matching.orderBy(*order_by) if order_by else matching
    rows = ordered.select(*kept)
    if top_k is not None and not (lenient and used is None):
        rows = rows.limit(top_k)
    return Result(rows, matching, used)


def duration_gate(df: DataFrame, low: float, high: float, column: str = "duration_s") -> DataFrame:
    return df.where(F.col(column).between(low, high))


def members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in another frame."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def public_view(
    df: DataFrame, key: str = "doc_id", drop: Sequence[str] = ("image_blob", "image_embedding"),
    url_prefix: str = "/api/image/assets/",
) -> DataFrame:
    """Without the large columns, with the address of a preview."""
    return df.drop(*drop).withColumn("preview_url", F.concat(F.lit(url_prefix), F.col(key).cast("string")))


def unified_browse(frames: Mapping[str, DataFrame | None], limit: int | None, order_by: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of several tables one below the other, tagged with where they come from.

    ``limit`` holds per table; a table that is missing is skipped.
    """
    out: DataFrame | None = None
    for tag, frame in frames.items():
        if frame is None:
            continue
        if order_by and tag in order_by:
            frame = frame.orderBy(order_by[tag])
        if limit is not None:
            frame = frame.limit(check_limit(limit))
        frame = frame.select(F.lit(tag).alias("_dataset"), "*")
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    if out is None:
        raise ValueError("no table to browse")
    return out


def top_k(df: DataFrame, score: str, key: str, k: int, floor: float | None = None) -> DataFrame:
    """Best rows by score, ties by key, below-floor rows left out."""
    best = df.orderBy(F.col(score).desc(), F.col(key)).limit(k)
    return best if floor is None else best.where(F.col(score) >= floor)


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with a key, or no row. The value is bound, never spliced into text."""
    return df.where(F.col(key) == F.lit(value)).limit(1)
