"""Joins of points with the spans that hold them, by equal keys instead of a nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored

#: Rows of a bin that one task joins.
HOT = 200_000
#: Rows of hot bins that are sent to every task; more are joined by a shuffle.
_FEW = 200_000


def _micros(at: Column) -> Column:
    """Time as microseconds, numbers as they are."""
    return F.unix_micros(at.cast("timestamp"))


def range_join(
    points: DataFrame, spans: DataFrame, at: str, start: str, end: str, by: Sequence[str] = (), least: float = 1.0, hot: int = HOT
) -> DataFrame:
    """Rows of ``points`` with the rows of ``spans`` whose ``[start, end]`` holds ``at``, and equal ``by``.

    Columns that both have, but for ``by``, must differ in name. Times, dates and numbers will do; null
    ends, and spans that end before they start, hold nothing.

    A span goes to a level by its length: the bins of a level are ``least`` (seconds, or the unit of a
    number) times a power of two wide, no narrower than the span, so a span lies in two bins of its level
    at most, however long it is. A point looks up its bin at each level that has spans. What
    is met is an equal key, and the range is a filter behind it. Bins that hold more than ``hot`` points
    are dealt over salts, and only their spans are copied to each.
    """
    clash = (set(points.columns) & set(spans.columns)) - set(by)
    if clash:
        raise ValueError(f"columns in both tables: {sorted(clash)}")
    numeric = dict(points.dtypes)[at] not in ("timestamp", "timestamp_ntz", "date")
    value = (lambda c: F.col(c).cast("double")) if numeric else (lambda c: _micros(F.col(c)) / 1e6)
    low, high = value(start), value(end)
    level = F.greatest(F.ceil(F.log2(F.greatest(high - low, F.lit(least)) / least)), F.lit(0)).cast("int")
    width = lambda lv: F.lit(least) * F.pow(F.lit(2.0), lv)
    bin_of = lambda x, lv: F.floor(x / width(lv)).cast("bigint")
    held = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end))).withColumn("_level", level)
    held = held.withColumn("_bin", F.explode(F.sequence(bin_of(low, F.col("_level")), bin_of(high, F.col("_level")))))
    # As many levels as doublings between the shortest and the longest span.
    levels = sorted(r["_level"] for r in held.select("_level").distinct().collect())
    if not levels:
        return points.limit(0).join(spans, list(by)) if by else points.limit(0).crossJoin(spans.limit(0))
    asked = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.lit([int(x) for x in levels])))
    asked = asked.withColumn("_bin", bin_of(value(at), F.col("_level")))

    keys = [*by, "_level", "_bin"]
    crowded = stored(asked.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot), "range-hot")
    salts = crowded.select(*keys, F.ceil(F.col("_n") / hot).cast("int").alias("_salts"))
    salts = F.broadcast(salts) if salts.count() <= _FEW else salts
    dealt = asked.join(salts, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copied = held.join(salts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copied, [*keys, "_salt"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_level", "_bin", "_salt")
