"""Numbers and running sums inside groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def bucket_count(df: DataFrame) -> int:
    """Buckets for each group: a group of all rows still gives every reduce task only a part."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(rows: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[str], amount: str, out: str, label: str) -> DataFrame:
    """``rows`` (a stored table) with ``out``: the sum of ``amount`` over the rows of the group before this one.

    Rows are ordered by bucket, then by ``order``. Buckets are summed first, a window runs over
    the sums, and another over the rows of one bucket. Rows that tie in everything are alike.
    """
    keyed = rows.withColumn("_bucket", bucket)
    sums = keyed.groupBy(*group, "_bucket").agg(F.sum(amount).alias("_sum"))
    over = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(sums.withColumn("_start", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum"), label)
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return placed.join(starts, [*group, "_bucket"]).withColumn(out, F.col("_start") + F.col("_in")).drop("_bucket", "_start", "_in")
