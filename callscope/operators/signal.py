"""Acoustic features from a table of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.base import let
from ..functions.vectors import l2_normalize

BLOCK = 4096
#: Blocks that share a salt: a signal spreads over as many partitions as it has stretches of these.
SALT_BLOCKS = 16


def signal_features(
    samples: DataFrame, signal: str = "signal_id", idx: str = "idx", value: str = "value", buckets: int = 64
) -> DataFrame:
    """Loudness and zero-crossing rate in ``buckets`` equal stretches per signal, as a unit vector.

    ``idx`` counts the samples of a signal from 0 without gaps. A long signal is worked in
    blocks of 4096 samples: each block also gets the last sample of the block before it, so a
    sign change at the border is seen, and no window holds a whole signal. Length and peak
    come from one aggregate; they are joined on the signal and a salt that counts stretches of
    16 blocks, so the partitions of a signal grow with it. Scaling by the peak is done on the result: it divides
    every loudness and leaves signs alone.
    """
    rows = samples.select(F.col(signal), F.col(idx).cast("bigint").alias("_i"), F.col(value).cast("double").alias("_v"))
    stats = rows.groupBy(signal).agg(F.count("*").alias("_n"), F.max(F.abs("_v")).alias("_peak"))
    # As many copies as a signal has salts; the last border may reach into one more.
    salts = F.floor(F.col("_n") / (BLOCK * SALT_BLOCKS))
    salted = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts)))

    own_block = F.floor(F.col("_i") / BLOCK)
    ends_block = F.col("_i") % BLOCK == BLOCK - 1
    blocks = F.when(ends_block, F.array(own_block, own_block + 1)).otherwise(F.array(own_block))
    blocked = rows.withColumn("_own", own_block).withColumn("_block", F.explode(blocks))
    blocked = blocked.withColumn("_salt", F.floor(F.col("_block") / SALT_BLOCKS))

    joined = blocked.join(salted.drop("_peak"), [signal, "_salt"])
    # The first n % buckets stretches hold one sample more than the others.
    size, extra = F.floor(F.col("_n") / buckets), F.col("_n") % buckets
    long_part = extra * (size + 1)
    bucket_of = lambda i: F.when(i < long_part, F.floor(i / (size + 1))).otherwise(
        extra + F.floor((i - long_part) / F.greatest(size, F.lit(1)))
    )
    order = Window.partitionBy(signal, "_salt", "_block").orderBy("_i")
    negative = F.col("_v") < 0
    stepped = joined.select(
        signal,
        "_v",
        "_own",
        "_block",
        bucket_of(F.col("_i")).alias("_bucket"),
        F.lag(negative).over(order).alias("_before"),
        F.lag(bucket_of(F.col("_i"))).over(order).alias("_bucket_before"),
        negative.alias("_negative"),
    ).where(F.col("_own") == F.col("_block"))
    crossing = F.when(
        F.col("_bucket_before") == F.col("_bucket"), (F.col("_before") != F.col("_negative")).cast("double")
    )
    parts = stepped.groupBy(signal, "_bucket").agg(
        F.sqrt(F.avg(F.col("_v") * F.col("_v"))).alias("_rms"),
        F.coalesce(F.avg(crossing), F.lit(0.0)).alias("_zcr"),
    )
    # At most ``buckets`` rows per signal are collected here.
    gathered = parts.groupBy(signal).agg(
        F.map_from_entries(F.collect_list(F.struct("_bucket", F.struct("_rms", "_zcr")))).alias("_m")
    )
    scaled = gathered.join(stats.select(signal, "_peak"), signal)
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))
    pick = lambda field: F.transform(
        numbers, lambda b: F.coalesce(F.try_element_at(F.col("_m"), b)[field], F.lit(0.0))
    )
    divisor = F.when(F.col("_peak") > 0, F.col("_peak")).otherwise(F.lit(1.0))
    loudness = let(pick("_rms"), lambda r: F.transform(r, lambda x: x / divisor))
    vector = l2_normalize(F.concat(loudness, pick("_zcr")))
    return scaled.select(signal, F.transform(vector, lambda x: x.cast("float")).alias("features"))
