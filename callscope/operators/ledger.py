"""Answers of a model kept by the content they were given for, so that nothing is asked twice.

A ledger is a folder of Parquet: ``version=V/batch=B`` holds ``text_hash, value`` of what version ``V``
answered in batch ``B``. A text is asked only if no batch of the version has its hash, and once however
often it occurs. A batch that is repeated after a failure overwrites its folder, which is complete or
absent. Errors are not answers: they are reported in their run and asked again in the next.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stored
from .models import call_model

#: Rows that share a text beyond which its answer is sent to them.
HOT = 100_000
_FEW = 200_000
_SCHEMA = "text_hash string, value {returns}, version string, batch string"


def read_ledger(spark: SparkSession, path: str, version: str | None = None, returns: str = "string") -> DataFrame:
    """``text_hash, value, version, batch``; empty where nothing was written yet."""
    schema = _SCHEMA.format(returns=returns)
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows if version is None else rows.where(F.col("version") == version)


def answered(
    df: DataFrame, text: str, factory: Callable[[], Callable[..., Any]], path: str, version: str, batch: str,
    returns: str = "string", micro_batch: int = 8, partitions: int | None = None, hot: int = HOT,
) -> DataFrame:
    """``df`` with ``_call``, the ``struct<value, error>`` of ``call_model`` on ``text``, from the ledger or the model.

    The call that fills the ledger runs here, before the frame is returned. Null texts are not asked.
    ``partitions`` bounds the calls under way.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_hash", F.sha2(F.col(text).cast("binary"), 256))
    hashed = keyed.where(F.col("_hash").isNotNull())
    different = stored(hashed.groupBy("_hash").agg(F.count("*").alias("_n")), "ledger-hashes")
    # What this batch wrote in an earlier, failed try does not count: it is written again.
    before = read_ledger(spark, path, version, returns).where(F.col("batch") != batch).select("text_hash")
    missing = stored(different.join(before.distinct(), different["_hash"] == before["text_hash"], "left_anti").select("_hash"), "ledger-missing")
    # Texts are fetched for what is asked only, and dealt at most once, after each task has dropped its repeats.
    texts = hashed.select("_hash", F.col(text).alias("_text"))
    once = lambda rows: rows.groupBy("_hash").agg(F.first("_text").alias("_text"))
    unseen = once(texts.join(F.broadcast(missing), "_hash", "left_semi")) if missing.count() <= _FEW else once(texts).join(missing, "_hash", "left_semi")
    if partitions is not None:
        unseen = unseen.repartition(partitions)
    asked = stored(unseen.select(F.col("_hash").alias("text_hash"), call_model([F.col("_text")], factory, returns, micro_batch).alias("_call")), "ledger-asked")
    fresh = asked.where(F.col("_call.error").isNull()).select("text_hash", F.col("_call.value").alias("value"))
    fresh.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}/batch={batch}")

    found = read_ledger(spark, path, version, returns)
    known = found.groupBy("text_hash").agg(F.min_by("value", "batch").alias("value")).select("text_hash", F.struct("value", F.lit(None).cast("string").alias("error")).alias("_call"))
    failed = asked.where(F.col("_call.error").isNotNull()).select("text_hash", "_call")
    answers = known.unionByName(failed)
    # A text of a third of all rows is one row here; its answer goes to them instead of they to it.
    crowd = stored(different.where(F.col("_n") > hot).select("_hash"), "ledger-hot")
    few = crowd.count()
    if few > _FEW:  # more hot texts than can be sent: adaptive execution splits what is left
        few = 0
        crowd = crowd.limit(0)
    rest = keyed.join(F.broadcast(crowd), "_hash", "left_anti") if few else keyed
    out = rest.join(answers, rest["_hash"] == answers["text_hash"], "left").drop("text_hash")
    if few:
        told = answers.join(F.broadcast(crowd), answers["text_hash"] == crowd["_hash"], "left_semi")
        out = out.unionByName(keyed.join(F.broadcast(told), keyed["_hash"] == told["text_hash"]).drop("text_hash"))
    return out.drop("_hash")
