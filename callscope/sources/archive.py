"""JSON archive of transcripts, analyses and daily rows under object prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import OBJECT_PREFIXES, RAW_TRANSCRIPT
from .files import list_objects


def raw_documents(df: DataFrame, id: str = "call_id", text: str = "transcript") -> DataFrame:
    """Transcripts in the form they are archived in."""
    metadata = F.col("metadata") if "metadata" in df.columns else F.create_map().cast("map<string,string>")
    return df.select(
        F.col(id).cast("string").alias("call_id"),
        F.col(text).alias("transcript"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
        metadata.alias("metadata"),
    )


def analysis_documents(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("call_id").cast("string").alias("call_id"),
        F.col("caller_intent").alias("intent"),
        F.col("switch_reason").alias("reason"),
        "sentiment",
        F.col("risk_level").alias("risk"),
        "summary",
        F.col("suggested_action").alias("action"),
    )


def archive(df: DataFrame, folder: str, prefix: str, mode: str = "append") -> None:
    """Write documents as JSON lines below one of the prefixes; batched, not one file per row."""
    if prefix not in OBJECT_PREFIXES:
        raise ValueError(f"prefix must be one of {', '.join(OBJECT_PREFIXES)}")
    df.write.mode(mode).json(f"{folder.rstrip('/')}/{prefix}")


def read_archive(spark: SparkSession, folder: str, prefix: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read
    if schema is None and prefix == "raw_audio":
        schema = RAW_TRANSCRIPT
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(f"{folder.rstrip('/')}/{prefix}")


def document(archived: DataFrame, key: str, value: object) -> dict | None:
    """One archived document by its id or date."""
    row = archived.where(F.col(key) == F.lit(value)).limit(1).first()
    return None if row is None else row.asDict(recursive=True)


def object_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Number of stored files per prefix; the sum of the rows is the total."""
    listed = list_objects(spark, folder).withColumn(
        "prefix", F.regexp_extract("path", "/(" + "|".join(OBJECT_PREFIXES) + ")/", 1)
    )
    return listed.where(F.col("prefix") != "").groupBy("prefix").agg(
        F.count("*").alias("objects"), F.sum("size").alias("bytes")
    )
