"""Manifests, object listings and file contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import guess_mime
from ..functions.text import has_audio_suffix
from ..packs import AUDIO_SUFFIXES
from ..schemas import IMAGE_MANIFEST


def read_manifest(spark: SparkSession, uri: str, columns: Sequence[str] = ("doc_id", "s3_url")) -> DataFrame:
    """Manifest by file extension: parquet, jsonl, ndjson or csv with a header."""
    name = uri.lower()
    if name.endswith(".parquet"):
        frame = spark.read.parquet(uri)
    elif name.endswith((".jsonl", ".ndjson")):
        frame = spark.read.schema(", ".join(f"{c} string" for c in columns)).json(uri)
    elif name.endswith(".csv"):
        frame = spark.read.option("header", True).csv(uri)
    else:
        raise ValueError(f"unsupported manifest format: {uri}; use parquet, jsonl, ndjson or csv")
    return frame.select(*columns)


def read_json_manifest(spark: SparkSession, uri: str, key: str = "doc_id") -> DataFrame:
    """Manifest held as one JSON array; refuses an empty one and blank or repeated keys."""
    frame = spark.read.schema(IMAGE_MANIFEST).option("multiLine", True).json(uri)
    return check_manifest(frame, key)


def check_manifest(frame: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys are counted once per value, so a repeated key meets no single-task distinct."""
    per_key = frame.groupBy(key).agg(F.count("*").alias("n"))
    bad = F.col(key).isNull() | (F.col(key).cast("string") == "")
    found = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(bad).alias("blank"),
        F.count_if(~bad & (F.col("n") > 1)).alias("repeated"),
    ).first()
    if found["rows"] == 0:
        raise ValueError("the manifest must be a non-empty JSON array")
    if found["blank"]:
        raise ValueError(f"every manifest row needs a non-empty {key}")
    if found["repeated"]:
        raise ValueError(f"{key} must not repeat in the manifest")
    return frame


def list_objects(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Path, size and time of every file; contents are pruned and never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``path, content``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return reader.load(path).select("path", "content")


def build_manifest(spark: SparkSession, path: str, suffixes: Sequence[str] = AUDIO_SUFFIXES) -> DataFrame:
    """Manifest of the media files below a folder, sorted by name."""
    listed = list_objects(spark, path).where(has_audio_suffix(F.col("path"), suffixes))
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), F.col("path").alias("s3_url")).orderBy("doc_id")


def attach_blobs(
    manifest: DataFrame, files: DataFrame, on: str, missing: str = "keep", blob: str = "image_blob",
    text: str | None = None, backup: DataFrame | None = None,
) -> DataFrame:
    """Join file contents (``path, content``) to manifest rows.

    Contents are joined to the distinct paths that the manifest names, not the other way round:
    a file in no manifest is dropped before its content meets a shuffle.

    ``missing`` says what becomes of a row without a file: ``keep`` marks it
    ``download_failed``, ``drop`` leaves it out, ``text`` falls back to the backup files and
    then to the row's own text. With ``text`` the column ``from_audio`` tells the source.
    """
    asked = manifest.select(on).where(F.col(on).isNotNull()).distinct()
    found = files.select(F.col("path").alias(on), F.col("content").alias(blob)).join(asked, on, "left_semi")
    if missing == "drop":
        return manifest.join(found, on).where(F.col(blob).isNotNull())
    if missing == "keep":
        joined = manifest.join(found, on, "left")
        absent = F.col(blob).isNull()
        return joined.withColumns(
            {
                "mime_type": guess_mime(F.col(on), F.col("mime_type") if "mime_type" in manifest.columns else None),
                "analysis_status": F.when(absent, "download_failed").otherwise("pending"),
                "analysis_error": F.when(absent, "file not found"),
                "embedding_status": F.when(absent, "skipped").otherwise("pending"),
            }
        )
    if missing == "text":
        if text is None:
            raise ValueError("missing='text' needs the text column")
        joined = manifest.join(found.withColumnRenamed(blob, "_first"), on, "left")
        # An empty file is none.
        audio = F.when(F.length("_first") > 0, F.col("_first"))
        if backup is not None:
            second = backup.select(F.col("path").alias(on), F.col("content").alias("_second")).join(asked, on, "left_semi")
            joined = joined.join(second, on, "left")
            audio = F.coalesce(audio, F.when(F.length("_second") > 0, F.col("_second")))
        words = F.coalesce(F.col(text), F.lit("")).cast("binary")
        return joined.withColumns({blob: F.coalesce(audio, words), "from_audio": audio.isNotNull()}).drop("_first", "_second")
    raise ValueError("missing must be keep, drop or text")


def blob_lookup(df: DataFrame, key: str, value: object, blob: str = "image_blob", mime: str = "mime_type") -> tuple[bytes, str]:
    """Bytes and MIME type of one row; ``FileNotFoundError`` without a row or without bytes."""
    from ..functions.scalars import DEFAULT_MIME, audio_mime

    kind = F.col(mime) if mime in df.columns else audio_mime(F.col(blob))
    row = df.where(F.col(key) == F.lit(value)).select(F.col(blob).alias("b"), kind.alias("m")).first()
    if row is None or not row["b"]:
        raise FileNotFoundError(str(value))
    return bytes(row["b"]), row["m"] or DEFAULT_MIME


#: Blobs that an exporting worker holds at once.
_BLOBS = 16


def export_name(key: Column) -> Column:
    """File name of an id: the id where it is a short plain name, else ``h_`` and its SHA-256, with its ending if that is plain.

    Plain names hold no underscore, so no two ids share a name.
    """
    text = key.cast("string")
    hashed = F.concat(F.lit("h_"), F.sha2(text.cast("binary"), 256), F.lower(F.regexp_extract(text, r"(\.[A-Za-z0-9]{1,8})$", 1)))
    return F.when(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9.-]{0,99}$"), text).otherwise(hashed)


def export_blobs(df: DataFrame, ids: DataFrame, folder: str, key: str = "doc_id", blob: str = "audio_blob") -> DataFrame:
    """Write the blobs of the given ids to files, and return the list of them: ``key, name, size``.

    Files are named by ``export_name``, so any id will do: of any length, with slashes, a leading
    underscore or ``..``. The list is also written, next to the folder (``read_export``). Null ids and
    blobs that are null or empty are left out; of rows that repeat an id one is written.

    ``folder`` is a path that all executors see, or an address of a store that Arrow writes to
    (``hdfs:``, ``s3:``, ``gs:``, ``file:``). Ids are selected before the blob column is read. On a file
    system a file appears under its name only when complete; a store's object is whole or absent anyway. A task
    that runs again writes the same.
    """
    import re

    from pyarrow import fs

    # Hadoop writes one slash after ``file:``, Arrow asks for three.
    address = re.sub("^(file:)?/+", "file:///", folder)

    def write(batches):
        import uuid

        import pyarrow as pa

        store, base = fs.FileSystem.from_uri(address)
        base = base.rstrip("/")
        local = isinstance(store, fs.LocalFileSystem)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(1).to_pylist(), batch.column(2)):
                target = f"{base}/{name}"
                part = f"{base}/.{uuid.uuid4().hex}" if local else target
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                if local:
                    store.move(part, target)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3)], names=["key", "name", "size"])

    wanted = df.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi").where(F.length(blob) > 0)
    kind = wanted.schema[key].dataType.simpleString()
    rows = wanted.select(F.col(key).alias("key"), export_name(F.col(key)).alias("name"), F.col(blob).alias("content"), F.length(blob).cast("bigint").alias("size"))
    base = folder.rstrip("/")
    done = rows.mapInArrow(write, f"key {kind}, name string, size bigint")
    # Blobs may be large: a worker holds a few of them at once, not the thousands of rows of a usual batch.
    setting, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    usual = conf.get(setting)
    conf.set(setting, str(_BLOBS))
    try:
        done.write.mode("overwrite").parquet(f"{base}__list")
    finally:
        conf.set(setting, usual)
    return read_export(df.sparkSession, base, key)


def read_export(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """``key, name, size`` of the files of an export, one row an id."""
    return spark.read.parquet(f"{folder.rstrip('/')}__list").withColumnRenamed("key", key).dropDuplicates([key])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def few_listing_tasks(spark: SparkSession) -> None:
    """List many paths in some tasks per core; Spark's default is a task for each path, up to ten thousand."""
    setting, most = "spark.sql.sources.parallelPartitionDiscovery.parallelism", max(32, 4 * spark.sparkContext.defaultParallelism)
    spark.conf.set(setting, str(min(most, int(spark.conf.get(setting)))))


def attach_stream(
    spark: SparkSession, manifest: DataFrame, folder: str, on: str, sink: str, checkpoint: str, trigger: dict | None = None, most_files: int | None = None
):
    """Follow a folder and keep what its files say of a manifest's rows; ``read_attached`` joins the two.

    ``on`` holds names of files in that folder. ``most_files`` bounds those of one batch.

    Each batch writes the files that arrived: contents of those that the manifest names, and as ``waiting``
    the contents of the others, which a later manifest may name. Batches overwrite their own folder, so one that
    is repeated changes nothing. A manifest row whose file has not come yet waits without any state: it has no arrival.
    """
    # The stream's source lists a batch's files one by one, and once more when a stream goes on.
    few_listing_tasks(spark)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema(schema)
    files = (reader if most_files is None else reader.option("maxFilesPerTrigger", most_files)).load(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        named = manifest.select(F.col(on).alias("path")).where(F.col(on).isNotNull()).distinct().withColumn("_named", F.lit(True))
        rows = batch.withColumn("path", file_name(F.col("path"))).join(named, "path", "left")
        content = F.col("content")
        rows = rows.select("path", "modificationTime", "length", F.when(F.col("_named"), content).alias("content"), F.when(F.col("_named").isNull(), content).alias("waiting"))
        rows.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_attached(spark: SparkSession, manifest: DataFrame, folder: str, on: str, sink: str, **how) -> DataFrame:
    """``attach_blobs`` of the manifest and the files that have arrived by now, the newest of each path.

    Contents are as they came, also of files that no manifest named then. Only a sink that holds files without
    any contents, as earlier versions wrote them, has those read from ``folder``.
    """
    arrived = spark.read.schema("path string, modificationTime timestamp, length bigint, content binary, waiting binary, batch_id int").parquet(sink)
    asked = manifest.select(F.col(on).alias("path")).where(F.col(on).isNotNull()).distinct()
    came = arrived.join(asked, "path", "left_semi").withColumn("content", F.coalesce("content", "waiting"))
    newest = came.groupBy("path").agg(F.max_by(F.struct("content"), F.struct("modificationTime", "batch_id")).alias("_c")).select("path", F.col("_c.content").alias("content"))
    bare = arrived.where("content is null and waiting is null").select("path")
    if bare.isEmpty():
        return attach_blobs(manifest, newest, on, **how)
    unnamed = newest.where("content is null").select("path")
    late = read_files(spark, folder).withColumn("path", file_name(F.col("path"))).join(unnamed, "path", "left_semi")
    return attach_blobs(manifest, newest.where("content is not null").unionByName(late), on, **how)
