"""Append, merge, rewrite, compact and register Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.bags import bigram_bag
from ..functions.base import let, literal_array
from ..packs import NO_REASON
from ..schemas import CALL_ANALYSIS, CALL_EMBEDDING_DIM, DAILY_CHURN


def shape_analysis(df: DataFrame) -> DataFrame:
    """Analysis rows in the stored schema: defaults for what is missing, entities as JSON."""
    have = set(df.columns)
    get = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    entity_type = df.schema["key_entities"].dataType if "key_entities" in have else None
    if entity_type is None:
        entity_json = F.lit("{}")
    elif isinstance(entity_type, T.StringType):
        entity_json = get("key_entities", "{}")
    else:
        entity_json = F.coalesce(F.to_json("key_entities"), F.lit("{}"))
    text = F.coalesce(*[F.col(c) for c in ("summary", "transcript") if c in have], F.lit(""))
    vector = bigram_bag(text, CALL_EMBEDDING_DIM).cast("array<float>")
    columns: dict[str, Column] = {
        "call_id": get("call_id", ""),
        "transcript": get("transcript", ""),
        "caller_intent": get("caller_intent", ""),
        "switch_reason": get("switch_reason", ""),
        "sentiment": get("sentiment", "neutral"),
        "sentiment_score": get("sentiment_score", 0.0),
        "risk_level": get("risk_level", "low"),
        "key_entities": entity_json,
        "suggested_action": get("suggested_action", ""),
        "summary": get("summary", ""),
        "duration_seconds": get("duration_seconds", 0),
        "embedding": vector,
        "processed_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    }
    return df.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in CALL_ANALYSIS.fields])


def append_analysis(df: DataFrame, path: str) -> None:
    shape_analysis(df).write.mode("append").parquet(path)


def create_table(df: DataFrame, path: str, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def browse(df: DataFrame, limit: int | None, entities: str = "map<string,string>") -> DataFrame:
    """First rows with the entity JSON parsed; bad JSON becomes an empty map."""
    parsed = F.when(F.try_parse_json("key_entities").isNotNull(), F.from_json("key_entities", entities))
    empty = F.create_map().cast(entities)
    some = df if limit is None else df.limit(limit)
    return some.withColumn("key_entities", F.coalesce(parsed, empty))


def merge_columns(
    base: DataFrame, new: DataFrame, key: str = "doc_id", replace: bool = False
) -> tuple[DataFrame, list[str]]:
    """Left-join new columns on the key, all in one join; returns the names added.

    Columns the base already has are skipped, or exchanged with ``replace``. A key that repeats in
    ``new`` gives its base row as often; ``merge_bucketed`` refuses it.
    """
    offered = [c for c in new.columns if c != key]
    taken = offered if replace else [c for c in offered if c not in base.columns]
    if not taken:
        return base, []
    kept = base.drop(*[c for c in taken if c in base.columns])
    return kept.join(new.select(key, *taken), key, "left"), taken


def add_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"{name} already exists; drop it before computing it again")
    return df.withColumn(name, value)


def assert_type(df: DataFrame, column: str, data_type: T.DataType) -> DataFrame:
    actual = df.schema[column].dataType
    if actual != data_type:
        raise TypeError(f"{column} is {actual.simpleString()}, not {data_type.simpleString()}")
    return df


def rewrite(df: DataFrame, path: str) -> str:
    """Write a frame that may read from ``path`` to a new folder next to it and return that.

    Spark cannot overwrite what it reads. The new folder is complete or absent, so a lost
    executor never leaves a half-written table; point readers to it with ``swap``.
    """
    target = f"{path.rstrip('/')}__{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(target)
    return target


def swap(spark: SparkSession, table: str, path: str) -> None:
    """Point a catalog table at another folder: one metastore change, no data moved."""
    quoted = path.replace("'", "\\'")
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{quoted}'")
    spark.catalog.refreshTable(table)


def shape_daily(df: DataFrame, snapshot_id: str, committed_at: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if committed_at is None else committed_at
    have = set(df.columns)

    def column(field: T.StructField) -> Column:
        if field.name == "processed_at":
            source = F.col("processed_at") if "processed_at" in have else now
        elif field.name == "top_switch_reason":
            source = F.coalesce(F.col(field.name), F.lit(NO_REASON)) if field.name in have else F.lit(NO_REASON)
        elif field.name == "date":
            source = F.col("date")
        else:
            source = F.coalesce(F.col(field.name), F.lit(0)) if field.name in have else F.lit(0)
        return source.cast(field.dataType).alias(field.name)

    return df.select(
        *[column(f) for f in DAILY_CHURN.fields],
        F.lit(snapshot_id).alias("snapshot_id"),
        now.cast("timestamp_ntz").alias("committed_at"),
    )


def append_daily(df: DataFrame, path: str, snapshot_id: str | None = None, committed_at: Column | None = None) -> str:
    """Append daily rows, one folder per day, tagged with the snapshot they came with."""
    snapshot = snapshot_id or uuid.uuid4().hex
    shaped = shape_daily(df, snapshot, committed_at)
    # A daily table is a row a day: one writer per date folder avoids a file per task.
    shaped.repartition("date").write.mode("append").partitionBy("date").parquet(path)
    return snapshot


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", False).parquet(path)


def snapshots(daily: DataFrame) -> DataFrame:
    return daily.groupBy("snapshot_id").agg(
        F.min("committed_at").alias("committed_at"), F.count("*").alias("rows"), F.lit("append").alias("operation")
    )


def as_of(daily: DataFrame, snapshot_id: str) -> DataFrame:
    """The daily table as it was right after a snapshot. Snapshots of one instant are ordered by their ids."""
    row = daily.where(F.col("snapshot_id") == snapshot_id).agg(F.min("committed_at").cast("string")).first()
    if row[0] is None:
        raise LookupError(f"no snapshot {snapshot_id}")
    # As text, since a Python time would be shifted by the zone of the session.
    then = F.lit(row[0]).cast("timestamp_ntz")
    at = F.col("committed_at")
    return daily.where((at < then) | ((at == then) & (F.col("snapshot_id") <= snapshot_id)))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def fragmentation(df: DataFrame) -> DataFrame:
    """Number of files, rows and bytes of a table; reads no column, only file metadata."""
    per_file = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).groupBy("f", "b").agg(F.count("*").alias("n"))
    return per_file.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))


def compact(
    spark: SparkSession, path: str, file_bytes: int = 256 << 20, slack: float = 2.0
) -> str | None:
    """Rewrite a table of too many small files; returns the new folder, or None when it is fine.

    It is fine with at most ``slack`` times the files that its bytes fill at ``file_bytes`` each,
    however many rows that is. The new files come from a rebalancing shuffle of that target.
    """
    table = spark.read.parquet(path)
    found = fragmentation(table).first()
    wanted = max(1, -(-found["bytes"] // file_bytes))
    if found["files"] <= max(1, int(slack * wanted)):
        return None
    return rewrite(table.repartition(wanted), path)


#: Steps into which the curve divides each column.
_CURVE_BITS = 10


def _rank_of(column: str, kind: str) -> Column:
    """A number in the order of the column: texts by their first six bytes."""
    if kind == "string":
        return F.conv(F.rpad(F.substring(F.hex(F.col(column)), 1, 12), 12, "0"), 16, 10).cast("double")
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def curve(df: DataFrame, columns: Sequence[str], bits: int = _CURVE_BITS) -> Column:
    """Place of a row on a Z-order curve over the quantiles of some columns; nulls come first.

    Quantiles are taken over all rows, so that skewed columns are divided evenly.
    """
    kinds = dict(df.dtypes)
    points = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(_rank_of(c, kinds[c]), points, 10 << bits).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    place = F.lit(0).cast("bigint")
    for i, c in enumerate(columns):
        # Equal cuts count each: a column of few values spans the whole range too.
        cuts = sorted(found[i] or [])
        rank = _rank_of(c, kinds[c])
        step = F.coalesce(let_count(cuts, rank), F.lit(0))
        for bit in range(bits):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(step, bit).bitwiseAND(F.lit(1)).cast("bigint"), bit * len(columns) + i))
    return place


def let_count(cuts: Sequence[float], value: Column) -> Column:
    """How many of the ascending ``cuts`` are at most ``value``; null for null."""
    if not cuts:
        return F.when(value.isNotNull(), F.lit(0))
    table = literal_array(cuts)
    size = 1 << len(cuts).bit_length()
    steps = F.lit([size >> (k + 1) for k in range(size.bit_length() - 1)])

    def walk(v: Column) -> Column:
        halve = lambda at, s: F.when((at + s <= len(cuts)) & (F.get(table, at + s - 1) <= v), at + s).otherwise(at)
        return F.when(v.isNotNull(), F.aggregate(steps, F.lit(0), halve))

    return let(value, walk)


def compact_clustered(
    spark: SparkSession, path: str, columns: Sequence[str], key: str | None = None, file_bytes: int = 256 << 20, files: int | None = None, **options: str
) -> str:
    """Rewrite a table along a Z-order curve over ``columns``; returns the new folder.

    Each file, and each row group in it, covers a small box of the columns, so a predicate on any of them reads
    few: their least and largest values rule out the rest. ``key`` gets a bloom filter, which rules out
    row groups in a lookup by value. The curve's ranges are cut by Spark, so files are of like size.
    """
    table = spark.read.parquet(path)
    wanted = files or max(1, -(-fragmentation(table).first()["bytes"] // file_bytes))
    placed = table.withColumn("_place", curve(table, columns))
    laid = placed.repartitionByRange(wanted, "_place").sortWithinPartitions("_place").drop("_place")
    target = f"{path.rstrip('/')}__{uuid.uuid4().hex}"
    writer = laid.write.mode("errorifexists").options(**options)
    if key is not None:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.parquet(target)
    return target


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Catalog table dealt into buckets by the key and sorted in each: tables of as many buckets join without a shuffle.

    ``path`` makes it an external table.
    """
    # Dealt as the buckets are, so that a bucket is one file and not one for each task.
    _save(df.repartition(buckets, key), table, key, buckets, path)


def _save(df: DataFrame, table: str, key: str, buckets: int, path: str | None) -> None:
    writer = df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def merged_bucketed(spark: SparkSession, base: str, new: DataFrame, key: str, replace: bool = False) -> tuple[DataFrame, list[str], int]:
    """The merge of ``merge_bucketed`` as a frame, with the names added and the base's number of buckets."""
    found = [r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {base}").where("col_name = 'Num Buckets'").collect()]
    if not found:
        raise ValueError(f"{base} is not bucketed; see save_bucketed")
    buckets = int(found[0])
    rows = new.where(F.col(key).isNotNull())
    if rows.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} repeats in the new columns")
    # Said outright, lest a small side be broadcast or the base read across its buckets.
    merged, names = merge_columns(spark.table(base).hint("merge"), rows.repartition(buckets, key), key, replace)
    return merged, names, buckets


def merge_bucketed(spark: SparkSession, base: str, new: DataFrame, key: str, target: str, replace: bool = False, path: str | None = None) -> list[str]:
    """``merge_columns`` of a bucketed table and new columns, saved as another bucketed table; returns the names added.

    Only the new columns are shuffled, into the base's buckets; the base and what is written stay as they
    are dealt. Keys that repeat in ``new`` would multiply rows and are refused; null keys get no columns.
    """
    merged, names, buckets = merged_bucketed(spark, base, new, key, replace)
    _save(merged, target, key, buckets, path)
    return names


def register(
    spark: SparkSession, database: str, path: str, name: str | None = None, columns: Sequence[str] | None = None
) -> str:
    """External catalog table over a Parquet folder, named after it, with its row count."""
    base = name or path.rstrip("/").rsplit("/", 1)[-1]
    for suffix in (".parquet", ".lance"):
        base = base.removesuffix(suffix)
    table = f"`{database}`.`{base}`"
    quoted = path.replace("'", "\\'")
    frame = spark.read.parquet(path)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{quoted}'")
    spark.sql(
        f"ALTER TABLE {table} SET TBLPROPERTIES ('row_count' = '{frame.count()}', "
        f"'columns' = '{','.join(columns or frame.columns)}')"
    )
    return table


def _row_count(spark: SparkSession, database: str, name: str) -> int | None:
    """The count that ``register`` noted; null for a table of other origin."""
    try:
        found = spark.sql(f"SHOW TBLPROPERTIES `{database}`.`{name}`").where("key = 'row_count'").first()
    except AnalysisException:
        return None
    return int(found["value"]) if found and found["value"].isdigit() else None


def catalog_tree(spark: SparkSession) -> DataFrame:
    """Catalogs, databases and tables with their location-independent description."""
    rows = []
    for database in spark.catalog.listDatabases():
        for table in spark.catalog.listTables(database.name):
            if table.isTemporary:
                continue
            try:
                width = len(spark.catalog.listColumns(f"`{database.name}`.`{table.name}`"))
            except AnalysisException:
                width = None
            rows.append((database.catalog, database.name, table.name, table.tableType, width, _row_count(spark, database.name, table.name)))
    return spark.createDataFrame(
        rows, "catalog string, database string, table string, type string, columns int, row_count long"
    )
