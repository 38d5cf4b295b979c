"""Realtime analysis and daily counts of a stream of calls."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.base import strip
from ..functions.scalars import call_id_or_default
from ..operators.aggregates import churn_exact
from ..operators.calls import analyze_calls
from ..packs import TELECOM, CallPack
from ..schemas import RISK_LEVELS
from ..session import stored
from ..sources.tables import shape_analysis


def _start(writer, trigger: dict | None) -> StreamingQuery:
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def analyze_stream(
    calls: DataFrame, sink: str, checkpoint: str, id: str = "call_id", text: str = "transcript",
    pack: CallPack = TELECOM, emit: Callable[[DataFrame], None] | None = None,
    archive_to: str | None = None, trigger: dict | None = None,
    model: Callable[[DataFrame], DataFrame] | None = None, once_within: str | None = None, ts: str = "ts",
) -> StreamingQuery:
    """Analyse each micro-batch, append it to the table and emit events.

    Each batch goes to its own ``batch_id`` folder and overwrites it, so a batch that is
    repeated after a failure leaves the same rows once. ``emit`` gets the event rows.

    ``model`` comes first: it gets the batch and returns it with ``_model``, a struct of analysis
    columns, null where it has no answer; those rows keep what the rules say. What goes to the archive and
    the events is read back from what was written, so a model is asked once even if an executor is lost.

    ``once_within`` keeps the first row of an id among those whose ``ts`` lie no farther apart, in whatever
    batches they come: the ids of that time are the stream's state. Rows left out are counted by
    ``StreamCounts``. Calls without an id get one each and are never taken for repeats.
    """
    trimmed = calls.withColumn(text, strip(F.col(text))).where(F.length(text) > 0)
    blank = F.coalesce(F.length(strip(F.col(id).cast("string"))), F.lit(0)) == 0
    made = F.concat_ws("_", call_id_or_default(F.lit(None).cast("string"), F.current_timestamp()), F.hex(F.xxhash64(F.col(text))), F.substring(F.uuid(), 1, 8))
    named = trimmed.withColumn(id, F.when(blank, made).otherwise(F.col(id).cast("string")))
    if once_within is not None:
        named = named.withWatermark(ts, once_within).dropDuplicatesWithinWatermark([id])

    def write(batch: DataFrame, batch_id: int) -> None:
        started = time.time()
        rows = analyze_calls(batch if model is None else model(batch), id, text, pack)
        if model is not None:
            fields = [f for f in rows.schema["_model"].dataType.fieldNames() if f in rows.columns]
            rows = rows.withColumns({f: F.coalesce(F.col(f"_model.{f}").cast(rows.schema[f].dataType), F.col(f)) for f in fields}).drop("_model")
        rows = rows.withColumnsRenamed({id: "call_id", text: "transcript"})
        # Written once; the table, the archive and the events all read that.
        rows = stored(rows, "live-batch") if (emit or archive_to) else rows
        shape_analysis(rows).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")
        if archive_to:
            from ..sources.archive import analysis_documents, raw_documents

            base = archive_to.rstrip("/")
            raw_documents(rows).write.mode("overwrite").json(f"{base}/raw_audio/batch_id={batch_id}")
            analysis_documents(rows).write.mode("overwrite").json(f"{base}/voice_analysis/batch_id={batch_id}")
        if emit:
            emit(events(rows, started))

    return _start(named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), trigger)


def events(rows: DataFrame, started: float | None = None) -> DataFrame:
    """Analysis rows as the events that listeners get; ``elapsed_ms`` since ``started``."""
    elapsed = F.lit(None).cast("double") if started is None else F.round((F.unix_micros(F.current_timestamp()) / 1e3 - F.lit(started * 1e3)), 1)
    data = F.struct(
        "transcript",
        F.col("caller_intent").alias("intent"),
        F.col("switch_reason").alias("reasons"),
        "sentiment",
        "risk_level",
        "summary",
    )
    return rows.select(
        F.lit("voice_analysis").alias("type"), "call_id", data.alias("data"),
        F.current_timestamp().alias("timestamp"), elapsed.alias("elapsed_ms"),
    )


def daily_counts(
    calls: DataFrame, watermark: str, ts: str = "ts", window: str = "1 day", churn: Column | None = None
) -> DataFrame:
    """Counts per day as a windowed aggregation, for a stream or a batch.

    A stream drops rows later than the watermark, see ``late_rows``.
    """
    # Watermarks need a time with a zone and windows begin at midnight UTC, so the wall-clock
    # time is read as UTC, whatever the zone of the session.
    wall = F.col(ts).cast("timestamp_ntz")
    seconds = F.extract(F.lit("SECOND"), wall)
    as_utc = F.make_timestamp(
        F.year(wall), F.month(wall), F.dayofmonth(wall), F.hour(wall), F.minute(wall), seconds, F.lit("UTC")
    )
    timed = calls.withColumn(ts, as_utc)
    counted = timed.withWatermark(ts, watermark) if timed.isStreaming else timed
    grouped = counted.groupBy(F.window(ts, window).alias("_w")).agg(
        F.count("*").alias("total_calls"),
        F.count_if(churn_exact() if churn is None else churn).alias("churn_intent_count"),
        *[F.count_if(F.col("risk_level") == lv).alias(f"{lv}_risk_count") for lv in RISK_LEVELS],
        F.count_if(F.col("sentiment") == "negative").alias("negative_sentiment_count"),
        F.avg("sentiment_score").alias("avg_sentiment_score"),
    )
    day = F.date_from_unix_date(F.floor(F.unix_seconds("_w.start") / 86400).cast("int"))
    return grouped.select(day.alias("date"), *[c for c in grouped.columns if c != "_w"])


def daily_stream(
    calls: DataFrame, sink: str, checkpoint: str, watermark: str, ts: str = "ts",
    churn: Column | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the daily counts of a stream current.

    Runs in update mode: a batch writes the days it changed to its own folder, and the newest
    folder of a day counts (``read_daily_stream``). Days arrive complete, so nothing is added
    up afterwards and a repeated batch changes nothing.
    """
    counts = daily_counts(calls, watermark, ts, churn=churn)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")

    writer = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return _start(writer, trigger)


class StreamCounts(StreamingQueryListener):
    """Rows in, rows that came after the watermark and repeated rows, of every query and all its batches.

    Add it with ``count_rows`` before a query starts. A query's own ``recentProgress`` forgets all but
    the last hundred batches; this adds each batch up as it ends.
    """

    def __init__(self) -> None:
        self._lock = threading.Condition()
        self._done: dict[str, dict[str, int]] = {}
        self._last: dict[str, tuple[int, dict[str, int]]] = {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        now = {
            "rows": int(p.numInputRows),
            "late": sum(int(s.numRowsDroppedByWatermark) for s in p.stateOperators),
            "repeated": sum(int(s.customMetrics.get("numDroppedDuplicateRows", 0)) for s in p.stateOperators),
        }
        with self._lock:
            run = str(p.runId)
            batch, said = self._last.get(run, (p.batchId, {}))
            if batch != p.batchId:  # the batch before is over
                total = self._done.setdefault(run, dict.fromkeys(now, 0))
                self._done[run] = {k: total[k] + said[k] for k in now}
            self._last[run] = (p.batchId, now)
            self._lock.notify_all()

    def of(self, query: StreamingQuery, wait: float = 10.0) -> dict[str, int]:
        """``rows, late, repeated`` of a query so far; waits for the news of its last batch."""
        run, last = str(query.runId), query.lastProgress
        with self._lock:
            if last is not None:
                self._lock.wait_for(lambda: run in self._last and self._last[run][0] >= last["batchId"], wait)
            done = self._done.get(run, {})
            return {k: done.get(k, 0) + self._last.get(run, (0, {}))[1].get(k, 0) for k in ("rows", "late", "repeated")}


def count_rows(spark: SparkSession) -> StreamCounts:
    counts = StreamCounts()
    spark.streams.addListener(counts)
    return counts


def late_rows(query: StreamingQuery, counts: StreamCounts) -> int:
    """Rows that a query left out because they came after its watermark, over all its batches."""
    return counts.of(query)["late"]


def compact_daily_stream(spark: SparkSession, sink: str, target: str) -> None:
    """Write the newest row of each day to another folder, as one batch numbered -1: the stream goes
    on in the old folder, and readers take both until the old batches are removed."""
    read_daily_stream(spark, sink).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch_id=-1")


def read_daily_stream(spark: SparkSession, sink: str) -> DataFrame:
    table = spark.read.parquet(sink)
    value = [c for c in table.columns if c not in ("date", "batch_id")]
    newest = table.groupBy("date").agg(F.max_by(F.struct(*value), "batch_id").alias("_row"))
    return newest.select("date", *[F.col(f"_row.{c}").alias(c) for c in value])
