"""Daily aggregates, distributions and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..packs import CHURN_INTENTS, CHURN_SUBSTRINGS, MIXED_REASONS, NO_REASON
from ..functions.base import contains_any
from ..schemas import RISK_LEVELS

COUNTS = (
    "total_calls", "churn_intent_count", "high_risk_count", "medium_risk_count",
    "low_risk_count", "negative_sentiment_count",
)


def churn_exact(intent: str = "caller_intent") -> Column:
    return F.coalesce(F.col(intent).isin(*CHURN_INTENTS), F.lit(False))


def churn_contains(intent: str = "caller_intent") -> Column:
    return contains_any(F.col(intent), CHURN_SUBSTRINGS)


def _count_columns(churn: Column) -> list[Column]:
    return [
        F.count("*").alias("total_calls"),
        F.count_if(churn).alias("churn_intent_count"),
        *[F.count_if(F.col("risk_level") == level).alias(f"{level}_risk_count") for level in RISK_LEVELS],
        F.count_if(F.col("sentiment") == "negative").alias("negative_sentiment_count"),
    ]


def daily_aggregate(df: DataFrame, date: str = "date", churn: Column | None = None) -> DataFrame:
    """Counts, mean score and most frequent whole reason per day.

    Two steps: per day and reason first, with everything combinable on the map side, then
    per day over the few reasons that are left. No day is held in one task.
    """
    by_reason = df.groupBy(date, "switch_reason").agg(
        *_count_columns(churn_exact() if churn is None else churn),
        F.sum("sentiment_score").alias("_score"),
        F.count("sentiment_score").alias("_scored"),
    )
    named = (F.col("switch_reason").isNotNull()) & (F.col("switch_reason") != "")
    order = F.when(named, F.struct(-F.col("total_calls"), F.col("switch_reason")))
    return by_reason.groupBy(date).agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.coalesce(F.min_by("switch_reason", order), F.lit(NO_REASON)).alias("top_switch_reason"),
        F.coalesce(F.sum("_score") / F.nullif(F.sum("_scored"), F.lit(0)), F.lit(0.0)).alias(
            "avg_sentiment_score"
        ),
    )


def daily_aggregate_mixed(df: DataFrame, date: str = "date") -> DataFrame:
    """The batch variant: churn by substring, no single reason named, no score."""
    return (
        df.groupBy(date)
        .agg(*_count_columns(churn_contains()))
        .withColumns({"top_switch_reason": F.lit(MIXED_REASONS), "avg_sentiment_score": F.lit(0.0)})
    )


def running_totals(daily: DataFrame, date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """Totals up to and including each day. The input has one row per day, not per call."""
    window = Window.orderBy(date) if not by else Window.partitionBy(*by).orderBy(date)
    window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select(*by, date, *[F.sum(c).over(window).alias(c) for c in COUNTS])


def daily_totals(daily: DataFrame) -> DataFrame:
    """Risk counts over the whole daily table, number of records and of snapshots."""
    snapshots = F.count_distinct("snapshot_id") if "snapshot_id" in daily.columns else F.lit(0)
    return daily.agg(
        F.count("*").alias("records"),
        snapshots.cast("bigint").alias("snapshots"),
        *[F.coalesce(F.sum(f"{lv}_risk_count"), F.lit(0)).alias(lv) for lv in RISK_LEVELS],
    )


def distribution(
    df: DataFrame, column: str, levels: Sequence[str] = (), missing: str | None = None
) -> DataFrame:
    """Count per value; the given levels appear even when nothing has them."""
    value = F.col(column) if missing is None else F.coalesce(F.col(column), F.lit(missing))
    rows = df.select(value.alias(column), F.lit(1).cast("bigint").alias("_n"))
    if levels:
        zero = df.sparkSession.createDataFrame([(lv, 0) for lv in levels], f"{column} string, _n bigint")
        rows = rows.unionByName(zero)
    return rows.groupBy(column).agg(F.sum("_n").alias("count"))


def image_summary(df: DataFrame, pending_is_failure: bool = False) -> DataFrame:
    status = F.col("analysis_status")
    fine = ("ok",) if pending_is_failure else ("pending", "ok")
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(status == "ok").alias("analyzed"),
        F.count_if(F.col("is_avatar")).alias("avatars"),
        F.count_if(~F.col("is_avatar")).alias("rejected"),
        F.count_if(~status.isin(*fine)).alias("failed"),
        F.count_if(F.col("embedding_status") == "ok").alias("embedded"),
    )


def image_stage_counters(df: DataFrame) -> DataFrame:
    """What the three image stages report: missing files, analysis and embedding outcomes."""
    ok = F.coalesce(F.col("analysis_status") == "ok", F.lit(False))
    return df.agg(
        F.count_if(F.col("image_blob").isNull()).alias("missing"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok).alias("failed"),
        F.count_if(F.col("is_avatar")).alias("avatars"),
        F.count_if(F.col("embedding_status") == "ok").alias("embedded"),
        F.count_if(F.col("embedding_status") == "failed").alias("embed_failed"),
    )


def search_summary(df: DataFrame, negative: str = "negative") -> DataFrame:
    return df.agg(
        F.count_if(F.col("bad_tone")).alias("bad_tone"),
        F.count_if(F.col("text_emotion") == negative).alias("negative"),
        F.count_if(F.col("downgrade_related")).alias("downgrade"),
    )


def asr_summary(df: DataFrame, accuracy: str = "char_accuracy", confidence: str = "asr_confidence") -> DataFrame:
    zero = F.lit(0.0)
    return df.agg(
        F.coalesce(F.bround(F.avg(accuracy), 1), zero).alias("overall_char_accuracy"),
        F.coalesce(F.bround(F.min(accuracy), 1), zero).alias("min_accuracy"),
        F.coalesce(F.bround(F.max(accuracy), 1), zero).alias("max_accuracy"),
        F.coalesce(F.bround(F.avg(confidence), 2), zero).alias("avg_confidence"),
        F.count(accuracy).alias("sample_count"),
    )


def exact_percentiles(
    df: DataFrame, value: str, points: dict[str, float], by: Sequence[str] = (), bins: int = 1024
) -> DataFrame:
    """Percentiles by linear interpolation, exact, with no group in one task and nothing sorted.

    The built-in ``percentile`` keeps a map of all distinct values of a group in one buffer.
    Here equal values are counted first. The range that holds a wanted rank is cut into ``bins``
    of equal width, counts per bin tell which holds the rank, and its least and largest value are
    the next range, until that is one value. Each group narrows by itself, whatever its values;
    a window only ever sees the counts of one range. Ranges are kept in the scratch folder.
    """
    from ..session import stored

    group = list(by) or ["_all"]
    base = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    if not by:
        base = base.withColumn("_all", F.lit(0))
    counted = stored(base.groupBy(*group, "_v").agg(F.count("*").alias("_n")), "percentile-counts")
    # Null groups are told from each other by their JSON text.
    counted = counted.withColumn("_g", F.to_json(F.struct(*group), {"ignoreNullFields": "false"}))
    # Values that are not finite have their ranks at the ends, in Spark's order: -Infinity, numbers, Infinity, NaN.
    minus, plus, nan = (F.lit(x).cast("double") for x in ("-Infinity", "Infinity", "NaN"))
    finite = (F.col("_v") > minus) & (F.col("_v") < plus)
    of = lambda which: F.coalesce(F.sum(F.when(which, F.col("_n"))), F.lit(0))
    whole = counted.groupBy("_g").agg(
        *[F.first(c).alias(c) for c in group], F.sum("_n").alias("_total"), of(F.col("_v") == minus).alias("_before"), of(finite).alias("_inside"), of(F.col("_v") == plus).alias("_after"),
        F.min(F.when(finite, F.col("_v"))).alias("_low"), F.max(F.when(finite, F.col("_v"))).alias("_high"),
    )
    ranks = []
    for name, point in points.items():
        position = (F.col("_total") - 1) * F.lit(point)
        for side, rank in (("lo", F.floor(position)), ("hi", F.least(F.floor(position) + 1, F.col("_total") - 1))):
            ranks.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank.alias("rank"), (position - F.floor(position)).alias("part")))
    wanted = whole.withColumn("_r", F.explode(F.array(*ranks)))
    last = F.col("_before") + F.col("_inside")
    odd = F.when(F.col("_r.rank") < F.col("_before"), minus).when(F.col("_r.rank") >= last, F.when(F.col("_r.rank") < last + F.col("_after"), plus).otherwise(nan))
    wanted = wanted.select("_g", *group, F.coalesce(odd, "_low").alias("_low"), F.coalesce(odd, "_high").alias("_high"), "_r", F.col("_before").cast("bigint").alias("_start"))
    wanted = stored(wanted, "percentile-ranges")
    counted = counted.where(finite)
    rounds = 0
    while wanted.where("_low < _high").limit(1).count():
        # A round divides a range by ``bins`` or more; that many rounds bring the widest to one value.
        rounds += 1
        if rounds > 2200:
            raise RuntimeError("percentile ranges do not narrow")
        open_ = wanted.where("_low < _high").select("_g", "_low", "_high", "_start").distinct()
        inside = counted.select("_g", "_v", "_n").join(open_, "_g").where("_v between _low and _high")
        # Halved first, so that no width overflows; a width too small to halve parts its least value from the rest.
        width = F.col("_high") / 2 - F.col("_low") / 2
        share = F.when(width > 0, (F.col("_v") / 2 - F.col("_low") / 2) / F.when(width > 0, width)).otherwise(F.when(F.col("_v") > F.col("_low"), 1.0).otherwise(0.0))
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1))
        counts = inside.groupBy("_g", "_low", "_high", "_start", bin_.alias("_bin")).agg(F.sum("_n").alias("_in"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        range_ = Window.partitionBy("_g", "_low", "_high", "_start").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("_first", F.col("_start") + F.coalesce(F.sum("_in").over(range_), F.lit(0)))
        found = wanted.where("_low < _high").join(placed, ["_g", "_low", "_high", "_start"]).where((F.col("_r.rank") >= F.col("_first")) & (F.col("_r.rank") < F.col("_first") + F.col("_in")))
        narrowed = found.select("_g", *group, F.col("_from").alias("_low"), F.col("_to").alias("_high"), "_r", F.col("_first").alias("_start"))
        # Equal, or no number: NaN is not less than itself.
        wanted = stored(wanted.where("not _low < _high").unionByName(narrowed), "percentile-ranges")
    pick = lambda name, side, field: F.max(F.when((F.col("_r.name") == name) & (F.col("_r.side") == side), field))
    aggregates = []
    for name in points:
        low, high = pick(name, "lo", F.col("_low")), pick(name, "hi", F.col("_low"))
        part = pick(name, "lo", F.col("_r.part"))
        between = F.when(F.abs(high - low) < plus, low + part * (high - low)).otherwise((1 - part) * low + part * high)
        aggregates.append(F.when((part == 0) | (low == high), low).otherwise(between).alias(name))
    return wanted.groupBy("_g").agg(*[F.first(c).alias(c) for c in group], *aggregates).select(*by, *points)


LATENCY_POINTS = {"p50": 0.50, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def latency_summary(
    df: DataFrame, value: str, by: Sequence[str] = (), error: Column | None = None, wall_ms: float | None = None
) -> DataFrame:
    """Count, extremes, mean, sample deviation, percentiles, errors and throughput."""
    errors = F.lit(0).cast("bigint") if error is None else F.count_if(error)
    rate = F.lit(None).cast("double") if wall_ms is None else F.count("*") / F.lit(wall_ms / 1000.0)
    plain = df.groupBy(*by).agg(
        F.count(value).alias("requests"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("avg"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"),
        errors.alias("errors"),
        rate.alias("throughput_qps"),
    )
    points = exact_percentiles(df, value, LATENCY_POINTS, by)
    if not by:
        # One row of four numbers, taken over as constants rather than joined.
        row = points.first()
        return plain.withColumns({n: F.lit(row[n] if row else None).cast("double") for n in LATENCY_POINTS})
    renamed = points.select(*[F.col(c).alias(f"_k_{c}") for c in by], *LATENCY_POINTS)
    condition = None
    for c in by:
        part = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        condition = part if condition is None else condition & part
    return plain.join(renamed, condition, "left").drop(*[f"_k_{c}" for c in by])


def quantile_sketches(df: DataFrame, value: str, by: Sequence[str], k: int = 800) -> DataFrame:
    """A KLL sketch of the values of each group, some kilobytes whatever the group's size.

    ``by, sketch, n, nan_count``: sketches leave out nulls and NaN, and merge in any order, so a table
    of them by day and type answers for any span without the values (``sketch_quantiles``). A
    quantile's rank is off by ``sketch_error(k)`` of ``n`` at most, in 99 of 100 cases.
    """
    number = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.kll_sketch_agg_double(F.when(~F.isnan(number), number), F.lit(k)).alias("sketch"),
        F.count_if(number.isNotNull() & ~F.isnan(number)).alias("n"), F.count_if(F.isnan(number)).alias("nan_count"),
    )


def sketch_error(k: int) -> float:
    """Share of all ranks by which one quantile of a sketch of size ``k`` may be off (99 %)."""
    return 2.296 / k**0.9723


def sketch_quantiles(sketches: DataFrame, points: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles of merged sketches by fewer columns than they were made by; null for groups without values."""
    merged = sketches.where("n > 0").groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    values = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias(name) for name, p in points.items()]
    return merged.select(*by, "n", *values)


def batch_outcome(df: DataFrame, error: str = "error") -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(error).isNull()).alias("completed"),
        F.count_if(F.col(error).isNotNull()).alias("failed"),
    )


def etl_report(before: dict[str, int], after: dict[str, int], spark: Any) -> DataFrame:
    """Before, after and delta of every counter of a run."""
    rows = [(k, int(before.get(k, 0)), int(after.get(k, 0))) for k in sorted({*before, *after})]
    frame = spark.createDataFrame(rows, "counter string, before bigint, after bigint")
    return frame.withColumn("delta", F.col("after") - F.col("before"))


def check_embeddings(
    df: DataFrame, model: str, dim: int, status: str = "embedding_status",
    model_col: str = "embedding_model", vector: str = "image_embedding",
) -> DataFrame:
    """One row that tells whether the stored vectors can be queried with this model."""
    checked = df.where(F.col(status) == "ok").agg(
        F.count("*").alias("ok_rows"),
        F.count_if(~F.col(model_col).eqNullSafe(F.lit(model))).alias("other_model"),
        F.count_if(F.col(vector).isNull() | (F.size(vector) != dim)).alias("bad_vector"),
    )
    problem = (
        F.when(F.col("ok_rows") == 0, "no_vectors")
        .when(F.col("other_model") > 0, "model_mismatch")
        .when(F.col("bad_vector") > 0, "bad_vector")
    )
    return checked.withColumn("problem", problem)


def require_embeddings(df: DataFrame, model: str, dim: int, **columns: str) -> None:
    row = check_embeddings(df, model, dim, **columns).first()
    if row["problem"]:
        raise RuntimeError(f"stored vectors cannot be queried: {row.asDict()}")
