"""Hosting of a caller-supplied model inside Arrow batches.

A ``factory`` builds the model once per task; the model then takes batches. Concurrency is
the number of partitions, micro-batching is ``spark.sql.execution.arrow.maxRecordsPerBatch``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import rules as R
from ..functions.jsontext import rescue_json
from ..functions.text import redact
from ..packs import TELECOM_REASONS, TELECOM_RULES, ReasonPack, RulePack
from ..schemas import struct
from ..session import small_batches

CALL_ANSWER = struct(
    "caller_intent string, switch_reason string, sentiment string, sentiment_score string, summary string, "
    "risk_level string, suggested_action string"
)


#: Answers that a task holds before it hands them on.
_ANSWERS = 256


def map_model(
    df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: T.StructType | str
) -> DataFrame:
    """Run a batch model over a frame: the model maps a pandas frame to one of ``schema``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)


def call_model(
    inputs: list[Column], factory: Callable[[], Callable[..., Any]], returns: str = "string", micro_batch: int = 8,
    error_chars: int | None = None,
) -> Column:
    """``struct<value, error>`` of a model called row by row in micro-batches.

    A row on which the model raises gets the error text, and the others are unaffected. The
    model gets one list per input column and returns one list; a failing micro-batch is
    retried row by row. ``error_chars`` cuts error texts. The call counts as one that may
    answer differently each time, so that no filter has it made twice.
    """
    schema = T.StructType.fromDDL(f"value {returns}, error string")

    def guarded(model, columns: list[list]) -> list[tuple]:
        try:
            values = list(model(*columns))
            if len(values) != len(columns[0]):
                raise ValueError("model returned another number of rows")
            return [(v, None) for v in values]
        except Exception as error:
            if len(columns[0]) == 1:
                return [(None, f"{type(error).__name__}: {error}"[:error_chars])]
            rows = []
            for n in range(len(columns[0])):
                rows += guarded(model, [[c[n]] for c in columns])
            return rows

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            columns = [list(series) for series in batch]
            rows: list[tuple] = []
            for start in range(0, len(columns[0]), micro_batch):
                rows += guarded(model, [c[start : start + micro_batch] for c in columns])
                if len(rows) >= _ANSWERS:
                    yield pd.DataFrame(rows, columns=["value", "error"])
                    rows = []
            if rows or not columns[0]:
                yield pd.DataFrame(rows, columns=["value", "error"])

    def run_single(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run((series,) for series in batches)

    if len(inputs) == 1:
        run_single.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(run_single, schema).asNondeterministic()(*inputs)
    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema).asNondeterministic()(*inputs)


def map_with_errors(
    df: DataFrame, inputs: list[str], fn: Callable[..., Any], returns: str = "string", out: str = "result"
) -> DataFrame:
    """Apply a row function; rows on which it raises are kept with the text in ``error``."""

    def factory() -> Callable[..., list]:
        return lambda *columns: [fn(*values) for values in zip(*columns)]

    called = df.withColumn("_called", call_model([F.col(c) for c in inputs], factory, returns))
    return called.select(*df.columns, F.col("_called.value").alias(out), F.col("_called.error").alias("error"))


def _null_fields(json: Column) -> Column:
    """Names of the fields that an object gives as JSON null."""
    value = lambda name: F.try_variant_get(F.try_parse_json(json), f"$.{name}", "variant")
    return F.array_compact(F.array(*[F.when(F.is_variant_null(value(n)), F.lit(n)) for n in ("sentiment", "sentiment_score")]))


def enrich(
    df: DataFrame, id: str, text: str, factory: Callable[[], Callable[..., Any]] | None,
    reasons: ReasonPack = TELECOM_REASONS, rules: RulePack = TELECOM_RULES, micro_batch: int = 8,
    partitions: int | None = None, keep: Sequence[str] = (), summary_chars: int | None = None,
    ledger: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Redact, ask the model, parse its answer; rows without a usable answer get the rules.

    ``model_used`` tells which way a row went and ``model_error`` why the model failed.
    ``partitions`` sets how many calls are under way at most; ``keep`` names input columns that
    stay in the result, ``summary_chars`` the length of summaries by rule. ``ledger`` takes the place of
    the call: it gets the frame and the name of the text and adds ``_call`` (see ``ledger.answered``).
    """
    small_batches(df.sparkSession)
    base = df.select(id, *keep, redact(F.coalesce(F.col(text), F.lit(""))).alias("transcript_redacted"))
    if partitions is not None:
        base = base.repartition(partitions)
    by_rule = R.rule_analysis(F.col("transcript_redacted"), rules, summary_chars)
    if factory is None:
        return base.withColumns(
            {**by_rule, "model_used": F.lit(False), "model_error": F.lit(None).cast("string")}
        )
    if ledger is not None:
        asked = ledger(base, "transcript_redacted")
    else:
        asked = base.withColumn("_call", call_model([F.col("transcript_redacted")], factory, "string", micro_batch))
    parsed = asked.withColumn("_json", rescue_json(F.col("_call.value")))
    parsed = parsed.withColumn("_answer", F.from_json("_json", CALL_ANSWER))
    # An answer counts when it is an object with at least one field.
    usable = F.coalesce(F.size(F.json_object_keys("_json")) > 0, F.lit(False))
    by_model = R.model_columns(F.col("_answer"), F.col("transcript_redacted"), reasons, _null_fields(F.col("_json")))
    chosen = {name: F.when(usable, by_model[name]).otherwise(by_rule[name]) for name in by_rule}
    return parsed.withColumns(
        {**chosen, "model_used": usable, "model_error": F.col("_call.error")}
    ).drop("_call", "_json", "_answer")
