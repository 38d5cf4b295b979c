"""Read-only SQL over registered views."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import rendered

# ---- fixed values: words that end the matter, and words a query may begin with -----------
FORBIDDEN = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE",
    "EXECUTE", "MERGE", "REPLACE", "SET", "PRAGMA", "ATTACH", "DETACH", "COPY", "EXPORT",
    "IMPORT", "LOAD", "INSTALL",
)
# Functions that call into the JVM, which no reading query needs.
FORBIDDEN_CALLS = ("REFLECT", "TRY_REFLECT", "JAVA_METHOD")
ALLOWED_STARTS = ("SELECT", "WITH", "EXPLAIN", "DESCRIBE", "SHOW")

# ---- fixed values: the ready-made reports ------------------------------------------------
PRESETS = {
    "stats": "SELECT risk_level, COUNT(*) AS cnt FROM voice_analysis GROUP BY risk_level ORDER BY cnt DESC",
    "churn": (
        "SELECT caller_intent, COUNT(*) AS cnt FROM voice_analysis "
        "WHERE caller_intent LIKE '%转网%' OR caller_intent LIKE '%销户%' "
        "GROUP BY caller_intent ORDER BY cnt DESC"
    ),
    "sentiment": (
        "SELECT sentiment, COUNT(*) AS cnt, AVG(sentiment_score) AS avg_score "
        "FROM voice_analysis GROUP BY sentiment ORDER BY cnt DESC"
    ),
    "daily": "SELECT * FROM churn_predictions ORDER BY date DESC",
}

_QUOTED = re.compile(r"\b[rR]'[^']*'|\b[rR]\"[^\"]*\"|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def is_read_only(sql: str) -> bool:
    """Whether the text is one reading statement. Literals and comments do not count, so a
    string such as 'update' is harmless. A raw literal ends at its next quote, whatever stands before. ``replace(...)`` the function is no REPLACE."""
    bare = _QUOTED.sub(lambda m: " " if m.group()[:2] in ("--", "/*") else "''", sql).strip().upper()
    bare = bare.rstrip(";").strip()
    bare = re.sub(r"\bREPLACE\s*\(", "(", bare)
    if ";" in bare or re.search(r"\b(" + "|".join(FORBIDDEN) + r")\b", bare):
        return False
    if re.search(r"\b(" + "|".join(FORBIDDEN_CALLS) + r")\s*\(", bare):
        return False
    return re.match(r"\(*\s*(" + "|".join(ALLOWED_STARTS) + r")\b", bare) is not None


@dataclass
class SqlResult:
    success: bool
    columns: list[str] = field(default_factory=list)
    rows: list[dict[str, Any]] = field(default_factory=list)
    truncated: bool = False
    elapsed_ms: float = 0.0
    error: str | None = None
    available_tables: list[str] = field(default_factory=list)

    @property
    def row_count(self) -> int:
        return len(self.rows)


def register_views(spark: SparkSession, views: Mapping[str, DataFrame]) -> None:
    """(Re-)register frames as views; call again to refresh a view over rewritten files."""
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def schemas(spark: SparkSession, hidden: Sequence[str] = ("_", "sqlite_", "pg_", "information_schema", "duckdb_")) -> dict[str, list[dict[str, str]]]:
    """Columns of every view, without those whose names begin like a system's."""
    return {
        name: [{"column": c.name, "type": c.dataType} for c in spark.catalog.listColumns(name)]
        for name in tables(spark)
        if not name.lower().startswith(tuple(hidden))
    }


def guarded(spark: SparkSession, sql: str, cap: int | None = None) -> DataFrame:
    """The query as a frame, refused with ``PermissionError`` unless it only reads."""
    if not is_read_only(sql):
        raise PermissionError("only SELECT, WITH, EXPLAIN, DESCRIBE and SHOW statements are allowed")
    frame = spark.sql(sql.strip().rstrip(";"))
    return frame if cap is None else frame.limit(cap)


def run_sql(spark: SparkSession, sql: str, cap: int, timeout_s: float | None = None) -> SqlResult:
    """Run a reading statement; at most ``cap`` rows reach the driver, errors come back as data.

    With ``timeout_s`` the jobs of the query are cancelled when the time is up.
    """
    started = time.monotonic()
    spent = lambda: round((time.monotonic() - started) * 1000, 2)
    timer = None
    try:
        frame = rendered(guarded(spark, sql, cap + 1))
        if timeout_s is not None:
            context, group = spark.sparkContext, f"sql-{uuid.uuid4().hex}"
            context.setJobGroup(group, "guarded query", interruptOnCancel=True)
            timer = threading.Timer(timeout_s, context.cancelJobGroup, [group])
            timer.start()
        found = frame.collect()
    except Exception as error:
        return SqlResult(False, elapsed_ms=spent(), error=str(error), available_tables=tables(spark))
    finally:
        if timer is not None:
            timer.cancel()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = [row.asDict(recursive=True) for row in found[:cap]]
    return SqlResult(
        True, frame.columns, rows, len(found) > cap, spent(), None, tables(spark)
    )
