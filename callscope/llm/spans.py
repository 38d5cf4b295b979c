"""Where regular expressions match, as spans of code points, in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.base import let

SPAN = "struct<kind:string,rank:int,start:bigint,end:bigint,value:string>"
SPANS = f"array<{SPAN}>"
_PLACES = "array<struct<start:bigint,end:bigint,value:string,part:string>>"


def none() -> Column:
    return F.array().cast(SPANS)


def matches(text: Column, kind: str, rank: int, regex: str | Column, fine: Callable[[Column], Column] | None = None, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as ``SPANS``; ``fine`` sees each match, or its ``group``.

    The text is cut at the matches; lengths of the pieces and matches add up to positions.
    """
    pattern = F.lit(regex) if isinstance(regex, str) else regex
    found = F.regexp_extract_all(text, pattern, F.lit(0))

    def place(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        parts = F.regexp_extract_all(text, pattern, F.lit(group)) if group else hits
        rows = F.arrays_zip(gaps.alias("g"), hits.alias("h"), parts.alias("p"))

        def add(state: Column, x: Column) -> Column:
            start = state["at"] + F.length(x["g"])
            end = start + F.length(x["h"])
            row = F.struct(start.alias("start"), end.alias("end"), x["h"].alias("value"), x["p"].alias("part"))
            return F.struct(end.alias("at"), F.concat(state["rows"], F.array(row)).cast(_PLACES).alias("rows"))

        placed = F.aggregate(rows, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_PLACES).alias("rows")), add)["rows"]
        kept = F.filter(placed, lambda x: fine(x["part"])) if fine else placed
        return F.transform(kept, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))).cast(SPANS)

    return let(found, lambda hits: F.when(F.size(hits) > 0, place(hits)).otherwise(none()))


def joined(spans: Column, by_rank: bool) -> Column:
    """``kind:start:end`` of all spans, comma-joined; by kind then start, or by start then kind."""
    keys = ("rank", "start", "end", "kind") if by_rank else ("start", "rank", "end", "kind")
    rows = F.array_sort(F.transform(spans, lambda x: F.struct(*[x[k].alias(k) for k in keys])))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


def replaced(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """The text with a label for each span; of overlapping spans the first names the place."""
    rows = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def add(state: Column, x: Column) -> Column:
        before = F.substring(text, (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int"))
        out = F.when(x["start"] >= state["at"], F.concat(state["out"], before, label(x["kind"]))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), out.alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(rows, start, add, finish)).otherwise(text)


def chained(parts: Sequence[Column]) -> Column:
    return F.concat(*parts).cast(SPANS)
