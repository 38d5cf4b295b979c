"""Character alignment of an original text and its transcription.

The only text operator that Spark's expressions cannot give: the alignment is a sequential
trace through an edit-distance table. It runs in Arrow batches next to the data, one pair at
a time and whole. Only a band of the table around its diagonal is worked out (Ukkonen 1985), as bit
vectors that move down with it (Myers 1999, Hyyrö 2003): a text of n characters and d errors takes
O(n d / 64) steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from ..functions.base import strip
from ..schemas import struct
from ..session import small_batches

SEGMENT = struct("type string, original string, transcribed string")
COUNTS = struct("match_count bigint, sub_count bigint, ins_count bigint, del_count bigint")
ALIGNMENT = T.StructType([T.StructField("diff_segments", T.ArrayType(SEGMENT)), *COUNTS.fields])


def _positions(original: str) -> dict[str, int]:
    """Bit set of the positions of every character."""
    where: dict[str, int] = {}
    bit = 1
    for char in original:
        where[char] = where.get(char, 0) | bit
        bit <<= 1
    return where


#: Bits of a band that are kept for all columns; a wider table is kept every so many columns.
_KEPT_BITS = 1 << 28
#: Errors that the first band has room for, besides a sixteenth of the shorter text.
_ROOM = 31


def _columns(where: dict[str, int], heard: str, before: int, t: int, vp: int, vn: int) -> Iterator[tuple[int, int, int]]:
    """Bit vectors of the table column by column, rows ``j - t`` to ``j + t`` in column ``j``.

    They are diagonal zero, in the rows of the column, and vertical plus and minus, in the rows of
    the next. Rows above the first have no bit set. What lies below the band is taken for one more than its
    diagonal neighbour, what lies above for out of reach: neither is ever too small.
    """
    full = (1 << (2 * t + 1)) - 1
    shift = before - t
    for char in heard:
        eq = where.get(char, 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        shift += 1
        d0 = (((eq & vp) + vp) ^ vp | eq | vn) & full
        hp = vn | full ^ (d0 | vp)
        below = d0 >> 1
        vp, vn = d0 & vp | full ^ (below | hp), below & hp
        yield d0, vp, vn


def _common_end(a: str, b: str, i: int, j: int) -> int:
    """How many characters before ``i`` and ``j`` are equal."""
    length, step = 0, 16
    while step:
        if i - length >= step and j - length >= step and a[i - length - step : i - length] == b[j - length - step : j - length]:
            length += step
            step = min(2 * step, 4096)
        else:
            step //= 2
    return length


def _traced(original: str, transcribed: str, where: dict[str, int], t: int) -> tuple[list[tuple[str, int]], int]:
    """Runs from the end, and their errors, along the least path of a band of ``t`` rows either way."""
    m, n = len(original), len(transcribed)
    step = max(n, 1) if n * (2 * t + 1) <= _KEPT_BITS else int(n**0.5) + 1
    state = (((1 << (t + 1)) - 1) << t, 0)
    saved = {0: state}
    for start in range(step, n, step):
        for _, vp, vn in _columns(where, transcribed[start - step : start], start - step, t, *state):
            state = vp, vn
        saved[start] = state

    runs: list[tuple[str, int]] = []
    i, j, base, block, errors = m, n, -1, [], 0
    while i and j:
        length = _common_end(original, transcribed, i, j)
        if length:
            kind = "match"
            i, j = i - length, j - length
        else:
            start = (j - 1) // step * step
            if start != base:
                base, block = start, list(_columns(where, transcribed[start : start + step], start, t, *saved[start]))
            d0, vp, _ = block[j - 1 - base]
            length, row = 1, i - j + t
            errors += 1
            if row > 2 * t or not d0 >> row & 1:
                kind, i, j = "sub", i - 1, j - 1
            elif row and vp >> (row - 1) & 1:
                kind, i = "del", i - 1
            else:
                kind, j = "ins", j - 1
        if runs and runs[-1][0] == kind:
            runs[-1] = (kind, runs[-1][1] + length)
        else:
            runs.append((kind, length))
    for kind, length in (("del", i), ("ins", j)):
        if length:
            errors += length
            if runs and runs[-1][0] == kind:
                runs[-1] = (kind, runs[-1][1] + length)
            else:
                runs.append((kind, length))
    return runs, errors


def edit_runs(original: str, transcribed: str) -> list[tuple[str, int]]:
    """Run lengths of match, sub, del and ins from the front.

    Traced from the end: equal characters match, then substitution, deletion and insertion
    are tried in that order. A path of at most ``t`` errors stays within a band of ``t`` rows, where the
    table is exact; until the traced path is one, the band is widened, to twice or to the errors found.
    Columns are kept whole, or every so many where that takes too much memory.
    """
    m, n = len(original), len(transcribed)
    end = _common_end(original, transcribed, m, n)
    a, b = original[: m - end], transcribed[: n - end]  # what is equal at the end is traced first anyway
    where = _positions(a)
    t = abs(len(a) - len(b)) + max(_ROOM, min(len(a), len(b)) // 16)
    while True:
        runs, errors = _traced(a, b, where, t)
        if errors <= t:
            break
        t = min(2 * t + 1, errors)
    if end:
        runs = [("match", end + runs[0][1]), *runs[1:]] if runs and runs[0][0] == "match" else [("match", end), *runs]
    runs.reverse()
    return runs


def _counts(runs: list[tuple[str, int]]) -> dict[str, int]:
    totals = {"match": 0, "sub": 0, "ins": 0, "del": 0}
    for kind, length in runs:
        totals[kind] += length
    return {f"{kind}_count": total for kind, total in totals.items()}


#: Characters, of both texts of a pair, whose runs a task holds at once; a longer pair is a block of its own.
_BLOCK = 1 << 18
_KINDS = ("match", "sub", "ins", "del")


def _blocks(original: pa.Array, transcribed: pa.Array) -> Iterator[tuple[list[str], list[str]]]:
    size = lambda texts: pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size(original) + size(transcribed))
    low = 0
    while low < len(ends):
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        yield tuple([t or "" for t in texts.slice(low, high - low).to_pylist()] for texts in (original, transcribed))
        low = high


def _aligned(original: pa.Array, transcribed: pa.Array, segments: bool) -> Iterator[pa.StructArray]:
    """The alignments of a batch in blocks, as columns: a run is three short texts and no object of its own."""
    for left, right in _blocks(original, transcribed):
        counts: list[list[int]] = []
        kinds, before, after, ends = [], [], [], [0]
        for a, b in zip(left, right):
            runs = edit_runs(a, b)
            total = _counts(runs)
            counts.append([total[f"{kind}_count"] for kind in _KINDS])
            if segments:
                i = j = 0
                for kind, length in runs:
                    di, dj = (0 if kind == "ins" else length), (0 if kind == "del" else length)
                    kinds.append(kind)
                    before.append(a[i : i + di])
                    after.append(b[j : j + dj])
                    i, j = i + di, j + dj
                ends.append(len(kinds))
        columns = [pa.array(c, pa.int64()) for c in np.array(counts, np.int64).T]
        names = COUNTS.fieldNames()
        if segments:
            parts = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in (kinds, before, after)], SEGMENT.fieldNames())
            columns, names = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts), *columns], ALIGNMENT.fieldNames()
        yield pa.StructArray.from_arrays(columns, names)


@arrow_udf(ALIGNMENT)
def _align(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for original, transcribed in batches:
        yield from _aligned(original, transcribed, True)


@arrow_udf(COUNTS)
def _align_counts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for original, transcribed in batches:
        yield from _aligned(original, transcribed, False)


def align(df: DataFrame, original: str, transcribed: str, segments: bool = True) -> DataFrame:
    """Add the four counts and, with ``segments``, the runs as ``diff_segments``. Whole texts,
    of any length."""
    small_batches(df.sparkSession)
    run = _align if segments else _align_counts
    # Not to be copied into a filter by the optimizer: it would run twice.
    done = df.withColumn("_alignment", run.asNondeterministic()(F.col(original), F.col(transcribed)))
    return done.select(*df.columns, "_alignment.*")


def _word_count(text: Column) -> Column:
    words = F.split(strip(text), r"(?U)\s+")
    return F.size(F.filter(words, lambda w: F.length(w) > 0))


def match_rate(df: DataFrame, original: str, transcribed: str) -> DataFrame:
    """Accuracy, word counts and confidence from aligned counts; zeros when a side is empty."""
    a, b = F.coalesce(F.col(original), F.lit("")), F.coalesce(F.col(transcribed), F.lit(""))
    both = (F.length(a) > 0) & (F.length(b) > 0)
    accuracy = F.bround(F.col("match_count") / F.length(a) * 100, 1)
    df = df.withColumn("char_accuracy", F.when(both, accuracy).otherwise(F.lit(0.0)))
    return df.withColumns(
        {
            "asr_confidence": F.when(both, F.bround(F.lit(0.80) + F.lit(0.19) * F.col("char_accuracy") / 100.0, 2)).otherwise(F.lit(0.0)),
            "word_count_original": F.when(both, _word_count(a)).otherwise(F.lit(0)),
            "word_count_transcribed": F.when(both, _word_count(b)).otherwise(F.lit(0)),
        }
    )
