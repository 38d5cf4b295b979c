"""Operator 5: quality rules, boosted trees over document statistics.

Null and empty texts have no words and fail the base rule. Repeated rows and ties are scored row
by row. An empty table gives an empty result. Columns other than the id and the text are neither
read nor returned by ``quality_rules``; ``keep_quality`` returns all of them unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, codes_of, ids_of, mix, per_text, record, texts_of, utf8_bytes, words_of
from .trees import Forest, fit_forest

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, and the direction that a larger value may move the verdict (0: any).
FEATURES = {
    "symbols_per_word": -1, "repeat_share": -1, "dup_line_share": -1, "marks_per_word": -1, "upper_share": 0,
    "word_length": 0, "log_words": 0, "digit_share": 0, "words_per_line": 0, "distinct_share": 0,
}
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def repeated_words(codes: np.ndarray, owner: np.ndarray, texts: int, width: int = WINDOW) -> np.ndarray:
    """For each text, how many of its words lie in a window of ``width`` words that occurs again in it.

    Windows are sorted by a 64-bit hash; neighbours count as equal only if all their words are.
    """
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(texts, np.int64)
    inside = owner[:n] == owner[width - 1 :]
    key = mix(owner[:n] + 1)
    with np.errstate(over="ignore"):
        for k in range(width):
            key = key * np.uint64(0x9E3779B97F4A7C15) + mix(codes[k : k + n] + 1)
    starts = np.flatnonzero(inside)
    starts = starts[np.argsort(key[starts], kind="stable")]
    same = key[starts[1:]] == key[starts[:-1]]
    a, b = starts[1:][same], starts[:-1][same]
    equal = owner[a] == owner[b]
    for k in range(width):
        equal &= codes[a + k] == codes[b + k]
    change = np.zeros(len(codes) + 1, np.int32)
    hit = np.unique(np.concatenate([a[equal], b[equal]]))
    change[hit] += 1
    change[hit + width] -= 1
    return np.bincount(owner[np.cumsum(change)[:-1] > 0], minlength=texts)


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The counts of ``COUNTS`` and the features of ``FEATURES``, one row for each text."""
    n = len(texts)
    words, owner = words_of(texts)
    codes, dictionary = codes_of(words)
    n_words = np.bincount(owner, minlength=n)
    chars = pc.utf8_length(dictionary).to_numpy(zero_copy_only=False)
    word_chars = np.bincount(owner, chars[codes] if len(codes) else None, minlength=n).astype(np.int64)
    raw, offsets = utf8_bytes(texts)
    n_symbols = per_text(_SYMBOL[raw], offsets)
    lines = pc.split_pattern(texts, "\n")
    line_owner = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    line_texts = lines.flatten()
    line_raw, line_offsets = utf8_bytes(line_texts)
    full = per_text(~_BLANK[line_raw], line_offsets) > 0
    line_codes, line_words = codes_of(line_texts)
    pairs = line_owner[full] * max(len(line_words), 1) + line_codes[full]
    n_lines = np.bincount(line_owner[full], minlength=n)
    n_dup = n_lines - np.bincount(np.unique(pairs) // max(len(line_words), 1), minlength=n)
    repeats = repeated_words(codes, owner, n)
    counts = np.stack([n_words, word_chars, n_symbols, n_dup, repeats], axis=1).astype(np.int64)
    distinct = np.bincount(np.unique(owner * max(len(dictionary), 1) + codes) // max(len(dictionary), 1), minlength=n)
    upper = per_text((raw >= 65) & (raw <= 90), offsets)
    digits = per_text((raw >= 48) & (raw <= 57), offsets)
    marks = per_text((raw == 33) | (raw == 63), offsets)
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = np.stack(
        [n_symbols / w, repeats / w, n_dup / np.maximum(n_lines, 1), marks / w, upper / c, word_chars / w, np.log1p(n_words),
         digits / c, n_words / np.maximum(n_lines, 1), distinct / w], axis=1,
    )
    return counts, features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "quality", max_rows: int = 20_000) -> Forest | None:
    """Trees from at most ``max_rows`` labelled documents, the first by the hash of their ids.

    None without usable labels of both kinds: only the base rule decides then.
    """
    asked = labels.where(F.col(id_col).isNotNull() & F.col(target).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(target).cast("double").alias("_y"))
    asked = asked.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(asked), "_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("y", pa.float64()), ("id", pa.int64()), ("x", pa.list_(pa.float64()))])
        for batch in blocks(batches, "_text"):
            _, x = statistics(texts_of(batch, "_text"))
            yield record([ids_of(batch, "_y"), ids_of(batch, "_id").cast(pa.int64()), list(x)], schema)

    rows = sorted(found.mapInArrow(features, "y double, id long, x array<double>").toArrow().to_pylist(), key=lambda r: (r["id"], r["x"]))
    y = np.array([r["y"] for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    return fit_forest(np.array([r["x"] for r in rows]), y, tuple(FEATURES.values()))


def quality_rules(docs: DataFrame, model: Forest | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Counts, base rule, score and verdict of every document, from its whole text.

    ``kept`` is false where the base rule fails, else whether the trees give at least ``least``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            counts, x = statistics(texts_of(batch, "_text"))
            score = model.score(x) if model else np.ones(len(x))
            failed = base_failed(counts)
            columns = [ids_of(batch, "_id"), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & (score >= least)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", *COUNTS, "base_failed", "kept", "score"])

    return narrow.mapInArrow(judge, f"_id {kind}, {SCHEMA}").withColumnRenamed("_id", id_col)


def keep_quality(docs: DataFrame, model: Forest | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns; one narrow pass."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            counts, x = statistics(texts_of(batch, text_col))
            score = model.score(x) if model else np.ones(len(x))
            yield batch.filter(pa.array(~base_failed(counts) & (score >= least)))

    return docs.mapInArrow(judge, docs.schema)
