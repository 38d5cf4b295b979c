"""Operator 3: packing documents into windows by minimum bin slack.

A document's ids are cut into whole windows and one rest. Rests meet in windows by their
lengths: for the largest rest left, a subset-sum over the other lengths, with their counts, in
bitsets picks the multiset that fills the window closest to its capacity; tracing back gives the
counts; the pattern is used as often as the counts allow. A window whose ids number a power of
two needs no padding either. Lengths, not documents, go to the driver: ``capacity`` numbers at
most. Documents are then numbered within their length and find their window in the patterns.

Null and empty texts are the closing id alone. Repeated rows are packed each on its own. Rows
with a null id are packed as well. An empty table gives an empty result. Other columns are not
read. Very long texts are cut at window ends; a task holds one text at a time.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, codes_of, ids_of, lower_ascii, stored, texts_of, utf8_bytes, words_of
from .ranks import bucket_count, running

CAPACITY = 4096
END = 2
#: Bytes of encoded words that a worker remembers; the half that was not met for longest goes first.
REMEMBERED = 48 << 20
#: What a word takes besides its characters and ids: two objects and its place in the table.
_ENTRY = 160
_MARK = "\x00"


_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_STOP = np.isin(np.arange(256), list(b".,!?;:#*%&$"))


def spaced(texts: pa.Array) -> pa.Array:
    """The same ids from fewer different words: A-Z as a-z, and a blank between a letter and a stop.

    The tokenizer lower-cases anyway and never joins the two. Texts that may name a special token stay.
    """
    raw, offsets = utf8_bytes(lower_ascii(texts))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero(_LETTER[raw[:-1]] & _STOP[raw[1:]] & ~edge[1:-1]) + 1 if len(raw) else np.zeros(0, np.int64)
    made = np.insert(raw, at, 32)
    ends = (offsets + np.searchsorted(at, offsets, side="left")).astype(np.int32)
    out = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.tobytes()), pa.py_buffer(made.tobytes()))
    special = pc.match_substring(texts, "<|")
    return pc.if_else(special, texts, out) if pc.any(special).as_py() else out


class Encoder:
    """Ids of texts whose tokenizer never looks across ASCII white space, so that each different word is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Words met lately, those met before them, and the bytes of the former.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.mark = self._ids([_MARK])[0]

    @classmethod
    def of_worker(cls, path: str) -> Encoder:
        """The worker process's own encoder: later tasks find its words known."""
        held = sys.modules.setdefault("_callscope_encoders", types.ModuleType("_callscope_encoders")).__dict__
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        plain, found = [w for w in words if _MARK not in w], {}
        # Many words go through at once, with a mark between that no other word can give.
        parts = [plain[k : k + 1000] for k in range(0, len(plain), 1000)]
        odd = [w for w in words if _MARK in w]
        for part, made in zip(parts, self._ids([f" {_MARK} ".join(p) for p in parts])):
            cuts = (4 * np.flatnonzero(np.frombuffer(made, "<u4") == np.frombuffer(self.mark, "<u4")[0])).tolist()
            if len(self.mark) != 4 or len(cuts) != len(part) - 1:
                odd += part
                continue
            found.update(zip(part, (made[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(made)]))))
        found.update(zip(odd, self._ids(odd)))
        return found

    def _made(self, words: list[str]) -> list[bytes]:
        """The ids of different words, remembered or new."""
        made = list(map(self.known.get, words))
        gaps = [k for k, m in enumerate(made) if m is None]
        if gaps:
            lost = [words[k] for k in gaps]
            found = {w: self.older[w] for w in lost if w in self.older}
            found.update(self._learn([w for w in lost if w not in found]))
            if 2 * self.held > REMEMBERED:
                self.older, self.known, self.held = self.known, {}, 0
            self.known.update(found)
            self.held += _ENTRY * len(found) + sum(map(len, found)) + sum(map(len, found.values()))
            for k, w in zip(gaps, lost):
                made[k] = found[w]
        return made

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, the closing one last."""
        words, owner = words_of(spaced(texts))
        codes, dictionary = codes_of(words)
        made = self._made(dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(made), "<u4")
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        start = np.cumsum(size) - size
        lengths = size[codes]
        total = np.cumsum(lengths)
        ids = flat[np.repeat(start[codes] - (total - lengths), lengths) + np.arange(int(total[-1]) if len(total) else 0)]
        per = np.bincount(owner, lengths, len(texts)).astype(np.int64)
        end = np.cumsum(per)
        for n, stop in zip(per.tolist(), end.tolist()):
            out = np.empty(n + 1, "<u4")
            out[:n] = ids[stop - n : stop]
            out[n] = END
            yield out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, start, length, ids_crc32, doc_tokens`` of every piece: whole windows and the rest."""
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(tokenizer)
        # Small blocks: the arrays of one take some thirty times its bytes.
        for batch in blocks(batches, "_text"):
            rows: list[tuple[int, int, int, int, int]] = []
            for k, ids in enumerate(encoder.encode(texts_of(batch, "_text"))):
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    rows.append((k, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            table = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays([ids_of(batch, "_id").take(pa.array(table[:, 0])), *(pa.array(table[:, j]) for j in range(1, 5))], names=["_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(cut, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def fill(counts: dict[int, int], room: int) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Subset sums up to ``room`` of lengths with counts: all sums as bits, and the steps that made them.

    Stops at the first way to fill the room exactly.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            return reach, room, steps
    return reach, reach.bit_length() - 1, steps


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Windows as (length -> how many, times used) that hold every counted length."""
    left = {length: n for length, n in counts.items() if n}
    found = []
    while left:
        largest = max(left)
        others = dict(left)
        others[largest] -= 1
        if not others[largest]:
            del others[largest]
        reach, best, steps = fill(others, capacity - largest)
        if largest + best < capacity:
            # No padding at a power of two: the largest such sum, if there is one, beats the closest.
            exact = [1 << b for b in range(capacity.bit_length()) if 1 << b >= largest and reach >> ((1 << b) - largest) & 1]
            best = max(exact) - largest if exact else best
        pattern = {largest: 1}
        for length, k, before in reversed(steps):
            if not before >> best & 1:
                pattern[length] = pattern.get(length, 0) + k
                best -= length * k
        times = min(left[length] // m for length, m in pattern.items())
        for length, m in pattern.items():
            left[length] -= m * times
            if not left[length]:
                del left[length]
        found.append((pattern, times))
    return found


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece with its window (``sequence_id``) and place there (``offset``)."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, capacity, id_col, text_col), "op3-pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # ``capacity`` rows at most
    rows, window, used = [], 0, dict.fromkeys(counts, 0)
    for pattern, times in patterns(counts, capacity):
        place = 0
        for length, m in sorted(pattern.items(), reverse=True):
            rows.append((length, used[length], used[length] + m * times, window, m, place))
            used[length] += m * times
            place += m * length
        window += times
    if not rows:
        return cut.select(F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", F.col("start").alias("sequence_id"), F.col("start").alias("offset"))
    places = spark.createDataFrame(rows, "length long, low long, high long, window long, m long, place long")
    numbered = running(cut.withColumn("_one", F.lit(1)), ["length"], F.pmod(F.xxhash64("_id", "start"), F.lit(bucket_count(cut))), ["_id", "start", "ids_crc32", "doc_tokens"], "_one", "_rank", "op3-ranks")
    # The patterns' rows depend on ``capacity`` alone, not on the number of documents.
    met = numbered.join(F.broadcast(places), "length").where("_rank >= low and _rank < high")
    at = F.col("_rank") - F.col("low")
    return met.select(
        F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("window") + F.floor(at / F.col("m"))).cast("bigint").alias("sequence_id"),
        (F.col("place") + F.pmod(at, F.col("m")) * F.col("length")).cast("bigint").alias("offset"),
    )
