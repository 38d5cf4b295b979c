"""Operator 13: collocations counted inside the distinct chunks of a prefix-free parse.

Texts are cut into pieces at punctuation and line ends, pieces into chunks wherever the words
themselves say so: a chunk starts at each place whose next ``size - 1`` words hash to 0 modulo
``every``. It runs on ``size - 1`` words into the following chunk, which makes equal passages give
equal chunks wherever they stand, and leaves no phrase uncovered. A chunk owns the phrases that
start before its overlap, so each is counted in one chunk only. Equal chunks of a language meet in
a dictionary with their frequency, and phrases are counted once in each different chunk, weighted.

Pairs of words are counted first, by hash, so that only phrases whose pairs may all be frequent are
counted by their words. Counts below ``least`` are dropped once they are whole: a part of a phrase is
at least as frequent as the phrase, so all that a score needs is left. Scores are integers, from 38-digit products: the
smallest over the cuts of a phrase of ``floor(10^6 a^2 / (l r))``. A phrase inside a longer one at
least half as frequent goes. Each language is ranked in parts first, so that none is one task's.

Null and empty texts have no words; a null language is ``und``; ties are broken by the phrase in byte
order; repeated rows count as often as they stand there; empty tables give an empty result; other
columns are not read. A piece without a place to cut is one chunk, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import blocks, codes_of, ids_of, mix, record, release, stored, texts_of, utf8_bytes

SIZE = 3
LEAST = 10
TOP = 2000
#: A chunk has so many words of its own on average.
EVERY = 16
#: Parts over which rows that need a word's count are dealt.
SALTS = 16
#: Bytes of dictionary rows counted together inside a task.
_GATHER = 8 << 20
#: Bits of a pair's slot, and of its place in the map of frequent pairs (16 MB).
_SLOT_BITS = 40
_MAP_BITS = 27

_BREAK = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[_BREAK] = 32
_PLAIN[9] = 32

_CHUNKS = pa.schema([("lang", pa.string()), ("own", pa.int32()), ("chunk", pa.string()), ("times", pa.int64())])
_SLOTS = pa.schema([("slot", pa.int64()), ("f", pa.int64())])
_FOUND = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False)) if len(words) else np.zeros(0, np.uint64)


def _joined(words: pa.Array, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of words, blank between: run ``i`` has ``sizes[i]`` words from ``codes[starts[i]]`` on."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1] - starts, sizes)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.take(pa.array(codes[at]))), " ")


def parse(texts: pa.Array, size: int = SIZE, every: int = EVERY) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Chunks of all texts: the text that each stands in, how many places it owns, its words."""
    raw, offsets = utf8_bytes(texts)
    plain = _PLAIN[raw]
    words = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(plain.tobytes()))).flatten()
    words = words.filter(pc.greater(pc.binary_length(words), 0))
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.string())
    full = plain != 32
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero(full & (~np.concatenate([[False], full[:-1]]) | edge[:-1]))
    owner = np.searchsorted(offsets, at, side="right") - 1
    piece = np.cumsum(_BREAK[raw])[at] + owner  # rises at every break and text, stays within a piece
    fresh = np.concatenate([[True], np.diff(piece) != 0])
    codes, words = codes_of(words)
    of_word = _hashes(words)[codes]
    window = of_word.copy()
    with np.errstate(over="ignore"):
        for k in range(1, size - 1):
            window[: n - k] = mix(window[: n - k]) + of_word[k:]
            window[n - k :] = 1
    left = np.flatnonzero(np.append(fresh[1:], True))  # last word of each piece
    stop = np.repeat(left + 1, np.diff(np.concatenate([[-1], left])))  # where each word's piece ends
    first = fresh | ((mix(window) % np.uint64(every) == 0) & (np.arange(n) + size - 1 <= stop))
    starts = np.flatnonzero(first)
    own = np.diff(np.append(starts, n))
    sizes = np.minimum(own + size - 1, stop[starts] - starts)
    return owner[starts], own.astype(np.int32), _joined(words, codes, starts, sizes)


def chunks(docs: DataFrame, size: int = SIZE, every: int = EVERY, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, own, chunk, times``: the dictionary of the parse with its frequencies."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, 4 << 20):
            owner, own, chunk = parse(texts_of(block, text), size, every)
            langs = pc.fill_null(ids_of(block, lang).cast(pa.string()), "und").take(pa.array(owner))
            same = pa.table([langs, pa.array(own), chunk], names=["lang", "own", "chunk"]).group_by(["lang", "own", "chunk"]).aggregate([([], "count_all")])
            yield from same.select(["lang", "own", "chunk", "count_all"]).rename_columns(_CHUNKS.names).cast(_CHUNKS).combine_chunks().to_batches(20_000)

    found = docs.select(lang, text).mapInArrow(cut, "lang string, own int, chunk string, times long")
    return found.groupBy("lang", "own", "chunk").agg(F.sum("times").alias("times"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Dictionary rows, some megabytes at a time."""
    waiting, held = [], 0
    for block in blocks(batches, "chunk"):
        waiting.append(block)
        held += block.nbytes
        if held >= _GATHER:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting, held = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()
    release()


class Places:
    """The words of some dictionary rows in a line; a place is where a phrase may start."""

    def __init__(self, table: pa.Table) -> None:
        lists = pc.split_pattern(table["chunk"].chunk(0), " ")
        sizes = np.diff(lists.offsets.to_numpy())
        self.codes, self.words = codes_of(lists.flatten())
        self.lang, self.names = codes_of(table["lang"].chunk(0))
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
        self.room = np.where(place < table["own"].to_numpy()[row], sizes[row] - place, 0)  # words from here on, 0 in the overlap
        self.times = table["times"].to_numpy()[row]
        self.lang = self.lang[row]

    def pair_slots(self) -> np.ndarray:
        """For each place the slot of its two words: a hash of ``_SLOT_BITS`` bits, the same in every task."""
        with np.errstate(over="ignore"):
            key = mix(_hashes(self.words))[self.codes] + _hashes(self.names)[self.lang]
            key = mix(key[:-1] + mix(_hashes(self.words) + np.uint64(1))[self.codes[1:]]) >> np.uint64(64 - _SLOT_BITS)
        return key.astype(np.int64)


def frequent_pairs(dictionary: DataFrame, least: int) -> np.ndarray:
    """A bitmap in which every pair of words with ``least`` places or more has its bit set, and few others do.

    Pairs are counted by slot, a number instead of two words; slots that reach ``least`` set the bit of
    their last ``_MAP_BITS`` bits. The map has one size however large the corpus; what passes it
    wrongly is counted in full and dropped then.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            at = Places(table)
            here = np.flatnonzero(at.room[:-1] >= 2) if len(at.room) else np.zeros(0, np.int64)
            if not len(here):
                continue
            slots, back = np.unique(at.pair_slots()[here], return_inverse=True)
            f = np.bincount(back, at.times[here]).astype(np.int64)
            for low in range(0, len(slots), 50_000):
                yield record([slots[low : low + 50_000], f[low : low + 50_000]], _SLOTS)

    rows = dictionary.select("lang", "own", "chunk", "times").mapInArrow(count, "slot long, f long")
    enough = rows.groupBy("slot").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    bit = F.col("slot").bitwiseAND(F.lit((1 << _MAP_BITS) - 1))
    words = enough.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("b"))
    found = np.zeros(1 << (_MAP_BITS - 6), np.int64)
    got = words.toArrow()  # two numbers for each word of the map at most: 32 MB
    found[got["w"].to_numpy()] = got["b"].to_numpy()
    return found


def phrases(dictionary: DataFrame, size: int, least: int) -> DataFrame:
    """``lang, size, phrase, f``: every phrase of 1 to ``size`` words with ``least`` places or more, and its places.

    A phrase is as rare as its rarest pair of words, so only those are counted whose pairs may all be frequent.
    """
    shared = dictionary.sparkSession.sparkContext.broadcast(frequent_pairs(dictionary, least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            at = Places(table)
            n = len(at.codes)
            slots = at.pair_slots() & ((1 << _MAP_BITS) - 1)
            paired = (shared.value[slots >> 6] >> (slots & 63)) & 1 > 0
            # Codes of phrases grow by a word at a time; each step is numbered anew, so 63 bits hold it.
            key, may = at.lang, np.ones(n, bool)
            for k in range(1, size + 1):
                if k > 1:
                    key, may = key[:-1], may[: n - k + 1] & paired[k - 2 :]
                here = np.flatnonzero(may & (at.room[: n - k + 1] >= k))
                if not len(here):
                    break
                grown = np.full(n - k + 1, -1, np.int64)
                numbers, one, back = np.unique(key[here] * len(at.words) + at.codes[here + k - 1], return_index=True, return_inverse=True)
                grown[here] = back
                key = grown
                f = np.bincount(back, at.times[here]).astype(np.int64)
                one = here[one]
                for low in range(0, len(one), 20_000):
                    part = one[low : low + 20_000]
                    made = _joined(at.words, at.codes, part, np.full(len(part), k))
                    yield record([at.names.take(pa.array(at.lang[part])), np.full(len(part), k, np.int32), made, f[low : low + 20_000]], _FOUND)

    found = dictionary.select("lang", "own", "chunk", "times").mapInArrow(count, "lang string, size int, phrase string, f long")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _part(phrase: Column, low: int | Column, words: int | Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), low, words), " ")


def _with_counts(cuts: DataFrame, frequent: DataFrame, side: str, out: str) -> DataFrame:
    """``cuts`` with the count of ``side``. Rows that ask for a single word are dealt over its copies."""
    salt = F.when(F.instr(side, " ") == 0, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(0).cast("int")
    copies = F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    counts = frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(out), F.explode(copies).alias("_salt"))
    return cuts.withColumn("_salt", salt).join(counts, ["lang", side, "_salt"]).drop("_salt")


def collocations(
    docs: DataFrame, size: int = SIZE, least: int = LEAST, inside: int = 50, top: int = TOP, every: int = EVERY, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``size`` words.

    A phrase with ``a`` places goes if a longer one that holds it has ``inside`` % of them or more.
    """
    spark = docs.sparkSession
    path = scratch_dir(spark, "colloc-chunks")
    chunks(docs, size, every, text, lang).write.option("compression", "zstd").parquet(path)
    dictionary = spark.read.parquet(path)
    words = dictionary.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    frequent = stored(phrases(dictionary, size, least), "colloc-phrases")
    asked = frequent.where("size >= 2").select("lang", "size", "phrase", F.col("f").alias("a"))

    cuts = asked.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", _part("phrase", 1, F.col("k"))).withColumn("right", _part("phrase", F.col("k") + 1, F.col("size")))
    cuts = _with_counts(_with_counts(cuts, frequent, "left", "l"), frequent, "right", "r")
    score = F.expr("(cast(a as decimal(15)) * cast(a as decimal(15)) * cast(1000000 as decimal(7))) div (cast(l as decimal(19)) * cast(r as decimal(19)))")
    cuts = cuts.withColumn("score", score)
    lowest = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    if size > 2:
        within = asked.where("size > 2").withColumn("at", F.explode(F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> struct(i, m))))")))
        within = within.select("lang", _part("phrase", F.col("at.i"), F.col("at.m")).alias("phrase"), F.col("a").alias("longer"))
        within = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        scored = scored.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))).drop("longer")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    some = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
