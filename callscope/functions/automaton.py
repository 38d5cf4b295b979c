"""Keyword scoring for large dictionaries: one pass over the text, however many keywords.

``keywords.KeywordIndex`` asks a text for each keyword in turn, which suits a pack of a hundred.
Here the keywords become one automaton (a trie with failure links, closed to a table of state and
byte class). Texts are walked in segments, all segments of a block a byte at a time, so that a step
is a handful of array operations over thousands of positions. The result is the same: distinct
keywords present, as bit masks, numbers or category scores.

The table travels as a broadcast. A dictionary whose table would pass ``MAX_CELLS`` becomes several
automata, each of which walks the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from .keywords import _BITS

#: Cells of one automaton's table, four bytes each.
MAX_CELLS = 32_000_000
#: Bytes of text walked at once, and of one segment.
_BLOCK = 4 << 20
_SEGMENT = 2048
#: Flags of a block: texts times states that end a keyword.
_FLAGS = 64 << 20


class Automaton:
    """Walks bytes and tells which of ``words`` (distinct, not empty) occur; words are told by their place."""

    def __init__(self, words: Sequence[bytes]) -> None:
        order = sorted(range(len(words)), key=words.__getitem__)
        longest = max(map(len, words), default=0)
        letters = np.zeros((len(words), longest), np.uint8)
        sizes = np.array([len(words[i]) for i in order], np.int64)
        for row, i in enumerate(order):
            letters[row, : sizes[row]] = np.frombuffer(words[i], np.uint8)
        used = np.unique(np.concatenate([np.frombuffer(w, np.uint8) for w in words])) if words else np.zeros(0, np.uint8)
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        # Words are sorted, so a prefix is a run of rows: a state starts where a row differs from the one before.
        here = np.zeros(len(words), np.int64)
        levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.word = np.full(1 + int(sizes.sum()), -1, np.int64)
        states = 1
        for depth in range(longest):
            alive = sizes > depth
            letter = self.classes[letters[:, depth]].astype(np.int64)
            key = np.where(alive, here * width + letter, -1)
            fresh = alive & np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            number = states + np.cumsum(fresh) - 1
            levels.append((here[fresh], letter[fresh], number[fresh]))
            here = np.where(alive, number, here)
            states += int(fresh.sum())
            ends = alive & (sizes == depth + 1)
            self.word[here[ends]] = np.array(order, np.int64)[ends]
        self.word = self.word[:states]
        self.table = np.zeros((states, width), np.int32)
        fail = np.zeros(states, np.int64)
        self.before = np.zeros(states, np.int64)  # the longest proper suffix that ends a word, or 0
        above = np.zeros(0, np.int64)
        for parent, letter, child in levels:
            fail[child] = np.where(parent > 0, self.table[fail[parent], letter], 0)
            self.table[above] = self.table[fail[above]]
            self.table[parent, letter] = child
            self.before[child] = np.where(self.word[fail[child]] >= 0, fail[child], self.before[fail[child]])
            above = child
        self.table[above] = self.table[fail[above]]
        ending = np.flatnonzero((self.word >= 0) | (self.before > 0))
        self.flag = np.full(states, -1, np.int32)
        self.flag[ending] = np.arange(len(ending))
        self.ending, self.longest, self.width = ending, longest, width
        self.table = self.table.ravel()

    def hits(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text and word, each once, by text and then word."""
        texts = len(offsets) - 1
        if not len(self.ending) or not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Segments overlap by a word less one byte, which is all that a state can remember.
        lengths = np.diff(offsets)
        parts = -(-lengths // _SEGMENT)
        owner = np.repeat(np.arange(texts), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = offsets[owner] + number * _SEGMENT
        end = np.minimum(begin + _SEGMENT, offsets[owner + 1])
        begin = np.maximum(begin - (self.longest - 1), offsets[owner])
        order = np.argsort(begin - end, kind="stable")  # longest first
        owner, begin, size = owner[order], begin[order], (end - begin)[order]
        letters = self.classes[raw]
        seen = np.zeros(texts * len(self.ending), bool)
        at_row = owner * len(self.ending)
        state = np.zeros(len(owner), np.int64)
        live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # segments longer than a step
        for step, n in enumerate(live.tolist()):
            now = self.table[state[:n] * self.width + letters[begin[:n] + step]]
            state[:n] = now
            flag = self.flag[now]
            hit = np.flatnonzero(flag >= 0)
            seen[at_row[hit] + flag[hit]] = True
        pairs = np.flatnonzero(seen)
        text, now = pairs // len(self.ending), self.ending[pairs % len(self.ending)]
        found = []
        while len(now):
            word = self.word[now]
            found.append(text[word >= 0] * len(self.word) + word[word >= 0])
            text, now = text[self.before[now] > 0], self.before[now][self.before[now] > 0]
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both // len(self.word), both % len(self.word)


class Dictionary:
    """``{category: (keyword, ...)}`` as automata; keywords are numbered as ``KeywordIndex`` does."""

    def __init__(self, dictionary: Mapping[str, Sequence[str]]) -> None:
        self.categories = list(dictionary)
        placed = [(c, k) for c, keywords in enumerate(dictionary.values()) for k in dict.fromkeys(keywords)]
        self.size = len(placed)
        self.category = np.array([c for c, _ in placed], np.int64)
        of_word: dict[bytes, list[int]] = {}
        for number, (_, keyword) in enumerate(placed):
            of_word.setdefault(keyword.encode(), []).append(number)
        self.always = np.array(of_word.pop(b"", []), np.int64)
        words = sorted(of_word)
        cells, self.automata = 0, []
        width = 1 + len(set(b"".join(words)))
        shard: list[bytes] = []
        for word in [*words, None]:
            if word is None or (cells + len(word) * width > MAX_CELLS and shard):
                if shard:
                    numbers = [of_word[w] for w in shard]
                    at = np.concatenate([[0], np.cumsum([len(n) for n in numbers])])
                    self.automata.append((Automaton(shard), at, np.array([x for n in numbers for x in n], np.int64)))
                cells, shard = 0, []
            if word is not None:
                shard.append(word)
                cells += len(word) * width

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text and keyword number, each once, in order; null texts have none."""
        found = [np.zeros((2, 0), np.int64)]
        full = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
        raw, offsets = _bytes(pc.fill_null(texts, ""))
        most = max([1, *(len(a.ending) for a, _, _ in self.automata)])
        low = 0
        while low < len(texts):
            high = int(np.searchsorted(offsets, offsets[low] + _BLOCK, side="right")) - 1
            high = min(max(high, low + 1), low + max(1, _FLAGS // most), len(texts))
            part = offsets[low : high + 1]
            for automaton, at, numbers in self.automata:
                text, word = automaton.hits(raw[part[0] : part[-1]], part - part[0])
                times = (at[1:] - at[:-1])[word]
                place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                found.append(np.stack([np.repeat(text + low, times), numbers[np.repeat(at[word], times) + place]]))
            low = high
        found.append(np.stack([np.repeat(full, len(self.always)), np.tile(self.always, len(full))]))
        text, number = np.concatenate(found, axis=1)
        order = np.lexsort((number, text))
        return text[order], number[order]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _shared(dictionary: Mapping[str, Sequence[str]]):
    return SparkSession.active().sparkContext.broadcast(Dictionary(dictionary))


def _offsets(rows: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))


def found_keywords(text: Column, dictionary: Mapping[str, Sequence[str]]) -> Column:
    """Numbers of the keywords in the lower-cased text, ascending: the set bits of its masks."""
    shared = _shared(dictionary)

    @arrow_udf("array<int>")
    def numbers(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            row, number = shared.value.numbers(batch)
            yield pa.ListArray.from_arrays(_offsets(row, len(batch)), pa.array(number.astype(np.int32)))

    return numbers(F.lower(text))


def automaton_masks(text: Column, dictionary: Mapping[str, Sequence[str]]) -> Column:
    """The masks of ``KeywordIndex.masks`` as one array of bigints."""
    shared = _shared(dictionary)

    @arrow_udf("array<bigint>")
    def masks(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            row, number = shared.value.numbers(batch)
            width = max(1, -(-shared.value.size // _BITS))
            bits = np.zeros((len(batch), width), np.int64)
            np.bitwise_or.at(bits, (row, number // _BITS), np.int64(1) << (number % _BITS))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * width), pa.array(bits.ravel()))

    return masks(F.lower(text))


def automaton_scores(text: Column, dictionary: Mapping[str, Sequence[str]]) -> Column:
    """``keyword_scores`` for a dictionary of any size: distinct keywords present, best category first."""
    shared = _shared(dictionary)

    @arrow_udf("array<struct<category:string,score:int>>")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            known: Dictionary = shared.value
            row, number = known.numbers(batch)
            pairs, score = np.unique(row * max(len(known.categories), 1) + known.category[number], return_counts=True)
            row, category = pairs // max(len(known.categories), 1), pairs % max(len(known.categories), 1)
            order = np.lexsort((category, -score, row))
            names = pa.array(known.categories, pa.string()).take(pa.array(category[order]))
            yield pa.ListArray.from_arrays(_offsets(row, len(batch)), pa.StructArray.from_arrays([names, pa.array(score[order].astype(np.int32))], ["category", "score"]))

    return scores(F.lower(text))


def call_keyword_scores(turns: DataFrame, key: str, text: Column, dictionary: Mapping[str, Sequence[str]]) -> DataFrame:
    """``key, scores`` of calls stored as turns: no transcript is assembled and no text shuffled.

    Keyword numbers combine before the shuffle, so a call of a third of all turns arrives as each
    task's distinct keywords.
    """
    known = Dictionary(dictionary)
    names = turns.sparkSession.createDataFrame([(i, int(c), known.categories[c]) for i, c in enumerate(known.category.tolist())], "number int, place int, category string")
    seen = turns.select(key, F.explode_outer(found_keywords(text, dictionary)).alias("number")).distinct()
    # As many rows as the dictionary has keywords, which the broadcast automaton has already.
    counted = seen.join(F.broadcast(names), "number", "left").groupBy(key, "place", "category").agg(F.count("number").cast("int").alias("score"))
    entry = F.struct((-F.col("score")).alias("rank"), "place", "category", "score")
    ranked = counted.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("score") > 0, entry))).alias("e"))
    return ranked.select(key, F.transform("e", lambda e: F.struct(e["category"].alias("category"), e["score"].alias("score"))).alias("scores"))
