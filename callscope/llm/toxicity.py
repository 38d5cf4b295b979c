"""Operator 6: toxicity behind disguise, by noisy-channel decoding.

A character trigram model is counted over all documents. A disguised word - leetspeak, spaced
letters, repeated letters - is a lattice of what each character may stand for; Viterbi search
under the model restores the likeliest spellings. Restored words are then scored: words and word
beginnings that mark toxic documents are learned from labelled rows, and boosted trees over their
counts give the score.

Not decoded: a word written with other characters between its letters than separators, blanks and
the signs of ``LEET``, in more than ``PIECES`` pieces of several letters, in pieces longer than
``PIECE``, or in the middle of a longer word.

Null and empty texts and texts without words get the score of no evidence. Repeated rows are
scored each on its own. Without usable labels every score is 0. An empty table gives an empty
result. Other columns are not read; id and labels are no inputs of a score.
"""

from __future__ import annotations

import functools
import itertools
import re
import sys
import types
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, codes_of, hashed_bucket, ids_of, record, texts_of, utf8_bytes, words_of
from .trees import Forest, fit_forest

#: Classes of bytes: no letter, a to z, any other letter.
CLASSES = 28
#: What a character may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou",
}
SWAP, DROP, KEEP_TWO, SPELLINGS = 0.5, 3.0, 0.7, 4
PREFIXES = (4, 5, 6)
#: Words that a worker remembers; it starts anew beyond.
REMEMBERED = 250_000

_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), list(b".,;:?"))
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_PART = re.compile(r"[^\W\d_]+")
_LEET = re.compile(r"[^\W\d_][^\w\s]*[\d@$!|+(*]|[\d@$!|+(*][^\w\s]*[^\W\d_]")
_RUN = re.compile(r"([^\W\d_])\1\1")
_LONG_RUN = re.compile(r"(.)\1{3,}", re.S)
#: Neither letters, digits nor signs that stand for a letter.
_SEPARATOR = re.compile(r"[^\w@$!|+(*]+|_+")
#: Characters of a token that is decoded as one.
LONG = 40
#: Pieces of a word whose blanks may be dropped, and their characters.
PIECES, PIECE = 4, 4
_DOTTED = re.compile(r"[^\W\d_](?:[^\w\s]+[^\W\d_]){3,}")


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts of character classes over all texts, as a cube. A task sends each of its trigrams once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in blocks(batches, "_text", 1 << 20):
            raw, offsets = utf8_bytes(texts_of(batch, "_text"))
            # An edge between texts, so that no trigram spans two.
            c = np.insert(_CLASS[raw], offsets, 0)
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3) if len(c) > 2 else 0
        at = np.flatnonzero(total)
        yield record([at, total[at]], pa.schema([("at", pa.int64()), ("n", pa.int64())]))

    rows = docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(count, "at long, n long")
    found = rows.groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row for each trigram at most
    cube = np.zeros(CLASSES**3)
    cube[found["at"].to_numpy()] = found["n"].to_numpy()
    return cube.reshape((CLASSES,) * 3)


def costs(cube: np.ndarray) -> np.ndarray:
    """-log of the third class after the first two, smoothed by the second and none."""
    one = cube.sum((0, 1)) + 1
    two = cube.sum(0) + 20 * one / one.sum()
    three = cube + 20 * (two / two.sum(1, keepdims=True))[None]
    return -np.log(three / three.sum(2, keepdims=True))


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each place of a word, what may stand there and what that costs in the channel."""
    out: list[list[tuple[str, float]]] = []
    k = 0
    while k < len(word):
        run = 1
        while k + run < len(word) and word[k + run] == word[k]:
            run += 1
        c = word[k]
        if c.isalpha():
            out.append([(c, 0.0)] if run == 1 else [(c * 2, 0.0)] if run == 2 else [(c, 0.0), (c * 2, KEEP_TWO)])
        else:
            out += [[*((x, SWAP) for x in LEET.get(c, "")), ("", DROP if c in LEET else 0.0)]] * (1 if c not in LEET else min(run, 2))
        k += run
    return out


def restore(word: str, cost: np.ndarray, spellings: int = SPELLINGS) -> list[str]:
    """The likeliest spellings of a disguised word: Viterbi over pairs of classes, a few paths each."""
    beam = {(0, 0): [(0.0, "")]}
    for options in lattice(word):
        after: dict[tuple[int, int], list[tuple[float, str]]] = {}
        for (a, b), paths in beam.items():
            for text, channel in options:
                x, y, more = a, b, channel
                for byte in text.encode():
                    z = int(_CLASS[byte])
                    more += cost[x, y, z]
                    x, y = y, z
                after.setdefault((x, y), []).extend((p + more, said + text) for p, said in paths)
        beam = {state: sorted(paths)[:spellings] for state, paths in after.items()}
    ends = sorted((p + cost[a, b, 0], said) for (a, b), paths in beam.items() for p, said in paths)
    return list(dict.fromkeys(said for p, said in ends if said and p <= ends[0][0] + 6.0))[:spellings]


def readings(token: str, cost: np.ndarray) -> list[str]:
    """Words that a token of lower-case text may hold: its plain parts, and restored spellings.

    Longer repetition says no more than three of a character, so runs are cut to three first. A token
    that is still longer than ``LONG`` is read part by part between separators; a part without a
    separator that is longer is decoded whole, for its likeliest spelling only.
    """
    if token.isalpha() and not _RUN.search(token):
        return [token]
    if len(token) > LONG:
        token = _LONG_RUN.sub(r"\1\1\1", token)
    core = _EDGE.sub("", token)
    plain = _PART.findall(core)
    if not (_LEET.search(token) or _RUN.search(core) or _DOTTED.search(core)):
        return plain
    if len(core) > LONG:
        parts = [p for p in _SEPARATOR.split(core) if p]
        if len(parts) > 1:
            return plain + [w for p in parts for w in readings(p, cost)]
        return plain + restore(core, cost, 1)
    tried = [core]
    if _DOTTED.search(core):
        tried.append(re.sub(r"[^\w]", "", core))
    if token[0] in LEET and token[1:2].isalpha():
        tried.append(re.sub(r"[\W_]+$", "", token))
    tail = token.rstrip(".,;:?\"')#%&")
    if tail != core and tail and tail[-1] in LEET and not (len(tail) > 2 and tail[-1] == tail[-2]):
        tried.append(tail)
    return plain + [w for t in tried for w in restore(t, cost)]


def spaced_words(tokens: list[str], cost: np.ndarray, longest: int = 12) -> list[str]:
    """Words spelled one character at a time: every stretch of 4 to ``longest`` of a run with a letter, decoded."""
    letters = "".join(tokens)
    if len(set(letters)) < 3:
        return []
    stretches = (letters[k : k + size] for size in range(4, max(longest, 12) + 1) for k in range(len(letters) - size + 1))
    # What a sign stands for is less sure than a letter.
    return [w for s in stretches if any(map(str.isalpha, s)) for w in restore(s, cost, 1 if s.isalpha() else SPELLINGS)]


def spelling_cost(word: str, cost: np.ndarray) -> float:
    """Cost of a text of letters and blanks under the character model, edges included."""
    classes = [0, 0, *(int(_CLASS[b]) for b in word.encode()), 0]
    return float(sum(cost[a, b, c] for a, b, c in zip(classes, classes[1:], classes[2:])))


def dropped_blank(pieces: list[str], cost: np.ndarray, weights: dict[str, float]) -> float:
    """Weight of the word that short pieces make without the blanks between, 0 if none is marked.

    The lattice keeps a blank or drops it at ``DROP``; the word counts where that is the likelier path.
    Only whole words count, and signs of ``LEET`` only in pieces that have a letter.
    """
    joined = "".join(pieces)
    if joined.isalpha():
        found = [joined]
    elif all(any(map(str.isalpha, p)) for p in pieces):
        found = restore(joined, cost)
    else:
        return 0.0
    best = 0.0
    for word in found:
        weight = weights.get(word, 0.0)
        if weight > best and spelling_cost(word, cost) + DROP * (len(pieces) - 1) <= spelling_cost(" ".join(pieces), cost):
            best = weight
    return best


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]


def _lower(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    raw, offsets = utf8_bytes(pc.utf8_lower(texts))
    # A full stop or comma at a word's end is no part of it; this halves the different words.
    last = np.ones(len(raw), bool)
    last[:-1] = _BLANK[raw[1:]]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    made = np.where(_STOP[raw] & last, 32, raw).astype(np.uint8)
    words, owner = words_of(pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(made.tobytes())))
    codes, dictionary = codes_of(words)
    return codes, owner, dictionary.to_pylist()


def _runs(codes: np.ndarray, owner: np.ndarray, words: list[str]) -> list[tuple[int, list[str]]]:
    """Runs of at least four single letters or signs of ``LEET``, with their text's place. One is a letter."""
    single = np.fromiter((len(w) == 1 and (w.isalpha() or w in LEET) for w in words), bool, len(words))[codes] if len(codes) else np.zeros(0, bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        cuts = [a, *(a + 1 + np.flatnonzero(owner[a + 1 : b] != owner[a : b - 1])).tolist(), b]
        found = [(int(owner[x]), [words[c] for c in codes[x:y]]) for x, y in zip(cuts, cuts[1:]) if y - x >= 4]
        out += [(o, tokens) for o, tokens in found if any(map(str.isalpha, tokens))]
    return out


@dataclass(frozen=True)
class ToxicModel:
    cost: np.ndarray
    weights: dict[str, float]
    forest: Forest
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def known(self) -> dict[str, float]:
        """Words that this worker process has weighed for this model, kept for its later tasks."""
        held = sys.modules.setdefault("_callscope_words", types.ModuleType("_callscope_words")).__dict__
        if held.get("model") != self.name:
            held.update(model=self.name, known={})
        return held["known"]


def _weight(words: list[str], weights: dict[str, float]) -> float:
    best = 0.0
    for w in words:  # the features of ``features_of``, without a list of them
        best = max(best, weights.get(w, 0.0))
        for k in PREFIXES:
            if len(w) <= k:
                break
            best = max(best, weights.get(w[:k] + "-", 0.0))
    return best


def _spaced_weights(tokens: list[str], cost: np.ndarray, weights: dict[str, float], longest: int) -> list[float]:
    """Weights of a run: of its parts of letters alone, and of the whole where signs say more."""
    parts = [list(g) for letters, g in itertools.groupby(tokens, str.isalpha) if letters]
    plain = [_weight(spaced_words(p, cost, longest), weights) for p in parts if len(p) >= 4]
    if len(parts) == 1 and len(parts[0]) == len(tokens):
        return plain
    whole = _weight(spaced_words(tokens, cost, longest), weights)
    return plain + [whole] * (whole > max(plain, default=0.0))


@functools.lru_cache(100_000)
def _splits(word: str) -> tuple[tuple[str, ...], ...]:
    """Every way to write a word as 2 to ``PIECES`` pieces of at most ``PIECE`` characters, one with two or more."""
    out = []

    def cut(rest: str, made: tuple[str, ...]) -> None:
        if not rest:
            if len(made) > 1 and len(made) < len(word):
                out.append(made)
        elif len(made) < PIECES:
            for k in range(1, min(PIECE, len(rest)) + 1):
                cut(rest[k:], (*made, rest[:k]))

    cut(word, ())
    return tuple(out)


def _signed(word: str) -> bool:
    """A short piece with a letter and, not as mere punctuation, a sign of ``LEET``."""
    if len(word) > PIECE or not any(map(str.isalpha, word)):
        return False
    return any(c in LEET for c in _EDGE.sub("", word)) or (word[0] in "$@" and word[1:2].isalpha())


_RUNS: dict[int, tuple] = {}


def _runs_of(weights: dict[str, float]) -> tuple[frozenset[str], frozenset[str], frozenset[tuple[str, str]], frozenset[tuple[str, ...]]]:
    """First pieces, second pieces, both, and all runs of pieces of the marked words, kept for some sets of weights."""
    held = _RUNS.get(id(weights))
    if held is None or held[0] is not weights:
        if len(_RUNS) > 8:
            _RUNS.clear()
        runs = frozenset(r for w in weights if len(w) >= 4 and w.isalpha() for r in _splits(w))
        held = _RUNS[id(weights)] = (weights, frozenset(r[0] for r in runs), frozenset(r[1] for r in runs), frozenset(r[:2] for r in runs), runs)
    return held[1:]


def _broken(codes: np.ndarray, owner: np.ndarray, words: list[str], cost: np.ndarray, weights: dict[str, float]) -> list[tuple[int, float]]:
    """Marked words written as 2 to ``PIECES`` neighbouring short tokens, with their text's place.

    Pieces of letters are looked up as runs of tokens; only where a piece holds a sign is a run decoded.
    At least one piece has two characters, as runs of single ones are read elsewhere.
    """
    n = len(codes)
    firsts, seconds, heads, runs = _runs_of(weights)
    short = np.fromiter((len(w) <= PIECE for w in words), bool, len(words))
    few = np.flatnonzero(short).tolist()
    first, second, signed = (np.zeros(len(words), bool) for _ in range(3))
    for k in few:
        w = words[k]
        first[k], second[k], signed[k] = w in firsts, w in seconds, not w.isalpha() and _signed(w)
    found: set[tuple[int, int]] = set()
    near = np.flatnonzero(first[codes[:-1]] & second[codes[1:]]) if n > 1 else np.zeros(0, np.int64)
    pairs, back = np.unique(codes[near] * len(words) + codes[near + 1], return_inverse=True) if len(near) else (near, near)
    begins = np.fromiter(((words[x // len(words)], words[x % len(words)]) in heads for x in pairs.tolist()), bool, len(pairs))
    for k in near[begins[back]].tolist():
        part = [words[c] for c in codes[k : k + PIECES].tolist()]
        found.update((k, size) for size in range(2, len(part) + 1) if tuple(part[:size]) in runs)
    for k in np.flatnonzero(signed[codes]).tolist() if signed.any() else []:
        for low in range(max(0, k - PIECES + 1), k + 1):
            for size in range(max(2, k - low + 1), PIECES + 1):
                part = codes[low : low + size]
                if len(part) == size and short[part].all() and any(len(words[c]) > 1 for c in part.tolist()):
                    found.add((low, size))
    known: dict[tuple[int, ...], float] = {}
    out = []
    for k, size in sorted(found):
        if k + size <= n and owner[k] == owner[k + size - 1]:
            run = tuple(codes[k : k + size].tolist())
            if run not in known:
                known[run] = dropped_blank([words[c] for c in run], cost, weights)
            if known[run]:
                out.append((int(owner[k]), known[run]))
    return out


def evidence(texts: pa.Array, cost: np.ndarray, weights: dict[str, float], known: dict[str, float]) -> np.ndarray:
    """Evidence of each text: summed, largest and second weight, number of marked words, their share, size."""
    n = len(texts)
    codes, owner, words = _lower(texts)
    if len(known) + len(words) > REMEMBERED:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = _weight(readings(w, cost), weights)
    value = np.fromiter(map(known.__getitem__, words), float, len(words))
    pairs = np.unique(owner * max(len(words), 1) + codes)
    who, what = pairs // max(len(words), 1), value[pairs % max(len(words), 1)] if len(pairs) else np.zeros(0)
    marked = what > 0
    who, what = who[marked], what[marked]
    longest = max(map(len, weights), default=0)
    more = [(o, v) for o, tokens in _runs(codes, owner, words) for v in _spaced_weights(tokens, cost, weights, longest)]
    more += _broken(codes, owner, words, cost, weights)
    if more:
        who, what = np.concatenate([who, [o for o, _ in more]]), np.concatenate([what, [v for _, v in more]])
        who, what = who[what > 0].astype(np.int64), what[what > 0]
    order = np.lexsort((-what, who))
    who, what = who[order], what[order]
    total, count = np.bincount(who, what, n), np.bincount(who, minlength=n)
    first = np.cumsum(count) - count
    padded = np.concatenate([what, np.zeros(3)])
    largest, second, third = (np.where(count > k, padded[np.minimum(first + k, len(padded) - 1)], 0.0) for k in range(3))
    size = np.bincount(np.unique(owner * max(len(words), 1) + codes) // max(len(words), 1), minlength=n)
    return np.stack([total, largest, second, third, count, count / np.maximum(size, 1), np.log1p(size)], axis=1).astype(float)


def _weights(none: dict[str, int], some: dict[str, int], clean: int, toxic: int, least_docs: int, least_weight: float) -> dict[str, float]:
    """Log odds of a feature in toxic against other documents, less one standard error."""
    out = {}
    for f, n1 in some.items():
        if n1 >= least_docs:
            n0 = none.get(f, 0)
            odds = np.log((n1 + 0.5) / (toxic + 1)) - np.log((n0 + 0.5) / (clean + 1)) - np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
            if odds >= least_weight:
                out[f] = float(odds)
    return out


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "toxic", max_rows: int = 20_000, least_docs: int = 3, least_weight: float = 1.0, folds: int = 5,
) -> ToxicModel | None:
    """Learn from at most ``max_rows`` labelled documents, the first by the hash of their ids.

    The character model is counted over all documents. The trees see each labelled row with
    weights learned from the other folds, as they will see new documents; the weights that are
    kept come from all of them. None without labels of both kinds.
    """
    cost = costs(count_trigrams(docs, text_col))
    asked = labels.where(F.col(id_col).isNotNull() & F.col(target).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(target).cast("int").alias("_y"))
    asked = asked.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(asked), "_id")
    found = found.withColumn("_part", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(folds)).cast("int"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        counts: dict[tuple[str, int], list[int]] = {}
        for batch in blocks(batches, "_text"):
            y, part = (ids_of(batch, c).to_numpy(zero_copy_only=False) for c in ("_y", "_part"))
            codes, owner, dictionary = _lower(texts_of(batch, "_text"))
            for k in range(len(y)):
                low, high = np.searchsorted(owner, [k, k + 1])
                marks = {""}  # the document itself
                for c in np.unique(codes[low:high]).tolist():
                    w = dictionary[c]
                    if w not in known:
                        known[w] = [f for r in readings(w, cost) for f in features_of(r)]
                    marks.update(known[w])
                for f in marks:
                    counts.setdefault((f, int(part[k])), [0, 0])[int(y[k])] += 1
        keys = list(counts)
        yield record(
            [[f for f, _ in keys], [k for _, k in keys], [counts[x][0] for x in keys], [counts[x][1] for x in keys]],
            pa.schema([("f", pa.string()), ("part", pa.int32()), ("n0", pa.int64()), ("n1", pa.int64())]),
        )

    counted = found.mapInArrow(words, "f string, part int, n0 long, n1 long").groupBy("f", "part").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    by_mark = counted.groupBy("f").agg(F.collect_list(F.struct("part", "n0", "n1")).alias("p"), F.sum("n1").alias("n1"))
    # Marks of toxic documents only: bounded by the texts of ``max_rows`` rows.
    rows = by_mark.where((F.col("f") == "") | (F.col("n1") >= least_docs)).toArrow().to_pylist()
    none, some = ([{} for _ in range(folds + 1)] for _ in range(2))
    for r in rows:
        n0, n1 = sum(x["n0"] for x in r["p"]), sum(x["n1"] for x in r["p"])
        held = {x["part"]: x for x in r["p"]}
        for k in range(folds + 1):
            mine = held.get(k, {"n0": 0, "n1": 0})
            none[k][r["f"]], some[k][r["f"]] = n0 - mine["n0"], n1 - mine["n1"]
    size = [(none[k].pop("", 0), some[k].pop("", 0)) for k in range(folds + 1)]
    if not size[folds][0] or not size[folds][1]:
        return None
    weights = [_weights(none[k], some[k], *size[k], least_docs, least_weight) for k in range(folds + 1)]

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[dict[str, float]] = [{} for _ in range(folds)]
        for batch in blocks(batches, "_text"):
            part = ids_of(batch, "_part").to_numpy(zero_copy_only=False)
            for k in np.unique(part).tolist():
                some = batch.filter(pa.array(part == k))
                x = evidence(texts_of(some, "_text"), cost, weights[k], known[k])
                yield record([ids_of(some, "_id").cast(pa.int64()), ids_of(some, "_y").cast(pa.float64()), list(x)], pa.schema([("id", pa.int64()), ("y", pa.float64()), ("x", pa.list_(pa.float64()))]))

    held = sorted(found.mapInArrow(rest, "id long, y double, x array<double>").toArrow().to_pylist(), key=lambda r: (r["id"], r["x"]))
    y = np.array([r["y"] for r in held])
    if not len(y) or y.min() == y.max():
        return None
    return ToxicModel(cost, weights[folds], fit_forest(np.array([r["x"] for r in held]), y, (1, 1, 1, 1, 0, 0, 0), trees=50, rate=0.15, least=5))


def score_toxicity(docs: DataFrame, model: ToxicModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, n_marked, strongest`` of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known() if model else {}
        for batch in blocks(batches, "_text"):
            x = evidence(texts_of(batch, "_text"), model.cost, model.weights, known) if model else np.zeros((batch.num_rows, 7))
            value = model.forest.score(x) if model else x[:, 0]
            yield pa.RecordBatch.from_arrays([ids_of(batch, "_id"), pa.array(value), pa.array(x[:, 4].astype(np.int64)), pa.array(x[:, 1])], names=["_id", "score", "n_marked", "strongest"])

    return narrow.mapInArrow(score, f"_id {kind}, score double, n_marked long, strongest double").withColumnRenamed("_id", id_col)


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows by a model that learns no label of the held-out fold (crc32 of the id, modulo 3, is 1)."""
    model = fit_toxicity(docs, labels.where(hashed_bucket(id_col, 3) != 1), id_col, text_col)
    fold = F.coalesce(hashed_bucket(id_col, 3) == 1, F.lit(False))
    return score_toxicity(docs, model, id_col, text_col).select(id_col, fold.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_marked", "strongest")
