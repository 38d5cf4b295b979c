"""The keyword automaton against plain substring tests and the bit-mask scorer."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callscope.functions import automaton as A
from callscope.functions.keywords import KeywordIndex, keyword_scores
from callscope.packs import TELECOM


def plain(dictionary, text):
    found = []
    for place, (category, words) in enumerate(dictionary.items()):
        n = sum(w in text.lower() for w in dict.fromkeys(words)) if text is not None else 0
        if n:
            found.append((-n, place, category))
    return [(c, -n) for n, _, c in sorted(found)]


def some(r, alphabet, n, longest):
    return ["".join(r.choices(alphabet, k=r.randrange(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("seed,alphabet,longest", [(1, "ab", 7), (2, "abc é日", 5), (3, "aab", 40)])
@pytest.mark.parametrize("cells", [A.MAX_CELLS, 300])
def test_hits_equal_substring_tests(monkeypatch, seed, alphabet, longest, cells):
    monkeypatch.setattr(A, "MAX_CELLS", cells)
    monkeypatch.setattr(A, "_SEGMENT", 16)
    monkeypatch.setattr(A, "_BLOCK", 200)
    r = random.Random(seed)
    dictionary = {f"c{i}": some(r, alphabet, 30, longest) for i in range(5)} | {"none": [], "empty": ["", "a"], "twice": ["ab", "ab", "b"]}
    texts = [None, "", *some(r, alphabet, 60, 200), "a" * 5000]
    known = A.Dictionary(dictionary)
    words = [(c, w) for c, ws in dictionary.items() for w in dict.fromkeys(ws)]
    row, number = known.numbers(pa.array(texts, pa.string()))
    assert list(zip(row.tolist(), number.tolist())) == [(i, n) for i, t in enumerate(texts) if t is not None for n, (_, w) in enumerate(words) if w in t]


def test_columns_agree_with_the_bit_masks(spark):
    r = random.Random(9)
    pack = dict(TELECOM.intents)
    words = [w for ws in pack.values() for w in ws]
    rows = [(i, "".join(r.choices([*words, "ABC", " ", "好"], k=r.randrange(0, 30)))) for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "id int, t string").repartition(3)
    index = KeywordIndex(pack)
    both = df.select("t", keyword_scores(F.col("t"), pack).alias("a"), A.automaton_scores(F.col("t"), pack).alias("b"), F.array(*index.masks(F.lower("t"))).alias("c"), A.automaton_masks(F.col("t"), pack).alias("d"), A.found_keywords(F.col("t"), pack).alias("e"))
    for x in both.collect():
        assert x["a"] == x["b"] and x["c"] == x["d"]
        assert [(e["category"], e["score"]) for e in x["b"]] == plain(pack, x["t"])
        assert sum(bin(m).count("1") for m in x["d"]) == len(x["e"])


def test_calls_as_turns(spark):
    r = random.Random(4)
    dictionary = {"x": ["ab", "c"], "y": ["abc", "b", "zz"], "z": ["q"]}
    turns = [(None if i % 7 == 0 else i % 5, "".join(r.choices("ABcz ", k=6))) for i in range(60)] + [(77, "nothing"), (78, None)]
    found = {x["call"]: [(e["category"], e["score"]) for e in x["scores"]] for x in A.call_keyword_scores(spark.createDataFrame(turns, "call int, t string").repartition(4), "call", F.col("t"), dictionary).collect()}
    joined = {}
    for call, t in turns:
        joined[call] = joined.get(call, "") + "\n" + (t or "")
    assert found == {call: plain(dictionary, t) for call, t in joined.items()}
    empty = spark.createDataFrame([], "call int, t string")
    assert A.call_keyword_scores(empty, "call", F.col("t"), dictionary).collect() == []


def test_time_does_not_follow_the_number_of_keywords():
    r = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = pa.array([" ".join(some(r, letters, 300, 9)) for _ in range(2000)])
    spent = []
    for n in (100, 10_000):
        known = A.Dictionary({"c": ["".join(r.choices(letters, k=9)) for _ in range(n)]})
        known.numbers(text)
        began = time.perf_counter()
        known.numbers(text)
        spent.append(time.perf_counter() - began)
    assert spent[1] < 8 * spent[0]  # a hundred times the keywords


def test_a_state_for_each_prefix():
    words = [b"he", b"she", b"his", b"hers"]
    known = A.Automaton(words)
    assert len(known.word) == 1 + len({w[:i] for w in words for i in range(1, len(w) + 1)})
    text, word = known.hits(np.frombuffer(b"ushers", np.uint8), np.array([0, 6]))
    assert sorted(words[w] for w in word) == [b"he", b"hers", b"she"] and set(text) == {0}
