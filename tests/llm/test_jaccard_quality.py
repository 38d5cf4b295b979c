"""Operators 1 and 5 against plain Python."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.llm import jaccard_join as J
from callscope.llm.graph import components
from callscope.llm.jaccard_join import jaccard_components
from callscope.llm.quality_rules import FEATURES, fit_quality, keep_quality, quality_rules
from callscope.llm.queries import QUERIES
from callscope.llm.trees import fit_forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_components(texts):
    sets = [shingles(t) for t in texts]
    lead = list(range(len(texts)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                lead[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def corpus(seed, n=260):
    """Copies, chains of ever more edited copies, a hub with borderline copies, shared passages, tiny texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]

    def prose(size):
        return [rng.choice(words) for _ in range(size)]

    def edited(text, times):
        text = list(text)
        for _ in range(times):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        return text

    passage, hub, chain = prose(40), prose(100), prose(90)
    out = [None, "", " \n", "one", "One", "a b c d", "a b c d", "a b c d e", "e d c b a", "ÀB c", "àb c", "same " * 500, "same " * 7]
    while len(out) < n:
        kind = rng.randrange(6)
        if kind == 0:
            out.append(" ".join(prose(rng.randrange(5, 120))))
        elif kind == 1:
            out.append(" ".join(prose(rng.randrange(3, 60)) + passage))
        elif kind == 2:
            out.append(" ".join(edited(hub, rng.randrange(0, 6))))
        elif kind == 3:
            chain = edited(chain, 1)
            out.append(" ".join(chain).upper())
        elif kind == 4:
            out.append(rng.choice(out[3:]))
        else:
            base = (rng.choice(out[3:]) or "").split()
            out.append(" ".join(base[rng.randrange(0, 2) : len(base) - rng.randrange(0, 3)]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_exact(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, n long")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert found == plain_components(texts)


def test_nulls_and_repeated_rows(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(7, text), (7, text), (None, text), (3, text), (None, None), (9, "other words"), (9, text), (None, "alone here")], "doc_id long, text string")
    rows = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect())
    assert rows == {(7, 4, 3): 2, (None, 4, 3): 1, (3, 4, 3): 1, (None, 0, None): 1, (9, 1, 9): 1, (9, 4, 3): 1, (None, 1, None): 1}
    assert jaccard_components(docs.limit(0)).count() == 0


def test_long_chain_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (300, 300)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100}


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def test_rules_on_cases(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "é😀 ü", "a\x1cb c\x85d", "x " * 20000, "a b c d e a b c d e", "a a a a a a", "l one\nl one\nl one \n\nl one", "# * $ % & | < >", "y" * 50000]
    texts += [" ".join(rng.choice("abcd\n") for _ in range(rng.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, score double")
    rows = quality_rules(docs, None).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == counts(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"])
    assert len(rows) == len(texts) and quality_rules(docs.limit(0), None).count() == 0
    assert {r["doc_id"] for r in keep_quality(docs, None).collect()} == {r["doc_id"] for r in rows if r["kept"]}
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert fit_quality(docs, none) is None


def test_rules_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op5_quality_rules"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == counts(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    judged = [(quality[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in quality and not r["base_failed"]]
    assert sum(q == k for q, k in judged) >= 0.98 * len(judged)


def test_trees_keep_their_directions():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + 0.5 * np.sin(3 * x[:, 1]) + 0.3 * rng.normal(size=3000) > 0).astype(float)
    forest = fit_forest(x, y, (1, 0, -1))
    assert np.mean((forest.score(x) > 0.5) == y) > 0.85
    line = np.zeros((200, 3))
    for other in (-1.0, 0.3, 2.0):
        line[:, 1] = other
        for j, sign in ((0, 1), (2, -1)):
            moved = line.copy()
            moved[:, j] = np.linspace(-4, 4, 200)
            assert (sign * np.diff(forest.score(moved)) >= -1e-12).all()
    assert len(FEATURES) == 10


@pytest.mark.parametrize("key", [1, None])
def test_many_texts_of_one_id(spark, key):
    """A third of a table under one id: texts meet their own class, not each other's."""
    rows = [(key, f"text number {k} has these words and others {k} and more {k * 7} of them here") for k in range(1500)] + [(9000, "text number 3 has these words and others 3 and more 21 of them here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wide = J._set_rows(docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).withColumn("_mark", F.xxhash64("_text")))
    classes = wide.select(F.col("_id").alias("rep"), F.col("_mark").alias("rep_mark"), "sig", "n")
    joined = J._sets(docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")), classes)
    assert joined.count() == 1500
    began = time.time()
    found = J.jaccard_components(docs, group="_g").collect()
    assert time.time() - began < 120 and len(found) == 1501
    assert len({r["_g"] for r in found}) == 1500
    assert {r["component_id"] for r in found if r["doc_id"] == 9000} == {1 if key else 9000}


def test_hot_buckets_give_the_same_links(spark, monkeypatch):
    r = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(300):
        words = list(base)
        for _ in range(k % 4):
            words[r.randrange(60)] = f"x{r.randrange(1000)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, f"other text {k} with words {k * 3} that none has") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = []
    for hot in (10**9, 3):
        monkeypatch.setattr(J, "HOT", hot)
        out.append({x["doc_id"]: x["component_id"] for x in J.jaccard_components(docs).collect()})
    plain = plain_components([t for _, t in rows])
    assert out[0] == out[1] == {rows[k][0]: rows[c][0] for k, (_, c) in plain.items()}
