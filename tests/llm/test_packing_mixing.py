"""Operators 3 and 7 and the pipeline against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from callscope.llm.mixing import LEVELS, keep_mixed, leaf_budgets, mix_sources
from callscope.llm.packing import Encoder, fill, pack, patterns
from callscope.llm.queries import QUERIES

from .test_jaccard_quality import plain_components

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "It's 12 o'clock,OK?", "<|endoftext|> a<|startoftext|>b", "a\x00b \x00 c", "é ́x Ünï", "x\x1cy\x85z w v", "ÅKİ ΣΑΣ", "word " * 9000, "😀" * 300, "a\x0b\x0cb", "日本語 テキスト", "<|ENDOFTEXT|> A,b.C", "a,\u0301b it's.'s don't!'t x.", "K.Å,!!é.è", "...", ".a", "a."]


def plain_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def check(rows, texts, capacity=4096):
    """Every id once, gapless windows, checksums; returns the padding."""
    ids = dict(zip(texts, plain_ids(texts.values())))
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[doc])
    padding = 0
    assert sorted(by_window) == list(range(len(by_window)))
    for parts in by_window.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_words_alone_give_the_ids_of_whole_texts():
    encoder = Encoder(VOCABULARY)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(pa.array([t or "" for t in ODD]))] == plain_ids(ODD)


def test_pack_cases(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)], "doc_id long, text string, offset string")
    check(pack(docs, VOCABULARY).collect(), dict(enumerate(ODD)))
    assert pack(docs.limit(0), VOCABULARY).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    assert len({(r["sequence_id"], r["offset"]) for r in pack(twice, VOCABULARY).collect()}) == 4


def test_pack_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op3_packing"](spark, FOLDER).collect()
    assert check(rows, texts) <= 0.02 * sum(r["length"] for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_every_length(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))}
    held = Counter()
    for pattern, times in patterns(counts, 64):
        assert times > 0 and sum(k * m for k, m in pattern.items()) <= 64
        held.update({k: m * times for k, m in pattern.items()})
    assert held == counts


def test_fill_finds_the_closest_sum():
    rng = random.Random(7)
    for _ in range(50):
        counts = {rng.randrange(3, 40): rng.randrange(1, 4) for _ in range(4)}
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        room = rng.randrange(10, 90)
        assert fill(counts, room)[1] == max(s for s in sums if s <= room)


def plain_budgets(leaves, total, weights, epochs):
    """Recursive sharing, siblings first."""
    out = {}

    def room(path):
        return sum(t * epochs for leaf, t in leaves.items() if leaf[: len(path)] == path)

    def share(path, amount):
        if len(path) == 3:
            out[path] = amount
            return
        children = sorted({leaf[: len(path) + 1] for leaf in leaves if leaf[: len(path)] == path})
        given, open_ = {}, set(children)
        while open_:
            level = (amount - sum(given.values())) / sum(weights.get("/".join(c), 1.0) for c in open_)
            full = {c for c in open_ if room(c) <= level * weights.get("/".join(c), 1.0)}
            for c in full or open_:
                given[c] = room(c) if full else level * weights.get("/".join(c), 1.0)
            open_ -= full or open_
        for c in children:
            share(c, given[c])

    share((), min(total, room(())))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_budgets(spark, seed):
    rng = random.Random(seed)
    leaves = {(f"d{rng.randrange(3)}", f"l{rng.randrange(3)}", f"s{rng.randrange(6)}"): float(rng.choice([0, 10, 100, 1000, 5000])) for _ in range(20)}
    weights = {"d0": 3.0, "d1/l1": 0.5, "d2/l0/s1": 7.0}
    for share in (0.1, 0.8, 5.0):
        total = share * sum(leaves.values())
        frame = spark.createDataFrame([(*k, t) for k, t in leaves.items()], "domain string, lang string, source string, tokens double")
        found = {tuple(r[x] for x in LEVELS): r["budget"] for r in leaf_budgets(frame, total, weights, 2).collect()}
        want = plain_budgets(leaves, total, weights, 2)
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) <= 1 for k in want)


def test_mixing_query(spark):
    rows = QUERIES["op7_mixing"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    leaves, spent = Counter(), Counter()
    for r in rows:
        leaf = tuple(r[x] for x in LEVELS)
        leaves[leaf] += r["n_tokens"]
        spent[leaf] += r["copies"] * r["n_tokens"] + r["part_tokens"]
        assert r["copies"] <= 2 and r["part_tokens"] < max(r["n_tokens"], 1)
    budgets = {tuple(r[x] for x in LEVELS): r["budget"] for r in rows}
    want = plain_budgets({k: float(v) for k, v in leaves.items()}, 0.8 * sum(leaves.values()), {}, 2)
    assert all(abs(budgets[k] - want[k]) <= 1 and spent[k] == budgets[k] for k in want)


def test_mixing_cases(spark):
    rows = [(1, "a b", None, "s"), (1, "a b", None, "s"), (None, None, "en", None), (2, "", "en", "s"), (3, "c " * 5000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("domain", F.lit("clash"))
    found = mix_sources(docs)
    assert found.count() == 5 and mix_sources(docs.limit(0)).count() == 0
    assert {r["copies"] for r in found.where("n_tokens = 0").collect()} == {2}
    kept = keep_mixed(docs, share=1.0)
    assert kept.columns == docs.columns and kept.count() == 5
    assert keep_mixed(docs.limit(0)).count() == 0


def test_pipeline(spark):
    """Each stage on what the one before kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        seen.append(docs.collect())
        docs = spark.createDataFrame(seen[-1], docs.schema)
    raw, good, single, clean, mixed, packed = seen
    verdict = {r["doc_id"]: r["kept"] for r in QUERIES["op5_quality_rules"](spark, FOLDER).collect()}
    assert {r["doc_id"] for r in good} == {d for d, kept in verdict.items() if kept} and all(r in raw for r in good)
    groups = plain_components([r["text"] for r in good])
    leaders = {min(good[j]["doc_id"] for j in groups if groups[j][1] == groups[i][1]) for i in groups}
    assert sorted(r["doc_id"] for r in single) == sorted(leaders)
    assert {r["doc_id"] for r in clean} == leaders and clean != single and not any("@mail" in r["text"] for r in clean)
    assert 0.6 * len(clean) < len(mixed) < len(clean) and all(r in clean for r in mixed)
    check(packed, {r["doc_id"]: r["text"] for r in mixed})
    assert len(corpus_pipeline.run(spark, FOLDER).collect()) == len(packed)


def test_pipeline_cases(spark):
    """Nulls, repeated rows and an empty table go through every stage."""
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text + " x", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    full = spark.createDataFrame(rows, spark.read.parquet(f"{FOLDER}/documents.parquet").schema).withColumn("n", F.lit(1)).withColumn("_id", F.lit("x"))
    for docs in (full, full.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == full.columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()


def test_near_duplicates_without_ids(spark):
    """Exact and near copies whose ids are null or repeat leave one document of each group."""
    base = " ".join(f"w{k}" for k in range(60))
    near = base.replace("w30 ", "x30 ")
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(None, base), (None, base), (None, near), (5, near), (6, base), (None, other), (None, other), (None, other.replace("v9 ", "z9 ")), (7, "alone in this table with its words"), (7, "another text of the same id stays"), (8, "x"), (8, "x"), (None, ""), (None, ""), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    out = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    groups = [x for x in out if x[1] and x[1].startswith("v")]
    assert len(groups) == 1 and groups[0][0] is None
    assert [x for x in out if x not in groups] == sorted([(5, near), (7, rows[8][1]), (7, rows[9][1]), (8, "x"), (None, ""), (None, ""), (9, None)], key=repr)


def test_an_encoder_forgets_by_bytes(monkeypatch):
    """Long words fill the memory of a worker as well as many; ids stay the same when it starts anew."""
    import public_tokenizers
    import pyarrow as pa

    from callscope.llm import packing as P

    texts = [[f"{'w' * 400}{k} same words" for k in range(n, n + 20)] for n in (0, 20, 40, 0)]
    path = public_tokenizers.path("word_bpe_49k.json")
    free, bound = P.Encoder(path), P.Encoder(path)
    wanted = [[ids.tolist() for ids in free.encode(pa.array(t))] for t in texts]
    monkeypatch.setattr(P, "REMEMBERED", 4000)
    assert [[ids.tolist() for ids in bound.encode(pa.array(t))] for t in texts] == wanted
    assert len(bound.known) <= 22 < len(free.known)


def test_an_encoder_keeps_the_words_that_recur(monkeypatch):
    """What is forgotten to make room are words not met lately: those of every block are encoded once."""
    from callscope.llm import packing as P

    learned = Counter()
    learn = P.Encoder._learn
    monkeypatch.setattr(P.Encoder, "_learn", lambda self, words: learned.update(words) or learn(self, words))
    monkeypatch.setattr(P, "REMEMBERED", 4000)
    encoder = P.Encoder(VOCABULARY)
    for n in range(0, 200, 20):
        texts = [f"{'w' * 400}{k} same words" for k in range(n, n + 20)]
        assert [ids.tolist() for ids in encoder.encode(pa.array(texts))] == plain_ids(texts)
        assert len(encoder.known) + len(encoder.older) <= 44
    assert set(learned.values()) == {1} and len(learned) == 202
