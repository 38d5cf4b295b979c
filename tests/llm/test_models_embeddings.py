"""Operators 6, 8 and 4: decoding, held-out accuracy, and links against all pairs."""

import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callscope.llm import embedding_forest as E
from callscope.llm import quality_classifier as P
from callscope.llm import toxicity as T
from callscope.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def cost(spark):
    words = "stupid idiot trash moron you are a what the fool is this silly person good book little apple running ball".split()
    rng = random.Random(1)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(60))) for k in range(50)] + [(99, None)], "doc_id long, text string").coalesce(1)
    cube = T.count_trigrams(docs)
    plain = sum(len(r["text"] or "") for r in docs.collect())
    # Each text has an edge before it; the last trigram ends with the last text.
    assert cube.sum() == plain + 51 - 2 + 1
    return T.costs(cube)


@pytest.mark.parametrize(
    "token, word",
    [("1d10t", "idiot"), ("stuuuupid", "stupid"), ("tr@sh", "trash"), ("m0r0n!!", "moron"), ("s.t.u.p.i.d", "stupid"), ("$tup1d", "stupid"), ("idiot", "idiot"), ("b00k", "book"), ("s-t-u-p-i-d", "stupid")],
)
def test_disguised_words_are_restored(cost, token, word):
    assert word in T.readings(token, cost)


def test_plain_words_are_not_changed(cost):
    assert T.readings("little,", cost) == ["little"] and T.readings("book###", cost) == ["book"]
    assert T.readings("12.5", cost) == [] and T.readings("", cost) == []
    assert "stupid" in T.spaced_words(list("youstupid"), cost) and T.spaced_words(list("a" * 5000), cost) == []


def test_disguise_scores_as_the_word_does(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ba", "lo", "mi", "ru", "te") for b in ("nor", "kal", "sim", "pet", "dun")]
    rows, marks = [], []
    for k in range(600):
        text = [rng.choice(words) for _ in range(40)]
        if k % 4 == 0:
            for w in ("stupid", "idiot", "trash"):
                text[rng.randrange(40)] = w
        rows.append((k, " ".join(text)))
        marks.append((k, int(k % 4 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = T.fit_toxicity(docs, labels)
    base = " ".join(words)
    cases = {1: base, 2: f"{base} stupid idiot trash", 3: f"{base} stup1d 1di0t tr@sh", 4: f"{base} s t u p i d idioooot t.r.a.s.h", 5: "", 6: None}
    found = {r["doc_id"]: r["score"] for r in T.score_toxicity(spark.createDataFrame(list(cases.items()), "doc_id long, text string"), model).collect()}
    assert all(found[k] >= 0.7 for k in (2, 3, 4)) and all(found[k] < 0.5 for k in (1, 5, 6))
    assert T.fit_toxicity(docs, labels.limit(0)) is None
    assert [r["score"] for r in T.score_toxicity(docs.limit(2), None).collect()] == [0.0, 0.0]
    assert T.score_toxicity(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("name, target, modulus, held, least", [("op6_toxicity", "toxic", 3, 1, 0.9), ("op8_quality_classifier", "quality", 5, 0, 0.9)])
def test_held_out_accuracy(spark, name, target, modulus, held, least):
    labels = {r["doc_id"]: r[target] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES[name](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held) and 0 <= r["score"] <= 1
    judged = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in judged) >= least * len(judged) and len(judged) > 50


def test_prior_and_risk():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(2, 1, (4000, 2)), rng.normal(-2, 1, (3000, 2))
    for share in (0.3, 0.8):
        n = 3000
        k = int(share * n)
        model = P.fit_pu(good[:1000], np.concatenate([good[1000 : 1000 + k], bad[: n - k]]))
        assert abs(model.prior - share) < 0.12
        assert (model.score(good) >= 0.5).mean() > 0.95 and (model.score(bad) >= 0.5).mean() < 0.15


def test_risk_on_spark_equals_plain_risk(spark):
    """Loss, gradient and curvature of a table against a loop over its rows, and the same fit from both."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3)).round(1)
    cuts = tuple(np.unique(np.quantile(x[:, j], P.CUTS)) for j in range(3))
    table = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "_id long, x array<double>").repartition(5)
    size = 3 * (P.BINS + 1)
    w = rng.normal(size=size + 1)
    got, places = P.Stored(table, cuts).sums(w), P.binned(x, cuts)
    loss, slope, curve = 0.0, np.zeros(size + 1), np.zeros((size + 1, size + 1))
    for row in places:
        one = np.append(np.isin(np.arange(size), row), True).astype(float)
        s = 1 / (1 + math.exp(-(one @ w)))
        loss, slope, curve = loss + math.log1p(math.exp(one @ w)), slope + s * one, curve + s * (1 - s) * np.outer(one, one)
    assert got.n == 900 and got.loss == pytest.approx(loss)
    assert np.allclose(got.slope, slope) and np.allclose(got.curve, curve)
    at = np.quantile(w[places].sum(1) + w[-1], [0.1, 0.5])
    assert P.Stored(table, cuts).above(w, at)[0] == pytest.approx(P.Unlabelled(places).above(w, at)[0])
    p = places[x.sum(1) > 1]
    a, b = (P.fit_weights(p, u, size, 0.3)[0] for u in (P.Stored(table, cuts), P.Unlabelled(places)))
    assert np.allclose(a, b)

    def risk(w):
        loss = lambda q, sign: np.logaddexp(0, sign * (w[q].sum(1) + w[-1])).mean()
        return 0.3 * loss(p, -1) + max(0.0, loss(places, 1) - 0.3 * loss(p, 1)) + P.RIDGE / 2 * (w[:-1] ** 2).sum()

    # No nearby weights have less risk.
    assert all(risk(a) <= risk(a + 0.05 * rng.normal(size=size + 1)) + 1e-9 for _ in range(200))


def test_quality_reads_every_unlabelled_row(spark, monkeypatch):
    """A kind of junk that is rare in the corpus counts, wherever its ids fall in the hash order."""
    docs = spark.createDataFrame([(k, "a fair text with many good words in it " * (2 + k % 3)) for k in range(400)] + [(1000 + k, "#$% " * 40) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 400, 2)] + [(1000 + k, 0) for k in range(30)], "doc_id long, quality int")
    seen = []
    keep = P.Stored.sums
    monkeypatch.setattr(P.Stored, "sums", lambda self, w: seen.append(keep(self, w)) or seen[-1])
    model = P.fit_quality_pu(docs, labels, max_rows=50)
    assert {s.n for s in seen} == {460.0}
    found = {r["doc_id"]: r["score"] for r in P.score_quality(docs, model).collect()}
    assert max(found[1000 + k] for k in range(60)) < 0.3 < min(found[k] for k in range(400))


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a b c"), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert P.fit_quality_pu(docs, none) is None
    assert [r["score"] for r in P.score_quality(docs, None).collect()] == [0.0] * 4
    assert P.quality_report(docs.limit(0), none).count() == 0


def plain_links(rows, least=0.95):
    """Links and components by all pairs."""
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            scaled = np.array(v, float) / max(map(abs, v))
            good[(i, tuple(v))] = scaled / np.linalg.norm(scaled)
    keys = list(good)
    lead = {i: i for i, _ in keys}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    links = dict.fromkeys(keys, 0)
    for a in keys:
        for b in keys:
            if a != b and len(a[1]) == len(b[1]) and good[a] @ good[b] >= least:
                links[a] += 1
                x, y = sorted((find(a[0]), find(b[0])))
                lead[y] = x
    return links, {i: find(i) for i in lead}


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(40):
        centre = rng.normal(size=16)
        rows += [(25 * c + k, (centre + rng.normal(size=16) * s).tolist()) for k, s in enumerate(rng.choice([0.0, 0.02, 0.1, 0.2, 0.6], 25))]
    rows += [(5000 + k, [2.0 * x for x in rows[7][1]]) for k in range(30)]
    rows += [(6000, None), (6001, [0.0] * 16), (6002, [float("nan")] * 16), (6003, [float("inf")] + [1.0] * 15), (6004, [None] + [1.0] * 15), (6005, []), (6006, [1.0, 2.0]), (6007, [2.0, 4.0]), (6008, [1e300] * 16), (6009, [1e-300] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x"))
    # Small leaves and samples, so that leaves are split again and again.
    found = {r["vec_id"]: r for r in E.near_embeddings(frame, leaf=60, sample=200, trees=14, spill=0.1).collect()}
    links, component = plain_links(rows)
    assert len(found) == len(rows)
    total, got = sum(links.values()), 0
    for (i, _), n in links.items():
        assert found[i]["n_links"] <= n
        got += found[i]["n_links"]
    assert got >= 0.95 * total
    assert sum(found[i]["component_id"] == component[i] for i in component) >= 0.98 * len(component)
    for i in (6000, 6001, 6002, 6003, 6004, 6005):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True)
    assert found[6006]["n_links"] == 1 and found[6007]["component_id"] == 6006 and found[6008]["n_links"] == links[(6008, (1e300,) * 16)]


def test_embedding_cases(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [1.0, 0.01])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in E.near_embeddings(frame).collect() if r["vec_id"] or True)
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (0, 0, None, False), (3, 0, 3, True), (3, 2, 1, False)], key=lambda r: (r[0], r[1]))
    assert E.near_embeddings(frame.limit(0)).count() == 0


def test_routing_reaches_every_leaf_rule():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8))
    tree = E.build(x, 20, 0.1, 5)
    rows, at = E.route(tree, x)
    assert set(rows) == set(range(500)) and (tree["left"][at] < 0).all() and len(rows) > 500
    assert np.bincount(at).max() <= 20


def test_dense_group_larger_than_a_leaf(spark):
    """10 000 distinct vectors within a cosine of about 0.95, and a sparse rest, at the defaults."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=64) + rng.normal(size=(10_000, 64)) * 0.22, rng.normal(size=(2000, 64))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(unit[k : k + 1000] @ unit.T >= 0.95).sum(1) - 1 for k in range(0, len(x), 1000)])
    assert want.sum() > 10_000_000
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(8)
    found = {r["vec_id"]: r for r in E.near_embeddings(frame).collect()}
    got = np.array([found[k]["n_links"] for k in range(len(x))])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
    assert sum(found[k]["component_id"] == 0 for k in range(10_000)) >= 0.99 * (want[:10_000] > 0).sum()
    assert all(found[k]["component_id"] == k for k in range(10_000, 12_000))


@pytest.mark.parametrize("spaced, word", [("s t u p 1 d", "stupid"), ("1 d 1 0 t", "idiot"), ("m 0 r o n", "moron"), ("$ t u p ! d", "stupid"), ("you s t u p i d 1 d i 0 t s", "stupid")])
def test_spaced_leetspeak_is_evidence(cost, spaced, word):
    texts = pa.array([f"a good book {spaced} little", "1 2 3 4 5 6 0 1", "a 1 2 3"])
    found = T.evidence(texts, cost, {word: 2.0}, {})
    assert found[:, 0].tolist() == [2.0, 0.0, 0.0]


@pytest.mark.parametrize("text, word", [("st" + "u" * 45 + "pid", "stupid"), ("a/1d10t/little/stup1d/tr@sh/good/m0r0n/what/the/person", "idiot"), ("st upid", "stupid"), ("id iot", "idiot"), ("st up1d", "stupid"), ("m or on", "moron"), ("iiiiiiiiiiiiiiiiiiiidddddddddddddddddddiiiiiiiiiiiiiiiioooooooooooooootttttt", "idiot")])
def test_long_and_broken_disguises(cost, text, word):
    texts = pa.array([f"a good book {text} little", text, "the good book is this little", "", "x" * 50_000, "the st of upper id in iota"])
    found = T.evidence(texts, cost, {word: 2.0}, {})
    assert found[:, 0].tolist() == [2.0, 2.0, 0.0, 0.0, 0.0, 0.0]


def test_long_words_spelled_apart(cost):
    word = "personappleballbook"
    assert T.evidence(pa.array(["a " + " ".join(word) + " b"]), cost, {word: 2.0}, {})[0, 0] == 2.0


def plain_restore(word, cost):
    """The likeliest spelling by trying every path of the lattice."""
    best = None
    for path in itertools.product(*T.lattice(word)):
        said = "".join(t for t, _ in path)
        classes = [0, 0, *(int(T._CLASS[b]) for b in said.encode())]
        price = sum(p for _, p in path) + sum(cost[a, b, c] for a, b, c in zip(classes, classes[1:], classes[2:]))
        price += cost[classes[-2], classes[-1], 0]
        if said and (best is None or (price, said) < best):
            best = (price, said)
    return best[1]


@pytest.mark.parametrize("token", ["1d10t", "stuuupid", "tr@sh", "m0r0n!!", "$tup1d", "b00k", "a1l1", "*pp!e", "|itt1e", "ba||", "sss111", "x|0|x", "pers0nnn", "+he"])
def test_viterbi_equals_every_path(cost, token):
    assert T.restore(token, cost)[0] == plain_restore(token, cost)
