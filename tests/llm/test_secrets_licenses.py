"""Operators 10 and 2 against plain regular expressions and word sequences."""

import hashlib
import re
import textwrap

import pytest

from callscope.llm.licenses import TEMPLATES, _need, scan_licenses
from callscope.llm.queries import QUERIES
from callscope.llm.secrets import read_ledger, scan_secrets, secret_report
from callscope.session import scratch_dir

FOLDER = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m.group()) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def check_secrets(rows, texts):
    assert len(rows) == len(texts)
    for row in rows:
        want = secrets(texts[row["doc_id"]])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (said, row["spans"])
        for kind in ("assign", "access", "hex"):
            assert row[f"n_{kind}"] == sum(k == kind for k, _, _ in want)


SECRETS = [
    None, "", "token: secret: abcdefgh12", "TOKEN = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\"", "token=secret=abcdefghijk", "api_key:'12345678' apikey=1234567", "Passwd\"  =  'abcdefgh",
    "AKIAAKIA AKIA0123456789AB AKIAAKIA01234567", "x" + "ab01" * 8 + "gab01" * 9, "é😀 password=ééé password=12345678", "0" * 5000, "token " * 3000, "toKen:\n12345678", "AKIA" * 1000, "ſecret=12345678 toKen=12345678",
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20,
]


def test_secret_patterns(spark):
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(SECRETS)], "doc_id long, text string, blob int")
    rows = secret_report(scan_secrets(docs, scratch_dir(spark, "t"))).collect()
    check_secrets(rows, dict(enumerate(SECRETS)))
    assert "pem:" in rows[-1]["spans"] or any("pem:" in r["spans"] and "hub:" in r["spans"] for r in rows)


def test_secrets_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    check_secrets(QUERIES["op10_secrets"](spark, FOLDER).collect(), texts)


def test_ledger_scans_only_what_is_new(spark):
    ledger = scratch_dir(spark, "ledger")
    key = "password=abcdefgh1"
    first = spark.createDataFrame([(1, key), (2, key), (2, key), (3, "clean"), (None, key), (5, None)], "doc_id long, text string")
    assert sorted(len(r["spans"]) for r in scan_secrets(first, ledger).collect()) == [0, 0, 1, 1, 1, 1]
    assert read_ledger(spark, ledger).count() == 3
    seen = []

    def spy(text):
        from pyspark.sql import functions as F

        from callscope.llm.spans import SPAN

        seen.append(1)
        return F.array(F.struct(F.lit("new").alias("kind"), F.lit(9).alias("rank"), F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("value")).cast(SPAN))

    later = first.union(spark.createDataFrame([(7, "fresh")], first.schema))
    rows = scan_secrets(later, ledger, rules=spy).collect()
    assert {r["doc_id"]: [x["kind"] for x in r["spans"]] for r in rows if r["doc_id"]} == {1: ["assign"], 2: ["assign"], 3: [], 5: [], 7: ["new"]}
    assert read_ledger(spark, ledger).count() == 4
    assert all(len(r["spans"]) == 1 for r in scan_secrets(later, ledger, version="2", rules=spy).collect())
    assert read_ledger(spark, ledger).count() == 8
    assert scan_secrets(first.limit(0), scratch_dir(spark, "none")).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}


def licenses(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if tuple(words[k : k + len(phrase)]) == phrase]
    return len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def templates(text):
    """Labels of all windows of all lines, one template after the other."""
    out = set()
    for line in (text or "").split("\n"):
        words = WORD.findall(line.lower())
        for start in range(0, max(len(words) - 32, 1), 32):
            for label, template in TEMPLATES.items():
                want = set(template.split())
                if len(want & set(words[start : start + 64])) >= _need(want, 0.8):
                    out.add(label)
    return out


def check_licenses(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        want = licenses(text)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want, (text or "")[:200]
        assert set(filter(None, r["labels"].split(","))) == set(filter(None, want[4].split(","))) | templates(text)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


LICENSES = [
    None, "", " \n\t", "Under the MIT License under the mit license", "under the\nmit\n\nlicense", "cc-by-nc, CC BY NC cc by nc x", "apache license, version 2.0", "É under the mİt license 2", "the mit licenses",
    "under the mit license " * 500, "word " * 5000 + "Licensed under the GNU General Public License, version 3. This work is", *TEMPLATES.values(), "a " * 40 + TEMPLATES["bsd"] + " b" * 40, "cc by nc", "free software released into the public domain is this unencumbered",
]


def test_license_cases(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(LICENSES)], "doc_id long, text string, labels string")
    check_licenses(scan_licenses(docs).collect(), dict(enumerate(LICENSES)))
    assert scan_licenses(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "cc by nc"), (1, "cc by nc"), (None, "cc by nc"), (1, "other")], "doc_id long, text string")
    assert sorted(r["n_base"] for r in scan_licenses(twice).collect()) == [0, 1, 1, 1]


def test_licenses_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    check_licenses(QUERIES["op2_licenses"](spark, FOLDER).collect(), texts)


def wrapped(text, width):
    return "\n * ".join(textwrap.wrap(text, width))


def test_wrapped_notices(spark):
    """Against windows of the whole text: notices wrapped at some columns, also amid other lines."""
    texts = [wrapped(t, width) for t in TEMPLATES.values() for width in (24, 40, 72)]
    texts += ["words before\n" * 31 + wrapped(t, 40) + "\nand after" * 40 for t in TEMPLATES.values()]
    texts += ["Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal", "no license\n" * 50]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        want = templates(text) | templates(text.replace("\n", " ")) | set(filter(None, licenses(text)[4].split(",")))
        assert set(filter(None, r["labels"].split(","))) == want, text
    labels = {r["doc_id"]: r["labels"].split(",") for r in rows}
    assert all(label in labels[3 * k + j] and label in labels[3 * len(TEMPLATES) + k] for k, label in enumerate(TEMPLATES) for j in range(3))
    assert labels[4 * len(TEMPLATES)] == ["mit"]


@pytest.mark.parametrize("size", [30, 60, 90, 200])
def test_templates_of_any_length_at_every_offset(spark, size):
    """Held whole, at a share of 1, at each place that a window may cut."""
    template = {"long": " ".join(f"w{k}" for k in range(size)), "short": "one two three four five"}
    offsets = range(0, 140, 7) if size < 200 else (0, 1, 20, 255, 256, 300, 511)
    texts = [" ".join([f"x{k % 5}" for k in range(n)]) + ("\n" if n % 2 else " ") + template["long"].replace("w9 ", "w9\n") + " y" * 90 for n in offsets]
    missing = [t.replace("w1 ", "z1 ").replace("w2 ", "z2 ") for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts + missing)), "doc_id long, text string")
    whole = {r["doc_id"]: r["labels"] for r in scan_licenses(docs, share=1.0, templates=template).collect()}
    assert [whole[k] for k in range(len(texts))] == ["long"] * len(texts) and set(list(whole.values())[len(texts):]) <= {"", "long"}
    assert all(whole[len(texts) + k] == "" for k in range(len(texts)))
    loose = {r["doc_id"]: r["labels"] for r in scan_licenses(docs, share=0.9, templates=template).collect()}
    assert set(loose.values()) == {"long"}
