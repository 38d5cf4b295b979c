"""Operator 9 against plain regular expressions and counts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from callscope.llm.pii import find_pii, sanitised
from callscope.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def expected(text):
    text = text or ""
    out = []
    for kind, regex in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in regex.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def check(rows, texts):
    assert len(rows) == len(texts)
    for row in rows:
        want = expected(texts[row["doc_id"]])
        for kind in ("email", "ip", "card", "phone"):
            assert row[f"n_{kind}"] == sum(k == kind for k, _, _ in want), (kind, texts[row["doc_id"]][:200])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (said, row["spans"])


TRICKY = [
    None, "", " ", "a@b.c.d@e.f g@h", "a@b.c_d@e.f", "x..y@z.1-2.q, +1 (017) 555-7713.", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 1.2.3", "00000000000000000000000000255.1.1.1",
    "4952935900253052 4952 9359 0025 3052 4952-9359-0025-3053 12345", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1", "+1 2", "+12345678 +123456789012345678", "é@ü.de ä.b@c.de 😀 mail a@b.co", "4952935900253052-4225039295678253",
    "++1 234 567 89- +", "a@b.c" * 50, "a." * 3000 + "@b.c", "a@" + "b." * 5000 + "c", "9" * 5000, "1.1.1.1" * 200, "a@b..c", "@a.b", "AKIA 127.0.0.1:80", "+1+2 345 678 90",
]


def test_base_patterns(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    check(find_pii(docs).collect(), dict(enumerate(TRICKY)))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    check(QUERIES["op9_pii"](spark, folder).collect(), texts)


def test_disclosing_terms(spark):
    """``zorblax`` stands beside one address in every one of its texts; common words and copies disclose nothing."""
    rows = [(k, f"note {k} from zorblax at ann@x.org about thing{k}") for k in range(6)]
    rows += [(100 + k, f"plain note {k} from someone at home about it") for k in range(40)]
    rows += [(200 + k, "quibble writes to bob@y.org") for k in range(9)]
    rows += [(300, "only Zorblax here")]
    out = {r["doc_id"]: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string"), support=3).collect()}
    assert all(out[k]["n_term"] == 1 for k in [*range(6), 300])
    assert "term:5:12" in out[300]["spans"]
    assert all(out[k]["n_term"] == 0 for k in out if 100 <= k < 300)


def test_sanitised(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now", "x"), (2, None, "y"), (None, "ip 1.2.3.4", "z"), (4, "clean", "w"), (5, "", "v")], "doc_id long, text string, _note string").withColumns({"_text": F.lit("a"), "_id": F.lit("b"), "_row": F.lit("c")})
    assert all((r["_text"], r["_id"], r["_row"]) == ("a", "b", "c") for r in sanitised(docs).collect())
    out = {r["_note"]: r["text"] for r in sanitised(docs).collect()}
    assert out == {"x": "mail [EMAIL] now", "y": None, "z": "ip [IP]", "w": "clean", "v": ""}
    assert sanitised(docs).columns == docs.columns
    assert sanitised(docs.limit(0)).count() == 0 and find_pii(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["+" + "1 " * 20000, "token " * 20000, "a.b@" * 5000])
def test_long_texts(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    check(find_pii(docs).collect(), {1: text})


def test_terms_of_values_that_never_repeat(spark):
    """At the defaults: every address is another one, their domain is not."""
    rows = [(k, f"item{k} mail Zorblax person{k}@x.org soon") for k in range(12)]
    rows += [(100 + k, f"plain mail {k} from someone at home, soon, item{k}") for k in range(60)]
    rows += [(300, "only Zorblax here")]
    out = {r["doc_id"]: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[k]["n_term"] == (k < 12 or k == 300) for k in out)


def test_terms_far_from_the_entity(spark):
    """The term stands more than three words and eighty characters from one repeated address."""
    rows = [(k, f"Zorblax can on most days of number{k} " + "and of the week and the year " * 5 + "be reached at the address a@x.org") for k in range(12)]
    rows += [(100 + k, f"on most days one can be reached at the address of number{k} and the week and year") for k in range(60)]
    out = {r["doc_id"]: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string"), support=5).collect()}
    assert all(out[k]["n_term"] == (k < 12) for k in out)


def test_rows_without_an_id_lose_disclosing_terms(spark):
    rows = [(k, f"item{k} mail Zorblax person{k}@x.org soon") for k in range(12)] + [(100 + k, f"plain mail {k} from someone at home, soon, item{k}") for k in range(60)]
    rows += [(None, "only Zorblax here"), (None, "only Zorblax here"), (None, "only clean words"), (100, "another Zorblax"), (None, None)]
    out = sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = [r["text"] for r in out if r["doc_id"] is None]
    assert sorted(texts, key=str) == sorted(["only [TERM] here", "only [TERM] here", "only clean words", None], key=str)
    assert not any("orblax" in (r["text"] or "") for r in out) and len(out) == len(rows)
