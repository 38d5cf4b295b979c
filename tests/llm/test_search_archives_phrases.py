"""Operators 11, 12 and 13 against plain Python."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from callscope.llm import archives
from callscope.llm.archives import Bytes, arc_records, convert, iso_date, page_records, pages_through_archives, parse_header, read_arc, read_warc, version_block, warc_records, write_arc
from callscope.llm.collocations import collocations, parse
from callscope.llm.queries import ORACLES, QUERIES
from callscope.llm.reversed_search import reversed_search
from callscope.session import scratch_dir

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def against_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    wanted = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(wanted, key=repr)
    assert wanted


@pytest.mark.parametrize("name", ["op11_reversed_search", "op12_arc_to_warc", "op13_collocations"])
def test_query_equals_its_sql(spark, name):
    against_sql(spark, name)


# Ranked search


def plain_search(docs, items, k=20):
    terms = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    terms = [(i, t, sum(t.values())) for i, t in terms if t]
    n, total, df = len(terms), sum(c for _, _, c in terms), Counter(w for _, t, _ in terms for w in t)
    out = []
    for item, text in items:
        rows = []
        for i, t, c in terms:
            m = 75 + (25 * c * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * t[w]) // (1000 * t[w] + 12 * m)) for w in TERM.findall(lower(text)) if t[w])
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, row[3], -row[0]) for r, row in enumerate(sorted(rows, key=lambda r: r[:3])[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, **more):
    frame = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, n long, score string")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return sorted(map(tuple, reversed_search(frame.repartition(3), asked, **more).collect()), key=repr)


@pytest.mark.parametrize("postings", [2_000_000, 40])
def test_search_equals_brute_force(spark, postings):
    r = random.Random(3)
    words = ["The", "the", "fox", "É2", "a1", "日本", "x_y", "don't", "zz", "q" * 300]
    docs = [(i, " ".join(r.choices(words, k=r.randrange(0, 40)))) for i in range(150)]
    docs += [(None, None), (None, "fox fox"), (7, "fox fox"), (7, "fox fox"), (900, ""), (901, " ?! "), (902, "zz " * 30_000), (903, "zz\x00fox\x1cfox")]
    items = [(i, " ".join(r.choices(words, k=r.randrange(1, 9)))) for i in range(30)] + [(50, None), (51, "..."), (52, "absent"), (None, "fox"), (3, "zz zz"), (3, "zz zz")]
    assert searched(spark, docs, items, max_postings=postings) == plain_search(docs, items)


def test_search_ties_and_heaps_keep_the_smallest_ids(spark):
    docs = [(i, "same words here") for i in range(3000, 0, -1)] + [(i, "other") for i in range(4000, 9000)]
    found = searched(spark, docs, [(1, "same here"), (2, "other")], k=4)
    assert [(i, rank, d) for i, rank, d, _ in found] == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4), (2, 1, 4000), (2, 2, 4001), (2, 3, 4002), (2, 4, 4003)]


def test_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None), (2, "")], [(1, "a")]) == [] and searched(spark, [(1, "a")], [(1, None)]) == []


# Archives


def plain_pages(pages, least=0):
    by = defaultdict(list)
    for i, _, html in pages:
        by[html or ""].append(i)
    top = {h: max((i for i in ids if i is not None), default=None) for h, ids in by.items()}
    out = []
    for i, _, html in pages:
        body = (html or "").encode()
        first = i == top[html or ""] or len(body) < least
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else top[html or ""]))
    return sorted(out, key=repr)


def some_pages():
    r = random.Random(5)
    same = "<p>WARC/1.0\r\nContent-Length: 3\r\n\r\nhttp://x 0.0.0.0 20010101000000 text/html 5\n</p>"
    pages = [(i, f"http://h/{i} a\nb\x01é", r.choice([same, "", "short", f"<html>{i}</html>", "\n\r\n" * 9, "é" * 700])) for i in range(200)]
    return pages + [(500, None, None), (501, "", "x" * 3_000_000), (502, "http://h/z", "\x00\x1f\x8b")]


@pytest.mark.parametrize("least", [0, 6])
def test_pages_through_archives(spark, least):
    pages = some_pages()
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, same int").repartition(5)
    assert sorted(map(tuple, pages_through_archives(frame, least).collect()), key=repr) == plain_pages(pages, least)


def test_pages_without_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(archives, "sized", lambda df: df)
    pages = some_pages()
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    assert sorted(map(tuple, pages_through_archives(frame).collect()), key=repr) == plain_pages(pages)


def test_repeated_rows_null_ids_and_no_pages(spark):
    frame = spark.createDataFrame([(4, "u", "a"), (4, "u", "a"), (None, "u", "a"), (None, "v", "b"), (None, "v", "b")], "page_id long, url string, html string")
    found = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in pages_through_archives(frame).collect()]
    assert sorted(found, key=repr) == [(4, "response", None, 1), (4, "revisit", 4, 1), (None, "response", None, 1), (None, "revisit", 4, 1), (None, "revisit", None, 1)]
    assert pages_through_archives(frame.where("page_id > 9")).collect() == []


def arc(version, records, packed):
    names = archives.ARC_FIELDS[version]
    block = f"{version} 0 x\n{names}\n\n".encode()
    parts = [f"filedesc://x.arc 0.0.0.0 19990102030405 {'text/plain' if version == 1 else 'text/plain 200 - - 0 x.arc'} {len(block)}\n".encode() + block + b"\n"]
    parts += [line.encode() + b"\n" + body + b"\n" for line, body in records]
    return b"".join(gzip.compress(p) for p in parts) if packed == "members" else gzip.compress(b"".join(parts)) if packed == "whole" else b"".join(parts)


@pytest.mark.parametrize("packed", ["plain", "members", "whole"])
@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines_of_both_versions(version, packed):
    tail = "" if version == 1 else " 404 - - 17 x.arc"
    bodies = [b"HTTP/1.0 200 OK\nA: b\n\nbody\n\n", b"1.2.3.4\n", b"", b"x" * 300_000]
    urls = ["http://a/b c.html", "dns:a", "http://e/", "ftp://long"]
    kinds = ["text/html; charset=x y", "text/dns", "-", "a/b"]
    data = arc(version, [(f"{u} 1.2.3.4 19990102{i:02d}0405 {k}{tail} {len(b)}", b) for i, (u, k, b) in enumerate(zip(urls, kinds, bodies))], packed)
    found = list(arc_records(memoryview(data)))
    assert [(f[2], f[5], f[7]) for f in found[1:]] == list(zip(urls, kinds, bodies))
    assert {f[1] for f in found} == {version} and found[0][2] == "filedesc://x.arc" and found[1][4] == "19990102000405"
    assert len({f[0] for f in found}) == 5 and not any(f[8] for f in found)


def test_wrong_and_short_lengths():
    good = ("http://b/ 1.1.1.1 19990102030405 t/p 4", b"good")
    data = arc(1, [("http://a/ 1.1.1.1 19990102030405 t/p 3", b"more than three\nlines of it"), good, ("http://c/ 1.1.1.1 19990102030405 t/p 90", b"cut")], "plain")
    found = [(f[2], f[7], f[8]) for f in arc_records(memoryview(data))][1:]
    assert found == [("http://a/", b"mor", None), ("http://b/", b"good", None), ("http://c/", b"cut\n", "length")]
    damaged = arc(1, [good, good], "members")
    assert [f[7] for f in arc_records(memoryview(damaged[:-12]))][1:2] == [b"good"]
    assert list(arc_records(memoryview(b""))) == [] and list(arc_records(memoryview(b"\n\n"))) == []


def test_header_lines_and_dates():
    assert parse_header(b"http://a 1.1.1.1 20000101000000 text/html 12", 2)[4] == 12
    assert parse_header(b"http://a 1.1.1.1 20000101000000 text/html 12", 7) is None and parse_header(b"no header", 2) is None
    assert version_block(b"2 0 x\nURL IP-address Archive-date Content-type Result-code Archive-length\n") == (2, 3)
    assert version_block(b"1 0 x\n") == (1, 2) and version_block(b"?") is None
    assert iso_date("19991231235958", "") == "1999-12-31T23:59:58Z" and iso_date("19991231", "") == "1999-12-31T00:00:00Z"
    assert iso_date("19991399000000", "20010203040506") == "2001-02-03T04:05:06Z" and iso_date("x", "") == "1970-01-01T00:00:00Z"
    stream = Bytes(memoryview(b"a\r\nbc"))
    assert (stream.line(), stream.take(1), stream.line(), stream.line(), stream.at >= 5) == (b"a", b"b", b"c", None, True)


def test_types_identifiers_and_digests_of_a_conversion(spark):
    source, target, again = (scratch_dir(spark, x) for x in ("arc-in", "warc-out", "warc-again"))
    body = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nsame"
    records = [("http://a/ 1.1.1.1 19990102030405 text/html " + str(len(body)), body), ("http://b/ 1.1.1.1 19990102030406 text/html " + str(len(body)), body), ("dns:a 1.1.1.1 1999 text/dns 3", b"dns"), ("dns:a 1.1.1.1 19990102 text/dns 3", b"dns")]
    data = arc(1, records, "members")
    spark.createDataFrame([(bytearray(data),)], "value binary").selectExpr("cast(value as string) value").coalesce(1).write.text(source)
    assert read_arc(spark, source).count() == 4  # the line with a date of four digits is none
    for folder in (target, again):
        convert(spark, source, folder)
    rows = read_warc(spark, target).collect()
    assert sorted(r["type"] for r in rows) == ["resource", "response", "revisit", "warcinfo", "warcinfo"]
    assert all(r["sound"] for r in rows) and len({r["record_id"] for r in rows}) == 5
    assert sorted(r["record_id"] for r in rows) == sorted(r["record_id"] for r in read_warc(spark, again).collect())
    kept = next(r for r in rows if r["type"] == "response")
    other = next(r for r in rows if r["type"] == "revisit")
    assert bytes(kept["payload"]) == b"same" and kept["date"].startswith("1999-01-02T03:04:0")
    assert other["refers_to"] == kept["record_id"] and other["declared"] == kept["payload_digest"]
    assert {r["record_type"] for r in page_records(read_warc(spark, target)).collect()} == {"response", "revisit"}
    folder = scratch_dir(spark, "arc-again")
    write_arc(spark.createDataFrame([(i, "u", "x" * 500) for i in range(900)], "page_id long, url string, html string").coalesce(1), folder, archive_bytes=2000)
    versions = {r["archive"]: r["version"] for r in read_arc(spark, folder).collect()}
    assert len(versions) > 3 and set(versions.values()) == {1, 2}


def test_changed_bytes_are_not_sound(spark):
    record = archives.warc_record({"refers": None, "type": "resource", "record_id": "<x>", "date": "d", "uri": "u", "head": b"", "payload": b"abc", "kind": "t", "sha1": archives.sha1_32(b"abc"), "cut": None})
    assert next(warc_records(memoryview(record), True, "X"))[9]
    assert not next(warc_records(memoryview(record.replace(b"abc", b"abd")), True, "X"))[9]


# Phrases


def plain_phrases(rows, size=3, least=10, inside=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(w)
            for m in range(1, size + 1):
                f[lang].update(w[i : i + m] for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        asked = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in asked.items():
            if any(100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in asked.items() if len(q) > len(p)):
                continue
            s, _, left, right = min(((10**6 * a * a) // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, r + 1, b.decode(), -a, x, y, n[lang], -s) for r, (s, a, b, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], "doc_id long, lang string, text string, own int, f string")
    return sorted(map(tuple, collocations(frame.repartition(3), **more).collect()))


@pytest.mark.parametrize("size,every,least", [(3, 8, 10), (3, 1, 3), (2, 3, 5), (4, 2, 4)])
def test_phrases_equal_brute_force(spark, size, every, least):
    r = random.Random(size)
    words = ["A", "a", "of", "the", "é", "x\x1cy", "b c", "日本"]
    text = lambda k: "".join(w + r.choice([" ", " ", " ", "\t ", ". ", "\n", "\x0b", ""]) for w in r.choices(words, k=k))
    rows = [(r.choice(["en", "fr", None, "und"]), text(r.randrange(0, 60))) for _ in range(120)]
    rows += [("en", None), ("fr", ""), ("de", " .\n"), ("en", "of the " * 5000), ("fr", rows[0][1])] + [("xx", "new york city hall")] * 400
    assert mined(spark, rows, size=size, every=every, least=least) == plain_phrases(rows, size, least)


@pytest.mark.parametrize("bits", [(8, 7), (3, 7), (40, 6)])
def test_phrases_are_whole_with_a_full_map(spark, monkeypatch, bits):
    """A map too small for the pairs lets too many through, and loses none."""
    from callscope.llm import collocations as module

    monkeypatch.setattr(module, "_SLOT_BITS", bits[0])
    monkeypatch.setattr(module, "_MAP_BITS", bits[1])
    r = random.Random(8)
    rows = [("en", " ".join(f"w{int(r.expovariate(0.08))}" for _ in range(300))) for _ in range(20)]
    assert mined(spark, rows, least=5) == plain_phrases(rows, least=5)


def test_phrases_cut_to_the_first_and_none(spark):
    rows = [("en", "a b c d e f g h. b c. b c")] * 10
    assert mined(spark, rows, top=3, inside=101) == plain_phrases(rows, inside=101, top=3)
    assert mined(spark, []) == [] and mined(spark, [("en", "a b")] * 9) == []


def test_products_beyond_64_bits(spark, monkeypatch):
    from callscope.llm import collocations as module

    big = 3_000_000_000
    rows = [("en", 1, "a", big), ("en", 1, "b", big + 7), ("en", 2, "a b", big - 1)]
    monkeypatch.setattr(module, "phrases", lambda dictionary, size, least: spark.createDataFrame(rows, "lang string, size int, phrase string, f long"))
    found = collocations(spark.createDataFrame([("en", "a b")], "lang string, text string")).collect()
    assert [r["score"] for r in found] == [(10**6 * (big - 1) ** 2) // (big * (big + 7))]


def test_chunks_own_every_word_once_and_repeat_in_repeated_passages():
    r = random.Random(1)
    passage = " ".join(f"w{r.randrange(50)}" for _ in range(300))
    texts = [f"intro {i} {passage} outro {i}" for i in range(5)]
    owner, own, chunk = parse(pa.array(texts))
    assert [sum(own[owner == i]) for i in range(5)] == [304] * 5
    sets = [set(c for c, o in zip(chunk.to_pylist(), owner) if o == i) for i in range(5)]
    assert len(set.intersection(*sets)) > 0.8 * min(map(len, sets))
