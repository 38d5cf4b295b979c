"""Operator 12: ARC archives converted to WARC archives.

``read_arc`` walks an archive by its declared lengths. The version block names the fields of a
header line: five in version 1 (URL, IP, date, type, length), ten in version 2 (with result code,
checksum, location, offset and file name). Header lines are matched around the date, so that blanks
in URLs and types do no harm. ``convert`` gives each record the WARC identity it never had: a
name-based UUID of archive, offset and content (a task that runs again gives the same), an ISO date,
a type by what the bytes are (``filedesc`` to ``warcinfo``, HTTP to ``response``, else ``resource``),
and SHA-1 digests of block and payload. Of equal payloads one stays a response and the others become
revisits that refer to it. ``read_warc`` reads archives back by ``Content-Length``.

Archives are read with the ``binaryFile`` source and written with the ``text`` source, so any store of
Spark does. Each record is a gzip member (plain archives are read too); the text source ends a file
with a line feed, which readers skip. An archive holds some ``archive_bytes``; tasks hold one archive
and one record. Both sides of the search for equal payloads are digests, not payloads.

Defined cases: null payloads are empty; URLs that are null or empty are ``-`` and blanks and control
characters in them are percent-encoded; null ids give no header and sort below all others; of repeated
rows one is the response; a date that is no date becomes the archive's own, or else 1970; a record cut
short by the end of its archive is kept and marked ``length``; where no header line stands after a
record, the next line that is one goes on; empty tables and empty files give no records.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import record, release, sized, small_batches, stored

#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 4 << 20
#: Bytes of payload handed over at once.
BATCH_BYTES = 1 << 20
ID_HEADER = "X-Page-Id"
#: Fields of a header line by version; fixed values.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_NAMESPACE = uuid.UUID("7d3ac3f1-5a0f-5d1c-9f8f-0b9d5d3a6c11")
_HEADER = re.compile(rb"(\S.*?) (\S+) (\d{8,17}) (.+)")
_RAW = "archive string, at long, version int, url string, ip string, date string, kind string, length long, content binary, cut string"
_RECORD = "record_id string, type string, uri string, date string, kind string, page string, head binary, payload binary, payload_bytes long, sha1 string, same string, cut string"
_READ = "archive string, record_id string, type string, uri string, date string, page string, refers_to string, declared string, payload_bytes long, payload_digest string, sound boolean, payload binary"


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])


def _batches(rows: Iterator[tuple], schema: str, weight: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some ``BATCH_BYTES`` by the binary at ``weight``."""
    kinds, held, size = _arrow(schema), [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"") + 200
        if size >= BATCH_BYTES:
            yield record(list(zip(*held)), kinds)
            held, size = [], 0
    if held:
        yield record(list(zip(*held)), kinds)
    release()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            yield from batch.slice(start, 64).to_pylist()


class Bytes:
    """An archive as a stream of lines and counted bytes, whether plain, one gzip member or many."""

    def __init__(self, data: memoryview) -> None:
        self.data, self.packed = data, bytes(data[:2]) == b"\x1f\x8b"
        self.next, self.at, self.held, self.low = 0, 0, b"", 0
        self.inflate = None

    def _more(self) -> bool:
        if self.next >= len(self.data):
            return False
        if not self.packed:
            got, self.next = bytes(self.data[self.next : self.next + BATCH_BYTES]), self.next + BATCH_BYTES
        else:
            if self.inflate is None:
                while self.next < len(self.data) and self.data[self.next] in b"\r\n\0":
                    self.next += 1
                if bytes(self.data[self.next : self.next + 2]) != b"\x1f\x8b":
                    self.next = len(self.data)
                    return False
                self.inflate = zlib.decompressobj(31)
            fed = bytes(self.data[self.next : self.next + (64 << 10)])
            try:
                got = self.inflate.decompress(fed)
            except zlib.error:  # a damaged member ends the archive; what came before stands
                self.next = len(self.data)
                return False
            self.next += len(fed) - len(self.inflate.unused_data)
            if self.inflate.eof:
                self.inflate = None
        self.held, self.low = self.held[self.low :] + got, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end, or None."""
        start = self.low
        while (end := self.held.find(b"\n", start)) < 0:
            start = len(self.held) - self.low
            if not self._more():
                if self.low == len(self.held):
                    return None
                end = len(self.held)
                break
        found = self.held[self.low : end]
        self.at += end + 1 - self.low
        self.low = min(end + 1, len(self.held))
        return found.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        """``n`` bytes, or what is left."""
        parts, left = [], n
        while left > 0:
            part = self.held[self.low : self.low + left]
            self.low += len(part)
            left -= len(part)
            parts.append(part)
            if left and not self._more():
                break
        self.at += n - left
        return b"".join(parts)


def parse_header(line: bytes, after_date: int) -> tuple[bytes, bytes, bytes, bytes, int] | None:
    """URL, IP, date, type and length of a header line with so many fields after the date; None if it is none."""
    found = _HEADER.fullmatch(line)
    if not found:
        return None
    after = found[4].rsplit(b" ", after_date - 1)
    if len(after) != after_date or not after[-1].isdigit():
        return None
    return found[1], found[2], found[3], after[0], int(after[-1])


def version_block(content: bytes) -> tuple[int, int] | None:
    """The version that an archive declares, and how many fields its header lines have after the date."""
    first, _, rest = content.partition(b"\n")
    if not first[:1].isdigit():
        return None
    version = 2 if first[:1] == b"2" else 1
    names = rest.partition(b"\n")[0].split()
    if b"Archive-date" not in names or names[-1] != b"Archive-length":
        names = ARC_FIELDS[version].encode().split()
    return version, len(names) - 1 - names.index(b"Archive-date")


def arc_records(data: memoryview) -> Iterator[tuple]:
    """``at, version, url, ip, date, kind, length, content, cut`` of each record of an archive."""
    stream, version, after_date = Bytes(data), 1, 2
    while True:
        at = stream.at
        line = stream.line()
        if line is None:
            return
        opening = line.startswith(b"filedesc:")  # its line has five fields, or all, where the type takes in the rest
        header = parse_header(line, 2 if opening else after_date)
        if header is None:  # a blank line, or what a wrong length left over
            continue
        url, ip, date, kind, length = header
        content = stream.take(length)
        if opening:
            version, after_date = version_block(content) or (version, after_date)
            kind = kind.split(b" ")[0]
        text = [x.decode("utf-8", "replace") for x in (url, ip, date, kind)]
        yield at, version, *text, length, content, "length" if len(content) < length else None


def _from_files(spark: SparkSession, folder: str, walk, schema: str, weight: int, named: bool = True) -> DataFrame:
    """What ``walk`` yields of each file's bytes and name; ``named`` puts the name first."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    name = path.rsplit("/", 1)[-1]
                    body = content.as_buffer()
                    for found in walk(memoryview(body).cast("B") if body is not None and body.size else memoryview(b""), name):
                        yield (name, *found) if named else found

        yield from _batches(rows(), schema, weight)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(read, schema)


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the ARC archives in ``folder`` as it stands there, the version blocks included."""
    return _from_files(spark, folder, lambda data, _: arc_records(data), _RAW, 8)


def iso_date(date: str, other: str) -> str:
    """14 digits, or fewer that are filled up, as an ISO date."""
    for digits in (date, other):
        try:
            full = (digits or "")[:14].ljust(14, "0")
            return datetime.datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
        except ValueError:
            continue
    return "1970-01-01T00:00:00Z"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Header with its blank line, and body."""
    found = re.search(rb"\r?\n\r?\n", content)
    return (content[: found.end()], content[found.end() :]) if found else (content, b"")


def header_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\s*$", head)
    return found[1].decode("utf-8", "replace") if found else None


def warc_identity(archive: str, records: Iterator[tuple], payloads: bool, id_header: str) -> Iterator[tuple]:
    """What ``_RECORD`` says of each of an archive's ``arc_records``; ``same`` is the mark of equal payloads."""
    began = ""
    for at, version, url, _, date, kind, _, content, cut in records:
        if url.startswith("filedesc:"):
            began = date
            info = f"software: callscope\r\nformat: WARC File Format 1.0\r\nconversion: ARC {version}\r\narc-file: {url[9:].lstrip('/')}\r\n"
            kind, shown, head, body = "warcinfo", "application/warc-fields", b"", info.encode()
        elif content[:5] == b"HTTP/":
            kind, shown = "response", "application/http; msgtype=response"
            head, body = split_http(content)
        else:
            kind, shown, head, body = "resource", kind, b"", content
        sha = sha1_32(body)
        name = uuid.uuid5(_NAMESPACE, f"{archive} {at} {url} {date} {sha}")
        page = header_value(head, id_header) if kind == "response" else None
        same = hashlib.sha256(body).hexdigest()[:40] if kind == "response" and not payloads else None
        yield f"<urn:uuid:{name}>", kind, url, iso_date(date, began), shown, page, head, body if payloads else None, len(body), sha, same, cut


def arc_as_warc(spark: SparkSession, folder: str, payloads: bool = True, id_header: str = ID_HEADER) -> DataFrame:
    """The records of ARC archives as WARC records, read and named in one pass; without payloads, with ``same``."""
    return _from_files(spark, folder, lambda data, name: warc_identity(name, arc_records(data), payloads, id_header), _RECORD, 7, named=False)


def _salted(rows: DataFrame, few: DataFrame, left: str, right: str, spread: Column, salts: int = 16) -> DataFrame:
    """Left join on a key that may hold a third of ``rows``: by broadcast up to a counted size, else dealt over salts."""
    small = sized(few)
    if small is not few:
        return rows.join(small, F.col(left) == F.col(right), "left").drop(right)
    many = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = rows.withColumn("_deal", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return keyed.join(many, (F.col(left) == F.col(right)) & (F.col("_deal") == F.col("_salt")), "left").drop(right, "_salt", "_deal")


def responses_and_revisits(records: DataFrame, seen: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``records`` with ``refers, refers_uri, refers_date``, null for what is written whole.

    ``seen`` are the same records without payloads. Of equal payloads of ``least_bytes`` or more the
    one with the largest page id, as a number, stays.
    """
    whole = seen.where(f"type = 'response' and payload_bytes >= {int(least_bytes)}")
    best = F.max(F.struct(F.expr("try_cast(page as bigint)").alias("number"), "record_id", "uri", "date"))
    first = whole.groupBy("same").agg(best.alias("b"), F.count("*").alias("c")).where("c > 1")
    first = stored(first.select(F.col("same").alias("_same"), F.col("b.record_id").alias("refers"), F.col("b.uri").alias("refers_uri"), F.col("b.date").alias("refers_date")), "warc-first")
    others = _salted(whole.select("record_id", "same"), first, "same", "_same", F.col("record_id")).where("refers <> record_id")
    others = stored(others.select(F.col("record_id").alias("_id"), "refers", "refers_uri", "refers_date"), "warc-revisits")
    # A row for each revisit: by broadcast up to a counted size, else payloads are shuffled by their own names.
    return records.join(sized(others), F.col("record_id") == F.col("_id"), "left").drop("_id")


def warc_record(r: dict) -> bytes:
    """One record with its header, as it stands in an archive."""
    revisit = r["refers"] is not None
    block = r["head"] if revisit else (r["head"] or b"") + (r["payload"] or b"")
    fields = [("WARC-Type", "revisit" if revisit else r["type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"])]
    if r["type"] != "warcinfo":
        fields.append(("WARC-Target-URI", r["uri"]))
    if revisit:
        profile = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
        fields += [("WARC-Profile", profile), ("WARC-Refers-To", r["refers"]), ("WARC-Refers-To-Target-URI", r["refers_uri"]), ("WARC-Refers-To-Date", r["refers_date"])]
    if r["type"] != "warcinfo":
        fields.append(("WARC-Payload-Digest", f"sha1:{r['sha1']}"))
    if r["cut"]:
        fields.append(("WARC-Truncated", r["cut"]))
    fields += [("WARC-Block-Digest", f"sha1:{sha1_32(block)}"), ("Content-Type", r["kind"]), ("Content-Length", str(len(block)))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _write(df: DataFrame, folder: str, one, opening, archive_bytes: int) -> None:
    """Archives of gzip members, a file for each row that the tasks make."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for r in _rows(batches):
            if not held:
                held.append(_member(opening(number, r)))
            held.append(_member(one(r, number)))
            size += len(held[-1])
            if size >= archive_bytes:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                held, size, number = [], 0, number + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
        release()

    made = df.mapInArrow(build, "value binary").select(F.col("value").cast("string"))
    made.write.option("maxRecordsPerFile", 1).text(folder)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """WARC archives of ``records`` with ``refers``; each opens with the converter's own ``warcinfo``."""

    def opening(number: int, r: dict) -> bytes:
        info = b"software: callscope\r\nformat: WARC File Format 1.0\r\n"
        name = uuid.uuid5(_NAMESPACE, f"opening {r['record_id']}")
        return warc_record({"refers": None, "type": "warcinfo", "record_id": f"<urn:uuid:{name}>", "date": r["date"], "head": b"", "payload": info, "kind": "application/warc-fields", "cut": None})

    _write(records, folder, lambda r, _: warc_record(r), opening, archive_bytes)


def warc_records(data: memoryview, payloads: bool, id_header: str) -> Iterator[tuple]:
    stream = Bytes(data)
    while (line := stream.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.take(int(fields.get("content-length", "0")))
        kind, http = fields.get("warc-type", ""), fields.get("content-type", "").startswith("application/http")
        head, body = split_http(block) if http else (b"", block)
        sound = fields.get("warc-block-digest", "") in ("", f"sha1:{sha1_32(block)}")
        declared = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        mine = None if kind == "revisit" else sha1_32(body)
        sound = sound and (mine is None or declared in (None, mine))
        page = header_value(head, id_header)
        yield fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), page, fields.get("warc-refers-to"), declared, None if mine is None else len(body), mine, sound, body if payloads else None


def read_warc(spark: SparkSession, folder: str, payloads: bool = True, id_header: str = ID_HEADER) -> DataFrame:
    """Every record of the WARC archives in ``folder``; ``sound`` says whether its digests hold."""
    return _from_files(spark, folder, lambda data, _: warc_records(data, payloads, id_header), _READ, 11)


def write_arc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Pages as ARC archives, of version 1 and version 2 in turn, as a crawler of the time left them."""
    opened = "20000101000000"

    def opening(number: int, _: dict) -> bytes:
        version = 1 + number % 2
        block = f"{version} 0 callscope\n{ARC_FIELDS[version]}\n\n".encode()
        rest = "text/plain" if version == 1 else f"text/plain 200 - - 0 pages-{number}.arc"
        return f"filedesc://pages-{number}.arc 0.0.0.0 {opened} {rest} {len(block)}\n".encode() + block + b"\n"

    def one(r: dict, number: int) -> bytes:
        body = (r["html"] or "").encode()
        page = "" if r["page"] is None else f"{ID_HEADER}: {r['page']}\r\n"
        content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(body)}\r\n\r\n".encode() + body
        shown = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["url"] or "") or "-"
        rest = "text/html" if number % 2 == 0 else f"text/html 200 {sha1_32(body)} - 0 pages-{number}.arc"
        return f"{shown} 0.0.0.0 {opened} {rest} {len(content)}\n".encode() + content + b"\n"

    plain = pages.select(F.col(key).alias("page"), F.col(url).alias("url"), F.col(html).alias("html"))
    _write(plain, folder, one, opening, archive_bytes)


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """The ARC archives of one folder as WARC archives in another."""
    seen = stored(arc_as_warc(spark, arc_folder, payloads=False).drop("head", "payload"), "warc-seen")
    write_warc(responses_and_revisits(arc_as_warc(spark, arc_folder), seen, least_bytes), warc_folder, archive_bytes)


def page_records(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of pages read back from WARC archives."""
    pages = stored(records.where("type in ('response', 'revisit')").select("record_id", "type", "refers_to", "page", "payload_bytes", "payload_digest"), "warc-pages")
    asked = pages.where("type = 'revisit'").select("refers_to").distinct()
    whole = pages.where("type = 'response'").select(F.col("record_id").alias("_id"), F.col("page").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    whole = stored(whole.join(asked, F.col("_id") == F.col("refers_to"), "left_semi"), "warc-referred")
    out = _salted(pages, whole, "refers_to", "_id", F.col("record_id"))
    revisit = F.col("type") == "revisit"
    return out.select(
        F.expr("try_cast(page as bigint)").alias("page_id"),
        F.when(revisit, F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, F.expr("try_cast(_page as bigint)")).alias("refers_to"),
    )


def pages_through_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back."""
    spark = pages.sparkSession
    small_batches(spark)
    arc, warc = scratch_dir(spark, "arc"), scratch_dir(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, least_bytes)
    return page_records(read_warc(spark, warc, payloads=False))
