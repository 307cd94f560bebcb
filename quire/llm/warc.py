"""WARC archives: a writer with revisit records, and a reader that salvages what it can.

The writer builds records as rows and writes them with Spark's text sink (record end as line separator), so archives
can be in any store that Spark writes. Of records with equal payloads one, of the least page_id, is a response, the
others are revisits of it without a payload. Records are written by size class (CLASSES), each with so many records to
an archive that none has over ROLL bytes of payload, unless it is a single record.

The reader gets whole archives as binary rows. It checks each record's version line, header, length, end mark and block
digest. After a failed check it goes on at the record's declared end, if a record or the end of the data follows there;
else it looks for the next gzip member, or version line after an end mark (before the first record, any version line),
so that records quoted in a damaged page are not taken for records. The bytes between are logged as a quarantined gap.
Archives may be plain, or have gzip members (one or more records each). Members are inflated in bounded steps and read
once, in time linear in the archive; what a member holds is given out when its check sum is found right (of members
over HOLD bytes, as it is read). An archive of another writer has to fit one binary row (2 GB).

Nulls: a null html is an empty payload; a null page_id is larger than any other and comes back as null; a null url is
empty. Of rows equal in page_id and payload one is the response, if theirs is the least page_id. Record ids hold the
page_id, a digest of url and payload, and a running number of equal rows, so they are unique. Very long pages are one
record each. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import scratch_path, small, staged, table

#: Bytes of payloads in an archive at most, and the largest payload of each class but the last, which has no bound.
ROLL = 64 << 20
CLASSES = (32 << 10, 1 << 20)
#: Bytes that are inflated at a time, fed to the inflater at a time, searched for a header's end, and held of a member.
CHUNK = 1 << 20
FEED = 1 << 14
HEADER = 1 << 16
HOLD = 32 << 20
VERSION = "WARC/1.1"
END = "\r\n\r\n"
#: A fixed date, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of SHA-1: 8 groups of 20 bits, from base 16 to base 32."""
    hexed = F.sha1(data.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def _header(*fields: tuple[str, Column | str]) -> Column:
    lines: list[Column] = [F.lit(VERSION)]
    for name, value in fields:
        lines += [F.lit(f"\r\n{name}: "), F.lit(value) if isinstance(value, str) else value]
    return F.concat(*lines, F.lit(END))


def _key(payload: str | Column) -> Column:
    return F.concat(F.sha2(payload, 256), F.lit(":"), F.octet_length(payload))


def _tag(key: Column, url: Column) -> Column:
    return F.substring(F.sha2(F.concat(key, F.lit(" "), url), 256), 1, 16)


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload, its digests, record_type, refers_to, record_id and refers_id.

    Payloads are counted by their keys. Only those that occur twice or more are joined back, by a broadcast if they are
    few (counted); rows that are equal altogether are counted, and made again from the count.
    """
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("_key", _key("payload"))
    counts = staged(rows.groupBy("_key", "page_id", "url").agg(F.count("*").alias("n")), "warc_counts")
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("url").alias("url")))
    groups = counts.groupBy("_key").agg(F.sum("n").alias("all"), least.alias("first")).filter("all > 1")
    many = small(staged(groups.select(F.col("_key").alias("g_key"), "first"), "warc_groups"))
    again = staged(counts.filter("n > 1").select(F.col("_key").alias("r_key"), F.col("page_id").alias("r_page"), F.col("url").alias("r_url"), "n"), "warc_repeats")
    once = rows.withColumn("_at", F.lit(1).cast("long"))
    if not again.isEmpty():
        repeats = small(again)
        on = (rows["_key"] == repeats["r_key"]) & rows["page_id"].eqNullSafe(repeats["r_page"]) & (rows["url"] == repeats["r_url"])
        equal = rows.join(repeats, on).groupBy("page_id", "url", "_key").agg(F.first("payload").alias("payload"), F.first("n").alias("n"))
        equal = equal.select("page_id", "url", "payload", "_key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_at"))
        once = once.join(repeats, on, "left_anti").unionByName(equal)
    joined = once.join(many, once["_key"] == many["g_key"], "left")
    first = F.col("g_key").isNull() | (F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("url") == F.col("first.url")) & (F.col("_at") == 1))
    urn = lambda page, tag, at: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), tag, F.lit(":"), at, F.lit(">"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        sha1_base32(F.col("payload")).alias("digest"),
        F.octet_length("payload").cast("long").alias("n_bytes"),
        F.when(first, "response").otherwise("revisit").alias("record_type"),
        F.when(~first, F.col("first.page_id")).alias("refers_to"),
        urn(F.col("page_id"), _tag(F.col("_key"), F.col("url")), F.col("_at").cast("string")).alias("record_id"),
        F.when(~first, urn(F.col("first.page_id"), _tag(F.col("_key"), F.col("first.url")), F.lit("1"))).alias("refers_id"),
    )


def records(rows: DataFrame) -> DataFrame:
    """with_revisits() to one column, record: the WARC record without its end mark."""
    uri = F.translate("url", "\r\n", "")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    block = F.when(F.col("record_type") == "response", F.concat(http, F.col("payload"))).otherwise(http)
    rows = rows.withColumn("_block", block)
    common = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Block-Digest", F.concat(F.lit("sha1:"), sha1_base32(F.col("_block")))),
        ("Content-Length", F.octet_length("_block").cast("string")),
    ]
    refers = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", F.coalesce(F.col("refers_id"), F.lit("")))]
    head = F.when(F.col("record_type") == "response", _header(*common)).otherwise(_header(*common, *refers))
    return rows.select(F.concat(head, F.col("_block")).alias("record"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes pages (page_id, url, html) as archives under path, with whatever store the path names."""
    rows = with_revisits(pages)
    n = F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit("")))
    which = F.when(n <= CLASSES[0], 0).when(n <= CLASSES[1], 1).otherwise(2)
    most = {r["c"]: r["most"] for r in pages.groupBy(which.alias("c")).agg(F.max(n).alias("most")).collect()}
    for c in sorted(most) or [0]:
        low, high = (-1, *CLASSES)[c], (*CLASSES, None)[c]
        own = rows.filter((F.col("n_bytes") > low) & (F.lit(True) if high is None else F.col("n_bytes") <= high))
        records(own).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", max(1, ROLL // (high or most[c]))).text(path)


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Damaged(ValueError):
    """A record or member that fails a check. end: where it says it ends, if its end mark is there."""

    def __init__(self, why: str, end: int = 0) -> None:
        super().__init__(why)
        self.end = end


class _Source:
    """Bytes from a position on: all of an archive, or a member as it is inflated. Read bytes of a member are let go."""

    def __init__(self, data: bytes | None = None, chunks: Iterator[bytes] | None = None) -> None:
        self.buf, self.pos, self.gone, self.chunks = bytearray() if data is None else data, 0, 0, chunks

    def need(self, n: int) -> bool:
        """Whether n bytes more are there."""
        while self.chunks is not None and len(self.buf) - self.pos < n:
            more = next(self.chunks, None)
            if more is None:
                self.chunks = iter(())
                break
            self.buf += more
        return len(self.buf) - self.pos >= n

    def skip(self, n: int) -> None:
        self.pos += n
        if self.chunks is not None and self.pos >= CHUNK:
            del self.buf[: self.pos]
            self.gone += self.pos
            self.pos = 0

    def at(self) -> int:
        return self.gone + self.pos


GZIP = b"\x1f\x8b\x08"
_NEXT, _ANY = re.compile(rb"\r\n\r\n(?=WARC/1\.)|(?=\x1f\x8b\x08)"), re.compile(rb"(?=WARC/1\.|\x1f\x8b\x08)")


def _record(s: _Source) -> tuple[dict[str, str], bytes, int]:
    """Header, block and length of the record at the source's position."""
    if not s.need(7) or not s.buf.startswith(b"WARC/1.", s.pos):
        raise Damaged("version")
    s.need(HEADER)
    head_end = s.buf.find(b"\r\n\r\n", s.pos, s.pos + HEADER)
    if head_end < 0:
        raise Damaged("header")
    lines = bytes(s.buf[s.pos : head_end]).split(b"\r\n")
    if any(b":" not in x for x in lines[1:]):
        raise Damaged("header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    length = fields.get("content-length", "")
    if not length.isdigit():
        raise Damaged("length")
    start = head_end + 4 - s.pos
    end = start + int(length) + 4
    if not s.need(end) or not s.buf.startswith(b"\r\n\r\n", s.pos + end - 4):
        raise Damaged("end")
    block = bytes(s.buf[s.pos + start : s.pos + end - 4])
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != _digest(block):
        s.need(end + 7)
        raise Damaged("digest", end if len(s.buf) == s.pos + end or s.buf.startswith((b"WARC/1.", GZIP), s.pos + end) else 0)
    return fields, block, end


def _inflated(data: bytes, at: int, ended: Callable[[int], None]) -> Iterator[bytes]:
    """The content of the gzip member at a position, step by step; ended gets the member's end."""
    d = zlib.decompressobj(wbits=31)
    view = memoryview(data)
    while not d.eof:
        fed = view[at : at + FEED]
        if not len(fed):
            raise Damaged("member breaks off")
        try:
            out = d.decompress(fed, CHUNK)
        except zlib.error as e:
            raise Damaged(str(e)) from e
        at += len(fed) - len(d.unconsumed_tail) - len(d.unused_data)
        if out:
            yield out
    ended(at)


Event = tuple[str, int, int, dict[str, str], bytes, str]


def _member(data: bytes, at: int) -> Iterator[Event | int]:
    """What the member at a position holds, with the member's start and the place read to; at last its end."""
    ends: list[int] = []
    held: list[Event] | None = []
    size, records = 0, 0
    source = _Source(chunks=_inflated(data, at, ends.append))
    for kind, _, _, h, b, why in _salvage(source):
        event = (kind, at, at, h, b, why)
        records += kind == "record"
        size += len(b)
        if held is None:
            yield event
            continue
        held.append(event)
        if size > HOLD:
            yield from held
            held = None
    if not ends:
        raise Damaged("member breaks off")
    if not records:
        raise Damaged("member without records", ends[0] - at)
    for kind, _, _, h, b, why in held or ():
        yield kind, at, ends[0], h, b, why
    yield ends[0]


def _resync(s: _Source, first: bool) -> None:
    """To the next place where a record or member can begin, or to the end. first: no record was found before."""
    pattern = _ANY if first else _NEXT
    while True:
        if m := pattern.search(s.buf, s.pos):
            s.skip(m.end() - s.pos)
            return
        left = len(s.buf) - s.pos
        s.skip(max(0, left - 10))
        if not s.need(11):
            s.skip(len(s.buf) - s.pos)
            return


def _salvage(s: _Source) -> Iterator[Event]:
    gap, why, first = None, "", True
    while s.need(1):
        at = s.at()
        try:
            if s.chunks is None and s.buf.startswith(GZIP, s.pos):
                for found in _member(s.buf, at):
                    if isinstance(found, int):
                        s.skip(found - at)
                        continue
                    if gap is not None:
                        yield "gap", gap, at, {}, b"", why
                        gap = None
                    yield found
            else:
                fields, block, n = _record(s)
                if gap is not None:
                    yield "gap", gap, at, {}, b"", why
                    gap = None
                s.skip(n)
                yield "record", at, at + n, fields, block, ""
            first = False
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            if e.end:
                s.skip(e.end)
                first = False
            else:
                # The mark before a version line can begin where the failed place begins, not before.
                s.skip(1)
                _resync(s, first)
    if gap is not None:
        yield "gap", gap, s.at(), {}, b"", why


def salvage(data: bytes) -> Iterator[Event]:
    """kind (record or gap), offset, end, header, block and reason, in order. Offsets of records in a member are the member's."""
    return _salvage(_Source(data))


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">").split(":")[0]
    return int(number) if number.lstrip("-").isdigit() else None


READ = "archive string, kind string, start long, stop long, reason string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string"
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in READ.split(", "))])
#: Rows, and bytes of payloads, of a batch that the reader gives out.
OUT_ROWS, OUT_BYTES = 1000, 16 << 20


def _row(path: str, event: Event, payloads: bool) -> tuple:
    kind, start, stop, h, block, reason = event
    if kind == "gap":
        return path, kind, start, stop, reason, None, None, None, None, None, None, None, None
    head, _, payload = block.partition(b"\r\n\r\n")
    typ = h.get("warc-type", "")
    if typ == "response":
        n, digest = len(payload), _digest(payload)
    else:
        said = [x.split(b":", 1)[1].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        n, digest = int(said[0]) if said and said[0].isdigit() else None, h.get("warc-payload-digest", "").removeprefix("sha1:")
    urn = h.get("warc-record-id", "")
    return path, kind, start, stop, "", _page(urn), h.get("warc-target-uri", ""), n, digest, typ, _page(h.get("warc-refers-to", "")), payload if payloads else None, urn


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
    rows, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""
            for event in salvage(content):
                rows.append(_row(path, event, payloads))
                size += len(event[4])
                if len(rows) >= OUT_ROWS or size >= OUT_BYTES:
                    yield out(rows)
                    rows, size = [], 0
    if rows:
        yield out(rows)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """archives (path, content) to a row per record and per quarantined gap."""
    return archives.select("path", "content").mapInArrow(lambda it: _read(it, payloads), READ)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    return read_archives(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), payloads)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = read_warc(spark, path, payloads=False).filter("kind = 'record'")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, first_value(page_id) OVER w AS first, row_number() OVER w AS nth FROM p WINDOW w AS (PARTITION BY payload ORDER BY page_id NULLS LAST, url))
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  translate(array_to_string(list_transform(range(8), lambda i: to_base(('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT, 32, 4)), ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first END AS refers_to
FROM g
"""
