"""WARC archives of pages, and a reader that splits them by byte range (operator 7).

Records are gzip members of their own, as usual. A page whose payload another
page already holds is written as a revisit. The reader gives every task a byte
range: it looks for the gzip magic there, keeps a place only if what it decodes
to begins like a record, and owns the records that begin inside its range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.llm.common import Batches, arrow_schema, attempt_name, fresh_folder, open_file, stored, write_once

GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT_BYTES = 1000
RANGE_BYTES = 8 << 20
BLOCK = 1 << 18
#: A payload on more than this part of all pages is hot; so there are at most a thousand of them.
HOT_PART = 1000
ARCHIVES = "path string, bytes long, n_records long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def with_heads(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html, digest, head``: the page that holds the payload in full, null where that is the page itself.

    Only one count and one id per digest are shuffled for it. Payloads on more
    than a thousandth of all pages, at most a thousand, are sent along; the rest
    is joined on the digest, so no key has more than a thousandth of the pages.
    """
    own = pages.select(
        F.col(page).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"),
    )
    digested = own.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    shared = stored(
        digested.filter(F.octet_length("html") >= least_bytes)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("head"))
        .filter("n > 1 and head is not null"),
        "digests",
    )
    total = pages.count()
    is_hot = F.col("n") * HOT_PART > total
    hot = shared.filter(is_hot).select("digest", F.col("head").alias("hot_head"))
    rest = shared.filter(~is_hot).select(F.col("digest").alias("key"), "head")
    # Pages that have found theirs get keys of their own, which no digest equals.
    spread = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    found = digested.join(F.broadcast(hot), "digest", "left")
    keyed = found.withColumn("key", F.when(F.col("hot_head").isNull(), F.col("digest")).otherwise(spread))
    joined = keyed.join(rest, "key", "left").withColumn("head", F.coalesce("hot_head", "head")).drop("key", "hot_head")
    return joined.withColumn("head", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")))


def _header(lines: list[tuple[str, object]]) -> bytes:
    return b"".join(f"{name}: {value}\r\n".encode() for name, value in lines if value is not None)


def _urn(kind: str, key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{key}')}>"


def _address(url: str | None, page_id: int | None) -> str:
    """The url with everything outside printable ASCII percent-encoded; a urn where there is none."""
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], url.encode()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, head: int | None, date: str) -> bytes:
    """One page as an uncompressed record; without the payload if ``head`` holds it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = head is not None
    block = http if revisit else http + payload
    label = base64.b32encode(bytes.fromhex(digest)).decode()
    top = _header(
        [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", _urn("revisit" if revisit else "response", page_id)),
            ("WARC-Date", date),
            ("WARC-Target-URI", _address(url, page_id)),
            ("WARC-Payload-Digest", f"sha1:{label}"),
            ("WARC-Refers-To", _urn("response", head) if revisit else None),
            ("WARC-Profile", REVISIT_PROFILE if revisit else None),
            ("WARC-Page-Id", page_id),
            ("WARC-Refers-To-Page-Id", head),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", len(block)),
        ]
    )
    return b"WARC/1.1\r\n" + top + b"\r\n" + block + b"\r\n\r\n"


def _member(plain: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(plain) + packer.flush()


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "2000-01-01T00:00:00Z", **columns: str) -> DataFrame:
    """Writes one archive per task and lists the finished ones: ``path, bytes, n_records``.

    Payloads of at least ``LEAST_REVISIT_BYTES`` that are equal: the page with
    the largest id is the response, the others revisit it. Rows that repeat
    that id are responses too. Null html is an empty payload, a null url
    becomes a urn, pages without id are revisits or responses like others; no
    pages give no archives. Reading follows the list, so a second attempt at a
    task does no harm.
    """
    spark = pages.sparkSession
    folder = folder or fresh_folder(spark, "warc")
    target = arrow_schema(spark, ARCHIVES)

    def run(batches: Batches) -> Batches:
        stream, where, size, count = None, "", 0, 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                lot = [c.to_pylist() for c in batch.slice(begin, 100).columns]
                if stream is None:
                    stream, where = write_once(folder, attempt_name(TaskContext.get().partitionId(), ".warc.gz"))
                    info = b"software: markerloom\r\nformat: WARC file version 1.1\r\n"
                    top = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn("info", where)), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]
                    size += stream.write(first := _member(b"WARC/1.1\r\n" + _header(top) + b"\r\n" + info + b"\r\n\r\n")) or len(first)
                for page_id, url, html, digest, head in zip(*lot, strict=True):
                    member = _member(record(page_id, url, html.encode(), digest, head, date))
                    stream.write(member)
                    size += len(member)
                    count += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [where], "bytes": [size], "n_records": [count]}, schema=target)

    placed = with_heads(pages, **columns).select("page_id", "url", "html", "digest", "head")
    return stored(placed.mapInArrow(run, ARCHIVES), "archives")


@dataclass
class Source:
    """Reads on from a place of an open file in blocks, also past the range it began in."""

    stream: object
    place: int
    block: int = BLOCK
    held: bytes = b""

    def more(self) -> bool:
        self.stream.seek(self.place + len(self.held))
        got = self.stream.read(self.block)
        self.held += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.held = self.held[n:]
        self.place += n


@dataclass
class Record:
    place: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


def _looks_like_record(source: Source) -> bool:
    """Whether the member at the source's place decodes to the start of a record."""
    decoder, plain, at = zlib.decompressobj(31), b"", 0
    try:
        while len(plain) < len(VERSION) and not decoder.eof:
            if at >= len(source.held) and not source.more():
                return False
            piece = source.held[at : at + 512]
            plain += decoder.decompress(piece, 64)
            at += len(piece)
    except zlib.error:
        return False
    return plain.startswith(VERSION)


def _decode(source: Source) -> Record:
    """The record at the source's place, which must be a true one; the source then stands behind it."""
    found, decoder, parts = Record(source.place), zlib.decompressobj(31), []
    while not decoder.eof:
        if not source.held and not source.more():
            raise ValueError(f"a record at byte {found.place} is cut off")
        data, n = source.held, len(source.held)
        parts.append(decoder.decompress(data))
        source.drop(n - len(decoder.unused_data))
    top, _, rest = b"".join(parts).partition(b"\r\n\r\n")
    for line in top.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found.headers[name.lower()] = value.strip()
    found.block = rest[: int(found.headers["content-length"])]
    return found


def records_in_range(stream, begin: int, end: int, block: int = BLOCK) -> Iterator[Record]:
    """Records that begin at ``begin`` or later and before ``end``, read ``block`` bytes at a time."""
    source = Source(stream, begin, block)
    while source.place < end:
        at = source.held.find(GZIP_MAGIC)
        if at < 0:
            source.drop(max(0, len(source.held) - len(GZIP_MAGIC) + 1))
            if not source.more():
                return
            continue
        source.drop(at)
        if source.place >= end:
            return
        if _looks_like_record(source):
            yield _decode(source)
        else:
            source.drop(1)


def _page(found: Record) -> tuple | None:
    kind = found.headers.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    number = lambda name: int(found.headers[name]) if name in found.headers else None
    http, _, payload = found.block.partition(b"\r\n\r\n")
    told = base64.b32decode(found.headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != told):
        raise ValueError(f"the record at byte {found.place} does not match its digest")
    return (number("warc-page-id"), found.headers.get("warc-target-uri"), kind, size, told, number("warc-refers-to-page-id"), payload if kind == "response" else None)


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Page records of the archives, one task per byte range; ``payload`` is null for revisits.

    ``payloads=False`` checks the payloads but leaves them out.
    """
    spark = archives.sparkSession
    target = arrow_schema(spark, RECORDS)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for path, begin, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with open_file(path) as stream:
                    for found in records_in_range(stream, begin, min(begin + range_bytes, size)):
                        if (row := _page(found)) is None:
                            continue
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(found.block) if payloads else 0
                        if len(rows) >= 500 or held > 4 << 20:
                            yield _batch(rows, target)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, target)

    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))
    ranges = archives.select("path", F.explode(starts).alias("begin"), F.col("bytes").alias("size"))
    count = archives.agg(F.sum(F.ceil(F.col("bytes") / range_bytes)).alias("n")).first()["n"]
    return ranges.repartition(max(1, int(count or 0)), "path", "begin").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
