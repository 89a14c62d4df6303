"""Legacy web archives (ARC, versions 1 and 2) and their conversion to WARC 1.1 records.

``write_arcs`` puts pages into ARC archives: a version block, then for each page a header line with the version's
fields, the declared length and that many bytes (an HTTP response). ``convert`` reads an archive by its version's
fields and declared lengths and synthesises the WARC equivalent of each record: identifier, timestamp, type, target,
digests. Of records whose payloads are equal, the one with the smallest page identifier becomes a ``response``, the
others become ``revisit`` records without a payload that refer to it. ``read_warcs`` parses WARC bytes again.

Archives are rows of a table in the shared folder (``name``, ``data``), each of about ``ARCHIVE_BYTES``; a record is
never split. An archive's name has its partition, its number in it and a digest of its bytes, so that no two archives
of a table share one; ``to_warcs`` refuses a table in which names repeat. Only digests are shuffled to find equal payloads; what refers to what goes back to its archive by
broadcast while there are at most ``BROADCAST_REFS`` of them, by a join beyond.

Defined results: a null page text counts as empty; a null address becomes ``urn:page:<identifier>``; blanks and
control characters in addresses are percent-encoded; repeated rows with the smallest identifier are all responses;
records with a null identifier are responses unless an identified record has the same payload; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import in_batches, stored

ARCHIVE_BYTES = 1 << 20
BROADCAST_REFS = 200_000
#: The header fields of ARC records by version, as the version block names them.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
#: The upper half of a record's UUID (version 8, its own layout): with a page identifier, or with a hash instead.
_PAGE, _OTHER = 0x6C61726B7370_8001, 0x6C61726B7370_8002


class ArchiveError(ValueError):
    """The bytes are not an archive that this module reads."""


@dataclass
class Record:
    fields: dict[str, str]
    offset: int
    content: bytes

    def payload_at(self) -> int:
        """Where the HTTP headers end."""
        at = self.content.find(b"\r\n\r\n")
        return at + 4 if self.content.startswith(b"HTTP/") and at >= 0 else 0


def record_id(key: int | None, name: str = "", offset: int = 0) -> str:
    """A WARC record identifier: made from the page identifier if there is one, else from the record's place."""
    if key is not None:
        low, high = key & (1 << 64) - 1, _PAGE
    else:
        low, high = int.from_bytes(hashlib.sha1(f"{name}:{offset}".encode()).digest()[:8], "big"), _OTHER
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def page_of(identifier: str) -> int | None:
    value = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 64 != _PAGE:
        return None
    low = value & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_archive(name: str, version: int, pages: list[tuple[int | None, str | None, bytes]]) -> bytes:
    """An ARC file of the given version with one record for each (identifier, address, payload)."""
    if version not in ARC_FIELDS:
        raise ArchiveError(f"unknown version {version}")
    lines = f"{version} 0 larkspur\n{' '.join(ARC_FIELDS[version])}\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 20000101000000 text/plain {'' if version == 1 else '200 - - 0 ' + name + ' '}{len(lines) + 1}\n".encode(), lines, b"\n"]
    size = sum(map(len, out))
    for key, url, payload in pages:
        address = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url if url else f"urn:page:{key}")
        content = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        known = {"URL": address, "IP-address": "0.0.0.0", "Archive-date": "20000101000000", "Content-type": "text/html", "Result-code": "200",
                 "Checksum": hashlib.md5(content).hexdigest(), "Location": "-", "Offset": str(size), "Filename": name, "Archive-length": str(len(content))}
        head = (" ".join(known[f] for f in ARC_FIELDS[version]) + "\n").encode()
        out += [head, content, b"\n"]
        size += len(head) + len(content) + 1
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[Record]:
    """The records of an ARC file, the version block left out. The version block's own second line tells the
    version; header lines are read from the right, since only an address may hold what looks like a separator."""
    end = data.find(b"\n")
    if not data.startswith(b"filedesc://") or end < 0:
        raise ArchiveError("no version block")
    at = end + 1
    length = int(data[:end].rsplit(b" ", 1)[1])
    block = data[at : at + length].split(b"\n")
    version = int(block[0].split(b" ")[0])
    names = block[1].decode().split(" ")
    if version not in ARC_FIELDS or tuple(names) != ARC_FIELDS[version]:
        raise ArchiveError(f"unknown version or fields: {block[0]!r}")
    at += length
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        values = data[at:end].decode().rsplit(" ", len(names) - 1)
        if end < 0 or len(values) != len(names):
            raise ArchiveError(f"a header line is cut off at {at}")
        fields = dict(zip(names, values, strict=True))
        size = int(fields["Archive-length"])
        if end + 1 + size > len(data):
            raise ArchiveError(f"a record is cut off at {at}")
        yield Record(fields, at, data[end + 1 : end + 1 + size])
        at = end + 1 + size


def warc_record(headers: list[tuple[str, str]], content: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(content)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + content + b"\r\n\r\n"


def convert(name: str, data: bytes, keys: list[int | None], refers: dict[int, int]) -> bytes:
    """The WARC equivalent of an ARC file. ``keys`` has its records' page identifiers in order; ``refers`` leads
    from the place of a record that repeats a payload to the page identifier of the record that it repeats."""
    description = f"software: larkspur\r\nformat: WARC File Format 1.1\r\nconverted-from: {name}\r\n".encode()
    out = [warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name, 0)), ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], description)]
    for k, (key, record) in enumerate(zip(keys, read_arc(data), strict=True)):
        f, at = record.fields, record.payload_at()
        d = f["Archive-date"]
        headers = [
            ("WARC-Type", "revisit" if k in refers else "response"),
            ("WARC-Record-ID", record_id(key, name, record.offset)),
            ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
            ("WARC-Target-URI", f["URL"]),
            ("WARC-IP-Address", f["IP-address"]),
            ("WARC-Payload-Digest", f"sha1:{digest(record.content[at:])}"),
            ("Content-Type", "application/http;msgtype=response" if at else f["Content-type"]),
        ]
        content = record.content
        if k in refers:
            headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers[k]))]
            content = content[:at]
        out.append(warc_record([*headers, ("WARC-Block-Digest", f"sha1:{digest(content)}")], content))
    return b"".join(out)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and content of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise ArchiveError(f"no WARC record at {at}")
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        content = data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ArchiveError(f"a record's length is wrong at {at}")
        yield headers, content
        at = end + 8 + size


def write_arcs(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``name, keys, data``: the pages as ARC archives, of version 1 and 2 by turns."""

    def make():
        made, part = [0], TaskContext.get().partitionId()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = batch.column(0).to_pylist()
            raw = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
            made[0] += 1
            mark = hashlib.sha1(b"".join(hashlib.sha1(f"{k}:{len(x)}:".encode() + x).digest() for k, x in zip(keys, raw, strict=True))).hexdigest()[:16]
            name = f"{part:06d}-{made[0]:06d}-{mark}.arc"
            data = arc_archive(name, 1 + made[0] % 2, list(zip(keys, batch.column(1).to_pylist(), raw, strict=True)))
            return pa.record_batch([pa.array([name]), pa.array([keys], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["name", "keys", "data"])

        return work

    rows = pages.select(F.col(key).cast("bigint"), F.col(url), F.col(payload))
    return rows.mapInArrow(in_batches(make, ARCHIVE_BYTES), "name string, keys array<bigint>, data binary")


def payload_index(arcs: DataFrame) -> DataFrame:
    """``name, place, key, digest, n`` of every record."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for name, keys, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for place, (key, record) in enumerate(zip(keys, read_arc(data), strict=True)):
                    body = record.content[record.payload_at() :]
                    rows.append((name, place, key, hashlib.sha1(body).digest(), len(body)))
            types = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["name", "place", "key", "digest", "n"])

        return work

    return arcs.select("name", "keys", "data").mapInArrow(in_batches(make), "name string, place int, key bigint, digest binary, n bigint")


def to_warcs(arcs: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``name, data``: each archive converted, with payloads of ``least_bytes`` or more that repeat as revisits."""
    if not arcs.groupBy("name").count().where("count > 1").isEmpty():
        raise ArchiveError("two archives have one name")
    index = stored(payload_index(arcs), "payloads")
    again = index.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("times"))
    again = stored(again.where("times > 1 and first is not null").select("digest", "first"), "repeated")
    refers = index.where(F.col("n") >= least_bytes).join(again, "digest").where(~F.col("key").eqNullSafe(F.col("first")))
    refers = stored(refers.select("name", "place", "first"), "refers")
    few = refers.count() <= BROADCAST_REFS
    lists = refers.groupBy(F.col("name").alias("_name")).agg(F.collect_list("place").alias("places"), F.collect_list("first").alias("firsts"))
    joined = arcs.join(F.broadcast(lists) if few else lists, F.col("name") == F.col("_name"), "left").drop("_name")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, made = [], []
            for name, keys, data, places, firsts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names.append(name.removesuffix(".arc") + ".warc")
                made.append(convert(name, data, keys, dict(zip(places or [], firsts or [], strict=True))))
            return pa.record_batch([pa.array(names, pa.string()), pa.array(made, pa.binary())], ["name", "data"])

        return work

    return joined.select("name", "keys", "data", "places", "firsts").mapInArrow(in_batches(make), "name string, data binary")


def read_warcs(warcs: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the page records in WARC bytes. A
    response's length and digest are taken from its bytes, a revisit's from the headers that it keeps."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for data in batch.column(0).to_pylist():
                for headers, content in read_warc(data):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    at = content.find(b"\r\n\r\n") + 4
                    if kind == "response":
                        size, code = len(content) - at, digest(content[at:])
                        if headers["WARC-Payload-Digest"] != f"sha1:{code}":
                            raise ArchiveError("a payload does not have its digest")
                    else:
                        size = int(re.search(rb"Content-Length: (\d+)", content)[1])
                        code = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    to = page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((page_of(headers["WARC-Record-ID"]), size, code, kind, to))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        return work

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return warcs.select("data").mapInArrow(in_batches(make), schema)
