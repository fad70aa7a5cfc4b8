"""Legacy archives to WARC: parse ARC records by their version's header line, write equivalent WARC records.

``write_arc`` writes rows as ARC files (one gzip member a record), ``read_arc``
parses any ARC file of version 1 or 2 by the field line of its first record and
each record's declared length, and ``convert`` writes the same records as WARC:
record id (a name-based UUID of file, place and payload), date from the 14
digits, type, payload and block digests. Of records of equal payloads one is a
response and the others are revisits that carry the HTTP header alone and refer
to it. ``read_warc`` parses the result.

Files go to the shared folder, one for each task, under names of their own; a
job reads only the files that its finished tasks named, so what a lost or
repeated attempt left behind is never read. Nothing holds more than a record in
memory. Which record is the response is a pre-aggregated maximum by digest and
an ordinary join.

Case handling: null html is the empty payload, a null url is written ``-`` and
comes back null; a url that a header can't hold as it is (white space, other
than ASCII, empty, ``-`` itself) is percent-encoded there and whole in a field
of the HTTP header, from which it comes back; a null page_id stays null, stands below all others and is
never named by refers_to; repeated rows are records of their own, of which one
at most is the response; an empty table gives no files and no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import prepare, stored, texts, work_dir

LEVEL, CHUNK = 1, 1 << 18
# The field lines of the two versions of ARC.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
DATE = "20240101000000"
ESCAPED = "%:/?#[]@!$&'()*+,;=-._~"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Writer:
    """A file of gzip members; opened at the first."""

    def __init__(self, uri: str):
        self.uri, self.out, self.at, self.count = uri, None, 0, 0

    def member(self, data: bytes) -> None:
        if self.out is None:
            system, path = fs.FileSystem.from_uri(self.uri)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.out = system.open_output_stream(path, compression=None)
        packer = zlib.compressobj(LEVEL, wbits=31)
        packed = packer.compress(data) + packer.flush()
        self.out.write(packed)
        self.at += len(packed)
        self.count += 1

    def close(self) -> bool:
        if self.out is not None:
            self.out.close()
        return self.out is not None


def members(uri: str) -> Iterator[tuple[int, bytes]]:
    """Place and content of each gzip member of a file."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path, compression=None) as source:
        at, rest = 0, source.read(CHUNK)
        while rest:
            unpacker, out, used = zlib.decompressobj(wbits=31), [], 0
            while not unpacker.eof:
                if not rest and not (rest := source.read(CHUNK)):
                    raise ValueError(f"{uri} ends within a record")
                out.append(unpacker.decompress(rest))
                used += len(rest) - len(unpacker.unused_data)
                rest = unpacker.unused_data
            yield at, b"".join(out)
            at += used
            rest = rest or source.read(CHUNK)


def arc_header(version: int, url: str, mime: str, length: int, date: str = DATE, name: str = "-", offset: int = 0) -> bytes:
    values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": mime, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(length)}
    return " ".join(values[f] for f in FIELDS[version].split()).encode() + b"\n"


def parse_arc(uri: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, header fields and content of each record after the version block."""
    fields: list[str] = []
    for at, data in members(uri):
        line, _, rest = data.lstrip(b"\n").partition(b"\n")
        values = line.decode("utf-8").split(" ")
        if not fields:
            head = dict(zip(FIELDS[1].split() if len(values) == 5 else FIELDS[2].split(), values))
            block = rest[: int(head["Archive-length"])].decode("utf-8").split("\n")
            version = int(block[0].split(" ")[0])
            fields = block[1].split(" ")
            if fields != FIELDS.get(version, "").split():
                raise ValueError(f"{uri}: fields {block[1]!r} aren't those of version {version}")
            continue
        if len(values) != len(fields):
            raise ValueError(f"{uri} at {at}: {len(values)} fields, {len(fields)} declared")
        head = dict(zip(fields, values))
        length = int(head["Archive-length"])
        if len(rest) < length:
            raise ValueError(f"{uri} at {at}: {len(rest)} bytes, {length} declared")
        yield at, head, rest[:length]


def _write_arc(folder: str, version: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/{uuid.uuid4().hex}.arc.gz"
        name, out = uri.rpartition("/")[2], Writer(uri)
        block = f"{version} 0 tidelog\n{FIELDS[version]}\n".encode()
        for part in parts:
            for page_id, url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part.column(2))):
                if not out.count:
                    out.member(arc_header(version, f"filedesc://{name}", "text/plain", len(block), name=name) + block + b"\n")
                payload = html or b""
                target = quote(url, safe=ESCAPED) if url else "-"
                named = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
                if url is not None and (target != url or url == "-"):
                    named += f"X-Url: {quote(url, safe='')}\r\n".encode()
                content = HTTP + named + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
                out.member(arc_header(version, target, "text/html", len(content), name=name, offset=out.at) + content + b"\n")
        if out.close():
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([out.count - 1], pa.int64())], ["uri", "records"])

    return run


def _listed(spark: SparkSession, written: DataFrame) -> DataFrame:
    """The files that finished tasks named, dealt one to a partition; their number is the tasks'."""
    names = [(r[0],) for r in written.collect()]
    return spark.createDataFrame(names, "uri string").repartition(max(1, len(names)))


def _http(content: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """HTTP header with its empty line, its fields in lower case, payload."""
    head, mark, payload = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("latin-1").split("\r\n")[1:] if ": " in line)
    return head + mark, {k.lower(): v for k, v in fields.items()}, payload


def _index(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["uri", "at", "page_id", "payload_bytes", "digest"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for part in parts:
        for uri in part.column(0).to_pylist():
            rows = []
            for at, _, content in parse_arc(uri):
                _, fields, payload = _http(content)
                page = fields.get("x-page-id")
                rows.append((uri, at, page if page is None else int(page), len(payload), sha1(payload)))
                if len(rows) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def record_id(uri: str, at: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri}#{at}')}>"


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"WARC-Block-Digest: sha1:{sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _convert(folder: str):
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (uri, at, keep_uri, keep_at) come sorted by file and place."""
        out, uri, records = Writer(f"{folder}/{uuid.uuid4().hex}.warc.gz"), None, iter(())
        for part in parts:
            for file, at, keep_uri, keep_at in zip(*(c.to_pylist() for c in part.columns)):
                if file != uri:
                    uri, records = file, parse_arc(file)
                place, head, content = next(records)
                while place < at:
                    place, head, content = next(records)
                if not out.count:
                    out.member(warc_record("warcinfo", {"WARC-Record-ID": record_id(out.uri, 0), "WARC-Date": _date(DATE), "Content-Type": "application/warc-fields"}, b"software: tidelog\r\nformat: WARC file version 1.1\r\n"))
                http, _, payload = _http(content)
                fields = {"WARC-Record-ID": record_id(file, at), "WARC-Date": _date(head["Archive-date"]), "WARC-Target-URI": head["URL"], "WARC-IP-Address": head["IP-address"], "WARC-Payload-Digest": f"sha1:{sha1(payload)}", "Content-Type": "application/http; msgtype=response"}
                if keep_uri is None or (keep_uri, keep_at) == (file, at):
                    out.member(warc_record("response", fields, content))
                else:
                    out.member(warc_record("revisit", fields | {"WARC-Refers-To": record_id(keep_uri, keep_at), "WARC-Profile": profile}, http))
        if out.close():
            yield pa.RecordBatch.from_arrays([pa.array([out.uri]), pa.array([out.count - 1], pa.int64())], ["uri", "records"])

    return run


def _date(digits: str) -> str:
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def parse_warc(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; digests are checked."""
    for at, data in members(uri):
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        if fields["WARC-Block-Digest"] != f"sha1:{sha1(block)}":
            raise ValueError(f"{uri} at {at}: the block's digest differs")
        yield fields, block


_READ = {"record_id": "string", "page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to_id": "string", "warc_date": "string"}


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64() if k == "long" else pa.string() for k in _READ.values()]
    for part in parts:
        for uri in part.column(0).to_pylist():
            rows = []
            for fields, block in parse_warc(uri):
                if fields["WARC-Type"] == "warcinfo":
                    continue
                _, http, _ = _http(block)
                page, target = http.get("x-page-id"), fields["WARC-Target-URI"]
                url = unquote(http["x-url"]) if "x-url" in http else None if target == "-" else target
                rows.append((fields["WARC-Record-ID"], page if page is None else int(page), url, int(http["content-length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], fields.get("WARC-Refers-To"), fields["WARC-Date"]))
                if len(rows) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(_READ))
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(_READ))


def write_arc(pages: DataFrame, folder: str, version: int = 1) -> DataFrame:
    """ARC files of the pages; returns their uris, one to a partition."""
    prepare(pages.sparkSession)
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return _listed(pages.sparkSession, narrow.mapInArrow(_write_arc(folder, version), "uri string, records long"))


def convert(arcs: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """WARC files of the records of ARC files; payloads of ``least`` bytes or more are written once. Returns their uris."""
    spark = prepare(arcs.sparkSession)
    index = stored(arcs.mapInArrow(_index, "uri string, at long, page_id long, payload_bytes long, digest string"), "arc-index")
    place = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("page"), "uri", "at")
    keep = index.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max(place).alias("k")).select("digest", "payload_bytes", F.col("k.uri").alias("keep_uri"), F.col("k.at").alias("keep_at"))
    told = index.join(keep, ["digest", "payload_bytes"], "left").select("uri", "at", "keep_uri", "keep_at")
    files = max(1, arcs.count())  # a number of its own, or the few bytes of the index would be coalesced to one task
    dealt = told.repartition(files, "uri").sortWithinPartitions("uri", "at")
    return _listed(spark, dealt.mapInArrow(_convert(folder), "uri string, records long"))


def read_warc(warcs: DataFrame) -> DataFrame:
    """The records of WARC files, without their information records."""
    return warcs.mapInArrow(_read, ", ".join(f"{k} {v}" for k, v in _READ.items()))


def archive(pages: DataFrame, version: int = 1, least: int = 0) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id, warc_date."""
    folder = work_dir(pages.sparkSession, "archive")
    records = stored(read_warc(convert(write_arc(pages, f"{folder}/arc", version), f"{folder}/warc", least)), "records")
    kept = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return records.join(kept, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "warc_date")


def contract(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, r) AS place, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, r) AS kept FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN kept END AS refers_to
FROM k
"""
