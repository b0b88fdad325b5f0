"""Legacy web archives: ARC to WARC.

An ARC file starts with a version block; the version it names (1 or 2) decides the fields of all header
lines after it, of which the last declares how many bytes of content follow. arc_to_warc() reads headers and
declared lengths only, never searches content, and synthesises for each record a WARC identifier, timestamp,
type and digests. Records go out as gzipped WARC files of bounded record count through Spark's own writer, so
any store that Spark knows will do, and are read back from their declared lengths.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm.common import cut, shared_dir, table

#: Fixed values of the formats: header fields of ARC by version, WARC version line, revisit profile.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
WARC_VERSION = "WARC/1.0"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Records of a WARC file; pages of an ARC blob; least payload bytes of a revisit.
FILE_RECORDS, ARC_PAGES, MIN_REVISIT = 500, 256, 0
#: Header of the archived response that holds the page's key, and of WARC records what has no standard field.
KEY, BYTES, REFERS = b"X-Page-Key", "X-Payload-Length", "X-Refers-To-Key"
SEP = b"\r\n"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_header(version: int, *values) -> bytes:
    clean = ["%20".join(str(v).split()) or "-" for v in values]
    return " ".join(clean).encode("utf-8", "replace") + b"\n"


def write_arc(pages: list, version: int, date: str = "20010203040506") -> bytes:
    """An ARC file of (key, url, payload) in the given version; keys go into a header of the response."""
    names = " ".join(ARC_FIELDS[version]).encode()
    block = b"%d 0 spanmill\n%s\n" % (version, names)
    name = "filedesc://pages.arc"
    out = [arc_header(version, *([name, "0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", "pages.arc"] if version == 2 else [])), len(block)), block, b"\n"]
    at = sum(map(len, out))
    for key, url, payload in pages:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (KEY + b": " + key.encode() + SEP if key is not None else b"") + SEP
        body = head + payload
        extra = ["200", hashlib.md5(body).hexdigest(), "-", at, "pages.arc"] if version == 2 else []
        record = arc_header(version, url or "-", "0.0.0.0", date, "text/html", *extra, len(body)) + body + b"\n"
        at += len(record)
        out.append(record)
    return b"".join(out)


def members(data: bytes) -> bytes:
    """An ARC or WARC file as it is, or what its gzip members hold; a member that is cut short gives what can be read of it."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            out.append(z.decompress(data) + z.flush())
        except zlib.error:
            break
        data = z.unused_data.lstrip(b"\0")
    return b"".join(out)


def read_arc(data: bytes, bad: Callable[[int, str], None] | None = None) -> Iterator[tuple[dict, bytes, int]]:
    """(header fields, content, place) of the records after the version block.

    Where a header or length is wrong: ValueError; or, with bad, bad(place, what) is called, and reading goes on at the next line that is a
    header of this version whose declared length fits. Only then is content looked at.
    """
    data, at, fields = members(data), 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)]
        if end >= 0 and not line.strip():
            at = end + 1
            continue
        try:
            values, size = _header(line, fields, at)
            content = data[end + 1 : end + 1 + size] if end >= 0 else b""
            if len(content) != size:
                raise ValueError(f"record at {at} declares {size} bytes, {len(content)} are left")
            if fields is None:
                version = content.split(b" ", 1)[0]
                if version not in (b"1", b"2"):
                    raise ValueError(f"version block names no known version: {version[:20]!r}")
                fields = ARC_FIELDS[int(version)]
            else:
                yield dict(zip(fields, values, strict=True)), content, at
        except ValueError as e:
            if bad is None:
                raise
            bad(at, str(e))
            at = _next_header(data, max(end, at) + 1, fields)
            continue
        at = end + 1 + size


def _header(line: bytes, fields: list | None, at: int) -> tuple[list, int]:
    values = line.rstrip(b"\r").decode("utf-8", "replace").split(" ")
    if not re.fullmatch("[0-9]+", values[-1]):
        raise ValueError(f"header at {at} declares no length")
    if fields is not None and len(values) != len(fields):
        raise ValueError(f"header at {at} has {len(values)} fields, not {len(fields)}")
    return values, int(values[-1])


def _next_header(data: bytes, at: int, fields: list | None) -> int:
    """The next line that could be a record's header."""
    if fields is None:
        return len(data)
    form = re.compile(rb"^[A-Za-z][A-Za-z0-9+.-]*:[^ \n]*(?: [^ \n]+){%d} ([0-9]+)\r?$" % (len(fields) - 2), re.M)
    for m in form.finditer(data, at):
        if m.end() + 1 + int(m[1]) <= len(data):
            return m.start()
    return len(data)


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """Head, with its blank line, and payload of an HTTP message; what has no head is all payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    head, found, rest = content.partition(SEP + SEP)
    return (head + SEP + SEP, rest) if found else (content, b"")


def key_of(head: bytes) -> str | None:
    for line in head.split(SEP):
        name, _, value = line.partition(b": ")
        if name == KEY:
            return value.decode()
    return None


def iso(date14: str) -> str:
    d = (date14 + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(uri: str, date: str, key: str | None, place: str = "") -> str:
    """An identifier by uri, date and key; without a key by the record's place and digest."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {date} {key}' + (f' {place}' if key is None else ''))}>"


def arc_to_warc(data: bytes, bad: Callable[[int, str], None] | None = None) -> Iterator[dict]:
    """What a WARC record of each ARC record needs: id, uri, date, key, head, payload and both digests' inputs."""
    for header, content, at in read_arc(data, bad):
        head, payload = http_parts(content)
        key, date = key_of(head), iso(header["Archive-date"])
        yield {"key": key, "record_id": record_id(header["URL"], date, key, f"{at} {digest(content)}"), "uri": header["URL"], "date": date, "ip": header["IP-address"], "head": head, "payload": payload, "digest": digest(payload), "bytes": len(payload)}


def warc_record(r: dict, refers: dict | None = None) -> bytes:
    """A response record, or with refers (key, record_id) of the record that holds the payload, a revisit.
    Without the two line ends that close a record."""
    block = r["head"] if refers else r["head"] + r["payload"]
    fields = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", r["record_id"]),
        ("WARC-Date", r["date"]),
        ("WARC-Target-URI", r["uri"]),
        ("WARC-IP-Address", r["ip"]),
        ("WARC-Payload-Digest", "sha1:" + r["digest"]),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
        (BYTES, str(r["bytes"])),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers["record_id"])]
        if refers["key"] is not None:
            fields.append((REFERS, refers["key"]))
    fields.append(("Content-Length", str(len(block))))
    head = "\r\n".join([WARC_VERSION, *[f"{k}: {v}" for k, v in fields]])
    return head.encode("utf-8", "replace") + SEP + SEP + block


def read_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(fields, block) of the records of a WARC file, plain or gzipped, by their declared lengths."""
    data, at = members(data), 0
    while at < len(data):
        if data[at : at + 2] == SEP:
            at += 2
            continue
        end = data.index(SEP + SEP, at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"record at {at} declares {size} bytes, {len(block)} are left")
        yield fields, block
        at = end + 4 + size


CONVERTED = "key string, record_id string, uri string, date string, ip string, head binary, payload binary, digest string, bytes long, error string"
_ARROW = pa.schema([(n, {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[k]) for n, k in (x.split() for x in CONVERTED.split(", "))])


def to_arc(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """arc (binary): ARC files of up to ARC_PAGES pages each, of both versions in turn. Null html is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in batches:
            for at in range(0, b.num_rows, ARC_PAGES):
                part = b.slice(at, ARC_PAGES)
                rows = [(k, u, h or b"") for k, u, h in zip(*[c.to_pylist() for c in part.columns], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([write_arc(rows, 1 + turn % 2)], pa.binary())], names=["arc"])
                turn += 1

    return pages.select(F.col(key).cast("string"), F.col(url).cast("string"), F.col(html).cast("binary")).mapInArrow(run, "arc binary")


def convert(arcs: DataFrame, arc: str = "arc") -> DataFrame:
    """One row for each record of the ARC files in column arc, plain or gzipped; see arc_to_warc(). What cannot be read has a row with
    nothing but its error; a null file has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                if data.is_valid:
                    errors: list[str] = []
                    rows = list(arc_to_warc(data.as_py(), lambda at, what: errors.append(what)))  # noqa: B023
                    yield pa.RecordBatch.from_pylist([*[r | {"error": None} for r in rows], *[{"error": e} for e in errors]], schema=_ARROW)

    return arcs.select(arc).mapInArrow(run, CONVERTED)


def with_revisits(records: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """records with refers (key, record_id): of equal payloads of at least `least` bytes the smallest key - as a
    number, where keys are numbers - holds the payload, the others refer to it. Null keys come last; records without a key are told apart by
    their identifiers. Rows with an error are left out."""
    records = records.filter("error is null")
    order = F.struct(F.col("key").isNull().alias("a"), F.expr("try_cast(key as decimal(38,0))").alias("b"), "key", "record_id")
    # keys that are equal name one page: its records are all responses
    first = records.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min(order).alias("m"), F.count("*").alias("n")).filter("n > 1")
    first = cut(first.select(F.col("digest").alias("d"), F.struct(F.col("m.key").alias("key"), F.col("m.record_id").alias("record_id")).alias("refers")), "payloads")
    met = records.join(first, F.col("digest") == F.col("d"), "left")
    return met.withColumn("refers", F.when(~F.coalesce(F.col("refers.key"), F.col("refers.record_id")).eqNullSafe(F.coalesce("key", "record_id")), F.col("refers"))).drop("d")


def write(records: DataFrame, path: str) -> None:
    """WARC files, gzipped, of at most FILE_RECORDS records each."""
    out = pa.schema([("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = b.slice(at, 500).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([warc_record(r, r["refers"]) for r in rows], pa.binary())], schema=out)

    cols = [*[x.split()[0] for x in CONVERTED.split(", ") if x != "error string"], "refers"]
    lines = records.select(*cols).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the WARC files in path: fields of the contract, read from the archives."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "uri", "date"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = []
                for f, block in read_warc(data.as_py()):
                    head, payload = http_parts(block)
                    kind, told = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (digest(payload) != told or len(payload) != int(f[BYTES])) or digest(block) != f["WARC-Block-Digest"].removeprefix("sha1:"):
                        raise ValueError(f"digests of {f['WARC-Record-ID']} do not hold")
                    rows.append((key_of(head), int(f[BYTES]), told, kind, f.get(REFERS), f["WARC-Record-ID"], f["WARC-Target-URI"], f["WARC-Date"]))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(cols)], names=names)

    schema = ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'string'}" for n in names)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """pages to ARC, to WARC with revisits, written, and read back: page_id, payload_bytes, payload_digest,
    record_type, refers_to. Repeated page ids are all responses if theirs is the smallest; an empty table gives none."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    records = cut(convert(to_arc(pages)), "records")
    path = shared_dir(spark) + "/warc"
    write(with_revisits(records), path)
    out = read(spark, path)
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
v AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, x, array_to_string(flatten(list_transform(range(0, 8), lambda g:
  list_transform(range(0, 4), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, (g * 5 + 1)::INT, 5))::INT >> (15 - 5 * k)::INT) & 31))::INT, 1)))), '') AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM v)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM m
"""
