"""Legacy ARC archives to WARC: header lines by version, declared lengths, synthesised records.

`write_arc` writes pages as ARC files of version 1 or 2. `read_arc` parses ARC files by the header fields that their
version block names and by declared lengths alone, so payloads may hold any bytes; header lines are read as UTF-8, or as Latin-1 where they are none.
`to_warc` gives each record what WARC wants and ARC lacks: a record id (from the record's place in its ARC file, so
that a task that runs again makes the same and repeated rows have ids of their own), an ISO date, a type (`response`
for HTTP, `revisit` for a payload met elsewhere, `resource` for all that is no HTTP response, such as `dns:`), digests.
`write_warc` and `read_warc` write and read WARC 1.0. Files are written by Spark's own text sink, whose line separator
is just the end of a record in either format; so they go through Spark's commit protocol into any store that Spark
reaches.

Cases: a null html is an empty payload and a response; a null url becomes `unknown:`; white space in a URL is
percent-encoded, as a header line is split at blanks; a null page_id reads back as null, never is what others revisit
and may itself be a revisit. Of equal payloads of at least MIN_REVISIT bytes the largest page_id is the response (all
its rows, if it repeats), the rest are revisits, which name the first of its records. Ties and repeated rows change
nothing else. An empty table gives archives without records. Other columns, whatever their names, are ignored. Payloads of any length stay whole; a reader holds one file's bytes and one record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm.common import materialize, shared_path

MIN_REVISIT = 1000
#: The field names that ARC version blocks list.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Pages carry no date of their own.
ARC_DATE = "20240101000000"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _first_row() -> Column:
    """True for the first row of each partition, so of each file."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0


def write_arc(pages: DataFrame, path: str, version: int | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """One ARC file a partition. Without a version, odd partitions are of version 2, so that both occur."""
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    url = F.replace(F.replace(F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("unknown:")), r"[\r\n\t]", "%09"), F.lit(" "), F.lit("%20")), F.lit("\x00"), F.lit("%00"))
    url = F.when(url == "", F.lit("unknown:")).otherwise(url)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nX-Page-Id: "), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"))
    rows = pages.select(F.col(id_col), url.alias("url"), body.alias("body")).select("url", F.concat(http, "body").alias("block"), F.lit(version).cast("int").alias("v"))
    rows = rows.select("url", "block", F.coalesce("v", F.spark_partition_id() % 2 + 1).alias("v"), _first_row().alias("first"))
    length = F.octet_length("block").cast("string")
    head = F.when(F.col("v") == 1, F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit(ARC_DATE), F.lit("text/html"), length)).otherwise(
        F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit(ARC_DATE), F.lit("text/html"), F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("pages.arc"), length)
    )

    def block(v: int) -> str:
        text = f"{v} 0 prosegauge\n{ARC_FIELDS[v]}\n"
        values = {1: f"{len(text)}", 2: f"200 - - 0 pages.arc {len(text)}"}
        return f"filedesc://pages.arc 0.0.0.0 {ARC_DATE} text/plain {values[v]}\n{text}\n"

    opening = F.when(~F.col("first"), F.lit("")).when(F.col("v") == 1, F.lit(block(1))).otherwise(F.lit(block(2)))
    rows.select(F.concat(opening, head, F.lit("\n"), "block").alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def arc_records(f: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by name, block) of each record of an ARC file, the version block left out."""
    fields = ARC_FIELDS[1].split()
    while line := f.readline():
        if not line.strip():
            continue
        values = _text(line).rstrip("\r\n").split(" ")
        block = _exactly(f, int(values[-1]))
        if values[0].startswith("filedesc:"):
            fields = _text(block).split("\n")[1].split()
            continue
        if len(values) != len(fields):
            raise ValueError(f"an ARC header has {len(values)} fields; the version block names {len(fields)}")
        yield dict(zip(fields, values)), block


def _exactly(f: io.BufferedIOBase, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError(f"a record declares {n} bytes; {len(data)} are left")
    return data


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, body) of an HTTP response; anything else is all body."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, _, body = block.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in _text(head).split("\r\n")[1:])
    return {name.lower(): value.strip() for name, _, value in pairs}, body


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None


def _each_file(spark: SparkSession, path: str, rows: Callable[[str, io.BufferedIOBase], Iterator[dict]], schema: str, arrow: pa.Schema, at_once: int = 8 << 20) -> DataFrame:
    """Rows of all files in a folder. Files come through Spark's reader, so any store that it reaches will do."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held, size = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as f:
                    for row in rows(name, io.BufferedReader(f)):
                        held.append(row)
                        size += len(row.get("body") or b"") + 200
                        if size > at_once:
                            yield pa.RecordBatch.from_pylist(held, schema=arrow)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), "content").mapInArrow(work, schema)


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(record, page_id, url, date, mime, http, head, body, payload_bytes, digest) of each record: record numbers it
    by file and place, head is the HTTP head of a response, and body is null without payloads."""

    def rows(name: str, f: io.BufferedIOBase) -> Iterator[dict]:
        for n, (fields, block) in enumerate(arc_records(f)):
            headers, body = http_parts(block)
            d = fields["Archive-date"]
            yield {
                "record": hashlib.md5(f"{name}|{n}".encode()).hexdigest(),
                "page_id": _number(headers.get("x-page-id")),
                "url": fields["URL"],
                "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
                "mime": fields["Content-type"],
                "http": block.startswith(b"HTTP/"),
                "head": block[: len(block) - len(body)],
                "body": body if payloads else None,
                "payload_bytes": len(body),
                "digest": hashlib.sha1(body).hexdigest(),
            }

    text, number, data = pa.string(), pa.int64(), pa.binary()
    arrow = pa.schema([("record", text), ("page_id", number), ("url", text), ("date", text), ("mime", text), ("http", pa.bool_()), ("head", data), ("body", data), ("payload_bytes", number), ("digest", text)])
    schema = "record string, page_id bigint, url string, date string, mime string, http boolean, head binary, body binary, payload_bytes bigint, digest string"
    return _each_file(spark, path, rows, schema, arrow)


def _urn(h: Column) -> Column:
    """A record id from 32 hex digits."""
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def to_warc(records: DataFrame, repeated: DataFrame) -> DataFrame:
    """The WARC records (the bytes of one each, without its end) of ARC records. repeated: (digest, payload_bytes,
    owner, owner_record) of the payloads that occur more than once and are long enough."""
    rows = records.join(repeated, ["digest", "payload_bytes"], "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")) & F.col("http")
    rows = rows.withColumn("revisit", revisit).withColumn("block", F.when(revisit, F.col("head")).otherwise(F.concat("head", "body")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    maybe = lambda name, value: F.when(F.col("revisit"), line(name, value)).otherwise(F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).when(F.col("http"), F.lit("response")).otherwise(F.lit("resource"))),
        line("WARC-Record-ID", _urn(F.col("record"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("block")))),
        maybe("WARC-Profile", F.lit(REVISIT_PROFILE)),
        maybe("WARC-Refers-To", _urn(F.col("owner_record"))),
        maybe("X-Refers-To-Page-Id", F.col("owner").cast("string")),
        line("Content-Type", F.when(F.col("http"), F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head.cast("binary"), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """One WARC file a partition, with a warcinfo record at its head; each record ends in two line ends."""
    info = "software: prosegauge\r\nformat: WARC File Format 1.0\r\n"
    opening = f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:00000000-0000-3000-8000-000000000000>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}\r\n\r\n"
    first = records.withColumn("first", _first_row())
    # The sink writes the bytes of its strings as they are.
    first.select(F.concat(F.when(F.col("first"), F.lit(opening)).otherwise(F.lit("")).cast("binary"), "value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def warc_records(f: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of a WARC file."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError("no WARC record where one must begin")
        fields = {}
        while (line := f.readline()).strip():
            name, _, value = _text(line).partition(":")
            fields[name.lower()] = value.strip()
        yield fields, _exactly(f, int(fields["content-length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, payload_bytes, payload_digest, record_type, refers_to, url, warc_date) of each record but warcinfo.
    Digests of payloads that are there are worked out anew and must be what the header says."""

    def rows(name: str, f: io.BufferedIOBase) -> Iterator[dict]:
        for fields, block in warc_records(f):
            if fields["warc-type"] == "warcinfo":
                continue
            headers, body = http_parts(block)
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            whole = fields["warc-type"] != "revisit"
            if whole and hashlib.sha1(body).hexdigest() != digest:
                raise ValueError(f"the payload of {fields['warc-record-id']} is not what its digest says")
            yield {
                "record_id": fields["warc-record-id"],
                "page_id": _number(headers.get("x-page-id")),
                "payload_bytes": len(body) if whole else int(headers["content-length"]),
                "payload_digest": digest,
                "record_type": fields["warc-type"],
                "refers_to": _number(fields.get("x-refers-to-page-id")),
                "url": fields["warc-target-uri"],
                "warc_date": fields["warc-date"],
            }

    text, number = pa.string(), pa.int64()
    arrow = pa.schema([("record_id", text), ("page_id", number), ("payload_bytes", number), ("payload_digest", text), ("record_type", text), ("refers_to", number), ("url", text), ("warc_date", text)])
    return _each_file(spark, path, rows, "record_id string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, warc_date string", arrow)


def convert(spark: SparkSession, arc: str, warc: str, min_revisit: int = MIN_REVISIT) -> None:
    """Converts the ARC files in one folder to WARC files in another."""
    found = read_arc(spark, arc, payloads=False).where(F.col("payload_bytes") >= min_revisit)
    groups = found.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("owner"), F.max_by("record", F.struct("page_id", "record")).alias("owner_record"), F.count("*").alias("n"))
    repeated = materialize(groups.where("n > 1").drop("n"), "repeated")
    write_warc(to_warc(read_arc(spark, arc), repeated), warc)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc)


def sql() -> str:
    """DuckDB SQL for the rows of op7."""
    return f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest, html from p),
o as (select payload_digest, payload_bytes, max(page_id) as owner, count(*) as n from d where payload_bytes >= {MIN_REVISIT} group by all having n > 1)
select page_id, payload_bytes, payload_digest, case when owner is not null and page_id is distinct from owner then 'revisit' else 'response' end as record_type,
  case when owner is not null and page_id is distinct from owner then owner end as refers_to
from d left join o using (payload_digest, payload_bytes)"""
