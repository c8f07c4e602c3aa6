"""ARC to WARC: any bytes, records that are no HTTP, ids of repeated rows, odd tables."""

import gzip
import hashlib
import random

from prosegauge.llm import warc
from prosegauge.llm.common import shared_path


def arc_file(tmp_path, records):
    block = f"1 0 x\n{warc.ARC_FIELDS[1]}\n"
    out = f"filedesc://x.arc 0.0.0.0 20200101000000 text/plain {len(block)}\n{block}\n".encode()
    for url, mime, data in records:
        out += f"{url} 1.2.3.4 20200102030405 {mime} {len(data)}\n".encode("latin-1") + data + b"\n"
    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / "a.arc.gz").write_bytes(gzip.compress(out))
    return f"file://{folder}"


def test_any_bytes_and_other_protocols(spark, tmp_path):
    rng = random.Random(2)
    noise = bytes(rng.randrange(256) for _ in range(5000))
    http = "HTTP/1.1 200 OK\r\nX-Títle: caf\xe9\r\n\r\n".encode("latin-1")
    records = [("http://a", "image/png", http + noise), ("dns:a.example", "text/dns", b"20200102030405\na. 5 IN A 1.2.3.4"), ("http://b/\xe9", "text/html", http + b"\r\n\r\nWARC/1.0\r\n\xff"), ("ftp://c", "text/plain", b"")]
    arc, out = arc_file(tmp_path, records), shared_path(spark, "warc")
    warc.convert(spark, arc, out)
    got = {r.url: r for r in warc.read_warc(spark, out).collect()}
    bodies = {url: data[len(http) :] if data.startswith(b"HTTP/") else data for url, _, data in records}
    assert {u: (r.payload_bytes, r.payload_digest) for u, r in got.items()} == {u: (len(b), hashlib.sha1(b).hexdigest()) for u, b in bodies.items()}
    assert {u: r.record_type for u, r in got.items()} == {"http://a": "response", "dns:a.example": "resource", "http://b/\xe9": "response", "ftp://c": "resource"}
    assert {r.warc_date for r in got.values()} == {"2020-01-02T03:04:05Z"}


def test_repeated_rows_long_payloads_and_other_columns(spark):
    long = "é" * 3_000_000
    rows = [(1, "http://a", long), (1, "http://a", long), (2, "http://a", long), (2, "http://a", long), (None, None, None), (None, "", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as digest", "1 as owner", "true as first")
    got = warc.round_trip(spark, pages).collect()
    assert len({r.record_id for r in got}) == len(rows)
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == sorted(
        [(1, 6_000_000, "revisit", 2)] * 2 + [(2, 6_000_000, "response", None)] * 2 + [(None, 0, "response", None), (None, 1, "response", None)], key=str
    )
