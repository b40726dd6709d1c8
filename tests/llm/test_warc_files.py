"""Reading WARC files as they come: charsets, codings, broken records, members; record ids that stay."""

import gzip
import zlib

from tidewater.llm import warc

PAGES = "page_id bigint, url string, html string, extra string"


def record(body, kind="response", length=True, rid="<urn:1>"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\nWARC-Target-URI: http://x/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n"
    return (head + (f"Content-Length: {len(body)}\r\n" if length else "") + "\r\n").encode() + body + b"\r\n\r\n"


def http(body, *lines):
    return "\r\n".join(["HTTP/1.1 200 OK", *lines, "", ""]).encode() + body


def payloads(spark, folder, **files):
    folder.mkdir()
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return {r.record_id: r.payload for r in warc.read_responses(spark, str(folder)).collect()}


def test_charsets_and_codings(spark, tmp_path):
    text = "<p>café €</p>"
    chunked = b"".join(b"%x;q=1\r\n" % len(p) + p + b"\r\n" for p in (text.encode()[:9], text.encode()[9:])) + b"0\r\n\r\n"
    data = b"".join([
        record(http("café".encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1"), rid="latin"),
        record(http("<meta charset=windows-1252>€".encode("cp1252")), rid="meta"),
        record(http("café".encode("latin-1")), rid="wrong"),
        record(http("café".encode(), "Content-Type: text/html; charset=nonsense"), rid="unknown"),
        record(http(chunked, "Transfer-Encoding: chunked"), rid="chunked"),
        record(http(gzip.compress(text.encode()), "Content-Encoding: gzip"), rid="gzip"),
        record(http(zlib.compress(text.encode()), "Content-Encoding: deflate"), rid="deflate"),
        record(http(b"not gzip", "Content-Encoding: gzip"), rid="plain"),
        record(b"no http head", rid="bare"), record(b"", rid="empty"),
    ])
    got = payloads(spark, tmp_path / "in", a=data)
    assert got == {
        "latin": "café", "meta": "<meta charset=windows-1252>€", "wrong": "caf�", "unknown": "café", "chunked": text, "gzip": text,
        "deflate": text, "plain": "not gzip", "bare": "no http head", "empty": "",
    }


def test_broken_records_are_reported_and_skipped(spark, tmp_path):
    good = record(http(b"one"), rid="1")
    lost = record(http(b"lost"), length=False, rid="2")
    more = record(http(b"two"), rid="3")
    cut = record(http(b"cut off here"), rid="4")[:-12]
    assert payloads(spark, tmp_path / "a", f=good + lost + more + cut) == {"1": "one", "3": "two"}
    errors = sorted((dict((h.name, h.value) for h in r.headers)["WARC-Record-ID"], r.error) for r in warc.read(spark, str(tmp_path / "a")).filter("error IS NOT NULL").collect())
    assert errors == [("2", "no length"), ("4", "truncated")]
    assert payloads(spark, tmp_path / "b", f=good + b"WARC/1.0\r\nWARC-Type: resp", g=b"", h=b"no warc at all") == {"1": "one"}


def test_gzip_members(spark, tmp_path):
    long = b"x" * 3_000_000
    parts = [record(http(b"one"), rid="1"), record(http(long), rid="2"), record(http(b"three"), rid="3")]
    whole = b"".join(gzip.compress(p) for p in parts)
    got = payloads(spark, tmp_path / "a", **{"a.warc.gz": whole})
    assert got == {"1": "one", "2": long.decode(), "3": "three"}
    assert payloads(spark, tmp_path / "b", **{"b.gz": gzip.compress(b"".join(parts))}) == got
    assert payloads(spark, tmp_path / "c", **{"c.gz": whole[:-20]}).keys() >= {"1", "2"}
    assert payloads(spark, tmp_path / "d", **{"d.gz": gzip.compress(parts[0]) + b"\x1f\x8bbroken"}) == {"1": "one"}


def test_record_ids_do_not_depend_on_partitions(spark, tmp_path):
    rows = [(i % 7 or None, f"http://{i % 5}/", f"<p>{i % 11}</p>" if i % 3 else None, "e") for i in range(200)]
    pages = spark.createDataFrame(rows, PAGES)
    ids = lambda df: sorted(r.record_id for r in warc.responses(df).collect())
    first = ids(pages.repartition(2))
    assert first == ids(pages.repartition(7, "url")) and len(set(first)) == 200
    pages.repartition(3).write.parquet(str(tmp_path / "pages"))
    stored = spark.read.parquet(str(tmp_path / "pages"))
    one = ids(stored)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert ids(spark.read.parquet(str(tmp_path / "pages"))) == one and len(set(one)) == 200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "Exchange" not in warc.responses(stored)._jdf.queryExecution().executedPlan().toString()
