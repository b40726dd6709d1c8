"""Operator 2: WARC derivatives. Responses become linked metadata and plain-text conversion records.

Every response gives a ``metadata`` record (status, title, language, character set, HTTP header lines, outlinks) and a
``conversion`` record (the page's text). Both carry WARC-Refers-To with the response's record id, its target URI and
date, and all its other WARC header fields, digests included, under their own names or, where the new record has a
field of that name itself, as WARC-Source-<name>. Block digests are SHA-256. Record ids are UUIDs made from the
response's id and the kind, so a rerun gives the same ids, in whatever partitions.

``read`` takes responses from WARC files; ``responses`` makes them from a table of pages, whose rows are told apart by
their place in their file (a table that does not come from files is numbered among equal rows, by a shuffle). The rest
is row by row: no shuffle, nothing held beyond one batch of pages (``read``: one file, as stored, in a task). Character references are resolved by HTML's rules in text, title and outlinks; in links, as in any attribute,
a name without its semicolon counts only where no letter, digit or = follows, so that parameters of a query stay.

Defined cases: a null or empty page gives an empty payload, a metadata record without title or links, and an
empty conversion record; a record of a file without a length, or cut off, is reported by ``read`` and not a response; bytes
outside a page's charset become U+FFFD; a null url is left out of the headers; repeated rows give records of their own; very long
pages are read whole; extra columns are ignored.
"""

from __future__ import annotations

import html as markup
import re
import zlib
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import small_batches

DATE = "1970-01-01T00:00:00Z"
HIDDEN = "script|style|nav|noscript|template|title"
BLOCK = "address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|ol|p|pre|section|table|td|th|tr|ul"
#: A character reference in an attribute.
REFERENCE = re.compile("&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9])))")
#: A link's value, with its quotes where it has them.
HREF = r"""(?i)<a\s(?:[^>]*?[\s"'/])?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""


def record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-"), cut(13, 4), F.lit("-"), cut(17, 4), F.lit("-"), cut(21, 12), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


@F.pandas_udf(StringType())
def resolved(text: pd.Series) -> pd.Series:
    """text with its character references resolved; a no-break space becomes a space."""
    return text.map(lambda t: markup.unescape(t).replace("\xa0", " ") if "&" in t else t, na_action="ignore")


def link_target(value: str) -> str:
    """The target that a raw value of href, quoted or bare, stands for."""
    known = lambda m: markup.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]
    bare = value[1:-1] if value[0] in "\"'" else value
    return re.sub(r"[\t\r\n]", "", REFERENCE.sub(known, bare))


@F.pandas_udf(ArrayType(StringType()))
def link_targets(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [link_target(x) for x in v], na_action="ignore")


def plain_text(html: Column) -> Column:
    """Text of a page: hidden elements and comments go, blocks end lines, blank lines go."""
    t = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, rf"(?is)<({HIDDEN})\b[^>]*>.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?is)<head\b[^>]*>.*?</head\s*>", "")
    t = F.regexp_replace(t, r"\s+", " ")
    t = F.regexp_replace(t, rf"(?i)</?({BLOCK})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    t = resolved(t)
    t = F.regexp_replace(t, r"[ \t ]*\n[ \t\n ]*", "\n")
    return F.trim(F.regexp_replace(t, r"^\n|\n$", ""))


#: Fields of a response that its derivatives have of their own.
OWN = ("warc-type", "warc-record-id", "warc-refers-to", "warc-block-digest", "warc-payload-digest", "content-type", "content-length")


def placed(pages: DataFrame) -> DataFrame:
    """page_id, target_uri, payload of pages, and place, which tells rows with the same page_id and url apart.

    The place is the row's own in its file where pages are read from files, whatever partitions they are read in; elsewhere
    a hash of the payload and a number among equal rows.
    """
    cols = [F.col("page_id"), F.col("url").alias("target_uri"), F.coalesce("html", F.lit("")).alias("payload")]
    try:
        return pages.select(*cols, F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string")).alias("place"))
    except AnalysisException:
        same = pages.select(*cols).withColumn("__h", F.sha2("payload", 256))
        n = F.row_number().over(Window.partitionBy("page_id", "target_uri", "__h").orderBy(F.lit(0)))
        return same.withColumn("place", F.concat_ws(":", "__h", n.cast("string"))).drop("__h")


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """One response record for each row of pages (page_id, url, html): page_id, record_id, target_uri, date, headers
    (other WARC fields, in order), http (status line and header lines), payload."""
    base = placed(pages)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page_id", "target_uri", "place")]
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), size, F.lit("\r\n"))
    fields = {
        "WARC-Payload-Digest": digest(F.col("payload")),
        "Content-Type": F.lit("application/http; msgtype=response"),
        "Content-Length": (F.octet_length(http) + 2 + F.octet_length("payload")).cast("string"),
    }
    headers = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in fields.items()])
    return base.select("page_id", record_id(F.lit("response"), *parts).alias("record_id"), "target_uri", F.lit(date).alias("date"), headers.alias("headers"), http.alias("http"), "payload")


def derivatives(response: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response: page_id, record_type, record_id, refers_to,
    target_uri, date, content_type, source_headers, block_digest, content_length, block."""
    small_batches(response.sparkSession)
    p = F.col("payload")
    first = lambda pattern: F.regexp_extract(p, pattern, 1)
    links = link_targets(F.regexp_extract_all(p, F.lit(HREF), 1))
    http = F.coalesce("http", F.lit(""))
    fields = F.concat(
        F.lit("http-status: "), F.regexp_extract(http, r"^HTTP/\S+ ([0-9]+)", 1),
        F.lit("\r\ntitle: "), F.trim(F.regexp_replace(resolved(first(r"(?is)<title[^>]*>(.*?)</title>")), r"\s+", " ")),
        F.lit("\r\nlanguage: "), first(r'(?i)<html[^>]*\blang="([^"]*)"'),
        F.lit("\r\ncharset: "), F.lower(first(r"""(?i)<meta[^>]*\bcharset=["']?([A-Za-z0-9_-]+)""")),
        F.array_join(F.transform(F.regexp_extract_all(http, F.lit(r"(?m)^([^:\s]+:[^\r\n]*)\r?$"), 1), lambda h: F.concat(F.lit("\r\nhttp-header: "), h)), ""),
        F.array_join(F.transform(links, lambda u: F.concat(F.lit("\r\noutlink: "), u)), ""),
        F.lit("\r\n"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=UTF-8").alias("content_type"), plain_text(p).alias("block")),
    )
    source = F.transform(
        "headers",
        lambda h: F.struct(F.when(F.lower(h["name"]).isin(*OWN), F.concat(F.lit("WARC-Source-"), F.regexp_replace(h["name"], "(?i)^warc-", ""))).otherwise(h["name"]).alias("name"), h["value"].alias("value")),
    )
    made = response.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", source.alias("source_headers"), F.explode(kinds).alias("r"))
    return made.select(
        "page_id",
        "r.record_type",
        record_id(F.col("r.record_type"), F.col("refers_to")).alias("record_id"),
        "refers_to", "target_uri", "date", "r.content_type", "source_headers",
        digest(F.col("r.block")).alias("block_digest"),
        F.octet_length("r.block").cast("bigint").alias("content_length"),
        "r.block",
    )


def serialised(records: DataFrame) -> DataFrame:
    """records with ``record``: the WARC/1.1 record as text, headers, block and final blank lines."""
    line = lambda name, value: F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))
    c = F.col
    source = F.array_join(F.transform("source_headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n"))), "")
    return records.withColumn(
        "record",
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", c("record_type")), line("WARC-Record-ID", c("record_id")),
            line("WARC-Refers-To", c("refers_to")), line("WARC-Refers-To-Target-URI", c("target_uri")),
            line("WARC-Refers-To-Date", c("date")), line("WARC-Target-URI", c("target_uri")), line("WARC-Date", c("date")),
            source, line("WARC-Block-Digest", c("block_digest")),
            line("Content-Type", c("content_type")), line("Content-Length", c("content_length").cast("string")),
            F.lit("\r\n"), c("block"), F.lit("\r\n\r\n"),
        ),
    )


def write(records: DataFrame, path: str) -> None:
    """WARC files, one for each partition. The last line end of a record is the text writer's."""
    bare = F.regexp_replace("record", "\n\\z", "")
    serialised(records).select(bare.alias("record")).write.option("lineSep", "\n").text(path)


def _inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes in pieces; gzip members one after the other. A broken member ends the file."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at = 0
    while content[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(content):
            piece = content[at : at + step]
            try:
                yield member.decompress(piece)
            except zlib.error:
                return
            at += len(piece) - len(member.unused_data)


def split_records(content: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes, str | None]]:
    """Header fields, block and error of every record of an uncompressed or gzipped WARC file.

    error: ``no length`` for a record without a readable Content-Length (its block is empty, and reading goes on at
    the next record), ``truncated`` where the file ends inside headers or a block, else None.
    """
    pieces, buffer = _inflated(content), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        buffer.extend(piece)
        return True

    while True:
        while (start := buffer.find(b"WARC/")) < 0:
            del buffer[:-4]
            if not more():
                return
        del buffer[:start]
        while (end := buffer.find(b"\r\n\r\n")) < 0 and more():
            pass
        lines = bytes(buffer[: end if end >= 0 else None]).decode("utf-8", "replace").split("\r\n")[1:]
        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
        if end < 0:
            yield fields, b"", "truncated"
            return
        del buffer[: end + 4]
        size = next((int(v) for k, v in fields if k.lower() == "content-length" and v.isascii() and v.isdigit()), None)
        if size is None:
            yield fields, b"", "no length"
            continue
        while len(buffer) < size and more():
            pass
        yield fields, bytes(buffer[:size]), None if len(buffer) >= size else "truncated"
        del buffer[:size]


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[dict] = []
    size = 0
    for pdf in batches:
        for content in pdf.content:
            for fields, block, error in split_records(content):
                held.append({"headers": [{"name": k, "value": v} for k, v in fields], "block": block, "error": error})
                size += len(block)
                if size > 4 << 20 or len(held) >= 1000:
                    yield pd.DataFrame(held)
                    held, size = [], 0
    if held:
        yield pd.DataFrame(held)


def read(spark: SparkSession, path: str) -> DataFrame:
    """headers (array of name, value), block (binary) and error of every record of the WARC files in path.

    A file is one row of Spark's reader, so of less than 2 GB; its records are inflated and passed on bit by bit.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_records, "headers array<struct<name:string,value:string>>, block binary, error string")


def unchunked(body: bytes) -> bytes:
    """A body in chunked transfer coding; as far as it can be read."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if size == 0:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def http_message(block: bytes) -> dict[str, str]:
    """http (status line and header lines) and payload (decoded text) of an HTTP response.

    Chunks, gzip and deflate are undone; the charset is that of the header, else of the page's meta element, else
    UTF-8; bytes that it does not have become U+FFFD.
    """
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        head, body = b"", block
    http = head.decode("utf-8", "replace") + "\r\n" if mark else ""
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.split("\r\n")[1:])}
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = unchunked(body)
    coding = fields.get("content-encoding", "").lower()
    try:
        if coding in ("gzip", "x-gzip"):
            body = b"".join(_inflated(body))
        elif coding == "deflate":
            body = zlib.decompress(body, 15 if body[:1] == b"\x78" else -15)
    except zlib.error:
        pass
    named = re.search(r"charset=[\"']?([\w.:-]+)", fields.get("content-type", ""), re.I)
    charset = named[1] if named else next(iter(re.findall(rb"<meta[^>]*\bcharset=[\"']?([A-Za-z0-9_.:-]+)", body[:4096], re.I)), b"utf-8").decode()
    try:
        text = body.decode(charset, "replace")
    except (LookupError, UnicodeError):
        text = body.decode("utf-8", "replace")
    return {"http": http, "payload": text}


@F.pandas_udf(StructType([StructField("http", StringType()), StructField("payload", StringType())]))
def _messages(blocks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([http_message(b) for b in blocks], columns=["http", "payload"], dtype=object)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The whole response records of WARC files as ``responses`` gives them; page_id is null. Broken records are left out;
    ``read`` reports them."""
    small_batches(spark)
    named = lambda name: F.get(F.filter("headers", lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]
    taken = ("warc-type", "warc-record-id", "warc-target-uri", "warc-date")
    whole = read(spark, path).filter((F.lower(named("warc-type")) == "response") & F.col("error").isNull()).withColumn("m", _messages("block"))
    return whole.select(
        F.lit(None).cast("bigint").alias("page_id"), named("warc-record-id").alias("record_id"), named("warc-target-uri").alias("target_uri"), named("warc-date").alias("date"),
        F.filter("headers", lambda h: ~F.lower(h["name"]).isin(*taken)).alias("headers"), "m.http", "m.payload",
    )
