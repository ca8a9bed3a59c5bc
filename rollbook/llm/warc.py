"""WARC records: reading and writing them, and deriving metadata and conversion records from responses."""

from __future__ import annotations

import gzip
import html as _html
import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

VERSION = "WARC/1.0"
CRLF = "\r\n"
#: Date of records that carry none; a run gives the crawl's own.
NO_DATE = "1970-01-01T00:00:00Z"


#: Bytes of blocks that a reader gives on together, and that it asks of an archive at a time.
BATCH = 32 << 20
CHUNK = 1 << 20


def _some(stream: BinaryIO, n: int) -> bytes:
    """The next n bytes, or as many as can be read."""
    parts: list[bytes] = []
    while n > 0:
        try:
            part = stream.read(min(n, CHUNK))
        except (EOFError, OSError, zlib.error):
            break
        if not part:
            break
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


def _line(stream: BinaryIO) -> bytes:
    try:
        return stream.readline()
    except (EOFError, OSError, zlib.error):
        return b""


def cut_records(archive: bytes) -> Iterator[tuple[bytes, bytes, bool]]:
    """(head, block, complete) for each record of an archive, plain or gzip (member by member or whole).

    A block has the length that its head states, whatever it holds. Not complete: a block that ends early, a head without a
    length or without an end, and a block that is followed by anything but empty lines and the next record.
    """
    stream = gzip.GzipFile(fileobj=io.BytesIO(archive)) if archive[:2] == b"\x1f\x8b" else io.BytesIO(archive)
    held: tuple[bytes, bytes, bool] | None = None
    while line := _line(stream):
        if not line.startswith(b"WARC/"):
            if held and line.strip():
                held = (*held[:2], False)
            continue
        if held:
            yield held
        head: list[bytes] = []
        while (line := _line(stream)).strip():
            head.append(line)
        whole = b"".join(head)
        length = LENGTH.search(whole)
        block = _some(stream, int(length[1])) if length and line else b""
        held = whole.rstrip(b"\r\n"), block, bool(length and line) and len(block) == int(length[1])
    if held:
        yield held


LENGTH = re.compile(rb"^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", re.I | re.M)
CUT = T.StructType([T.StructField("warc_headers", T.StringType()), T.StructField("rest", T.BinaryType()), T.StructField("complete", T.BooleanType())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for archive in whole.column(0):
            held, size = [], 0
            for head, block, complete in cut_records(archive.as_py()):
                held.append({"warc_headers": head.decode("utf-8", "replace"), "rest": block, "complete": complete})
                size += len(block)
                if size > BATCH or len(held) >= 10_000:
                    yield pa.RecordBatch.from_pylist(held, ARROW_CUT)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, ARROW_CUT)


ARROW_CUT = pa.schema([("warc_headers", pa.string()), ("rest", pa.binary()), ("complete", pa.bool_())])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, target_uri, warc_date, refers_to, content_type, content_length, payload_digest, block_digest,
    warc_headers, block, complete) for each record of the WARC files at path (plain, or gzip by record or whole).

    Records are cut by their Content-Length, never by their text, so a block may hold other records. A file is one task's work
    and is held as it lies on disk (below 2 GB, Spark's bound of a value); what it unpacks to is given on in batches. complete is false for a
    record that cut_records doesn't find whole; of a damaged gzip file what lies before the damage is read. Empty files: no rows.
    """
    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_cut, CUT)

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("warc_headers", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))

    length = F.expr("try_cast(length_text AS BIGINT)")
    out = raw.withColumn("length_text", field("Content-Length")).withColumn("content_length", length)
    return out.select(
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Date").alias("warc_date"),
        field("WARC-Refers-To").alias("refers_to"),
        field("Content-Type").alias("content_type"),
        "content_length",
        field("WARC-Payload-Digest").alias("payload_digest"),
        field("WARC-Block-Digest").alias("block_digest"),
        "warc_headers",
        F.col("rest").alias("block"),
        "complete",
    )


def _urn(*parts: Column) -> Column:
    """A record id made from the parts' md5, so that a rerun gives the same ids."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def responses(pages: DataFrame, warc_date: str = NO_DATE) -> DataFrame:
    """Response records for a table of fetched pages (page_id, url, html); the id comes from page, address and content."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id",
        _urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.md5(html.cast("binary"))).alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.lit(warc_date).alias("warc_date"),
        F.lit("text/html").alias("content_type"),
        _digest(html).alias("payload_digest"),
        html.alias("payload"),
    )


#: Headers of a source that derived records have under names of their own, or that hold for the source's block only.
OWN_HEADERS = r"(?i)^(WARC-(Type|Record-ID|Refers-To|Target-URI|Date|Payload-Digest|Block-Digest|Concurrent-To)|Content-(Type|Length)):"


#: Labels of character sets that browsers read as another one; fixed values.
READ_AS = {"iso-8859-1": "cp1252", "iso8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "l1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "gb2312": "gb18030", "gbk": "gb18030", "shift_jis": "cp932", "shift-jis": "cp932", "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "iso-8859-9": "cp1254", "utf8": "utf-8"}
#: Marks at the beginning of a text and what they stand for; fixed values.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
CHARSET = r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)"
#: A page names its own set within this many bytes.
SNIFFED = 1024
IN_PAGE = rf"<meta\b[^>]*?{CHARSET}|<\?xml\b[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9_:.-]+)"
SIZE = re.compile(rb"\s*([0-9a-fA-F]{1,15})\s*(?:;.*)?", re.S)


def dechunked(body: bytes) -> bytes | None:
    """A chunked body as one; a body without a first chunk as it is (its coding was undone before); null if a chunk is cut."""
    out: list[bytes] = []
    at = 0
    while True:
        end = body.find(b"\r\n", at)
        size = SIZE.fullmatch(body[at:end]) if 0 <= end < at + 4096 else None
        if not size:
            return body if at == 0 else None
        n = int(size[1], 16)
        if n == 0:
            return b"".join(out)
        if end + 2 + n > len(body):
            return None
        out.append(body[end + 2 : end + 2 + n])
        at = end + n + 4


def inflated(body: bytes, coding: str) -> bytes | None:
    """A gzip or deflate body (with or without its frame) unpacked; null if it is cut or damaged."""
    if coding != "deflate" and body[:2] != b"\x1f\x8b":
        return body
    for frame in (47, -15) if coding == "deflate" else (47,):
        out, rest = [], body
        try:
            while rest:
                unpack = zlib.decompressobj(frame)
                out.append(unpack.decompress(rest))
                if not unpack.eof:
                    break
                # More members follow; other bytes after the last do not count.
                rest = unpack.unused_data if unpack.unused_data[:2] == b"\x1f\x8b" else b""
            else:
                return b"".join(out)
        except zlib.error:
            continue
    return None


def body_text(head: str, body: bytes) -> str | None:
    """The text of an HTTP response: codings undone, last first, then decoded by its mark, its header or its page's own word.

    No set named, or an unknown one: UTF-8. Bytes that are none of the set's become U+FFFD. Null: a coding other than chunked,
    gzip and deflate, or a body that is cut or damaged.
    """
    codings: list[str] = []
    for name in ("content-encoding", "transfer-encoding"):
        for value in re.findall(rf"(?im)^{name}:[ \t]*([^\r\n]*)", head):
            codings += [c.strip().lower() for c in value.split(",")]
    for coding in reversed(codings):
        if coding == "chunked":
            undone = dechunked(body)
        elif coding in ("gzip", "x-gzip", "deflate"):
            undone = inflated(body, coding) if body else body
        elif coding in ("", "identity"):
            undone = body
        else:
            return None
        if undone is None:
            return None
        body = undone
    for mark, name in MARKS:
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    own = re.search(rf"(?im)^content-type:[^\r\n]*?{CHARSET}", head)
    page = None if own else re.search(IN_PAGE, body[:SNIFFED].decode("latin-1"), re.I)
    label = (own[1] if own else (page[1] or page[2]) if page else "utf-8").lower()
    if page and label.startswith("utf-16"):
        label = "utf-8"
    try:
        return body.decode(READ_AS.get(label, label), "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def _body_text(heads: pd.Series, bodies: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else body_text(h or "", bytes(b)) for h, b in zip(heads, bodies, strict=True)], dtype=object)


def fetched(records: DataFrame, unreadable: bool = False) -> DataFrame:
    """What derive takes, for the HTTP responses among records (as read_records gives them), with source_headers beside it.

    The HTTP head is split off the block; its Content-Type is the response's. The payload is the body as body_text reads it; a body in plain
    UTF-8 does without Python. A block without the end of a head is all payload. Responses that are not complete, and those whose
    body can't be read, are no source of records: they are left out, or given with unreadable = True, a null payload and
    readable = false. source_headers holds the other WARC headers, each line as WARC-Source-...; keep it in derive to have it written.
    """
    is_http = F.lower("target_uri").rlike("^<?https?:") | F.lower("content_type").startswith("application/http")
    end = "locate('\\r\\n\\r\\n', latin)"
    found = records.where((F.lower("record_type") == "response") & is_http).withColumn("latin", F.decode("block", "ISO-8859-1"))
    found = found.withColumn("at", F.when(F.col("latin").startswith("HTTP/"), F.expr(end)).otherwise(F.lit(0)))
    found = found.withColumn("head", F.expr("substring(latin, 1, greatest(at - 1, 0))")).withColumn("body", F.expr("CASE WHEN at > 0 THEN substring(block, at + 4) ELSE block END"))
    kind = F.trim(F.regexp_extract("head", r"(?im)^content-type:[ \t]*([^\r\n]*)", 1))
    first = F.expr(f"decode(substring(body, 1, {SNIFFED}), 'ISO-8859-1')")
    named = F.lower(F.regexp_extract(kind, f"(?i){CHARSET}", 1))
    coded = F.col("head").rlike(r"(?im)^(transfer|content)-encoding:") | first.rlike("^(\u00ef\u00bb\u00bf|\u00ff\u00fe|\u00fe\u00ff)")
    plain = ~coded & ((named == "utf-8") | (named == "") & ~first.rlike(f"(?i){IN_PAGE}"))
    text = F.when(plain, F.expr("make_valid_utf8(cast(body AS STRING))")).otherwise(_body_text(F.when(~plain, F.col("head")), F.when(~plain, F.col("body"))))
    lines = F.filter(F.split("warc_headers", "\r?\n"), lambda x: x.contains(":") & ~x.rlike(OWN_HEADERS))
    out = found.select(
        "record_id",
        "target_uri",
        "warc_date",
        kind.alias("content_type"),
        "payload_digest",
        F.when(F.col("complete"), text).alias("payload"),
        F.array_join(F.transform(lines, lambda x: F.concat(F.lit("WARC-Source-"), F.regexp_replace(x, "(?i)^WARC-", ""), F.lit(CRLF))), "").alias("source_headers"),
    ).withColumn("readable", F.col("payload").isNotNull())
    return out if unreadable else out.where("readable").drop("readable")


#: The commonest references, which are decoded without Python; the ampersand comes last, so that nothing is decoded twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: Pages with any other reference: every named and numeric one is decoded as in HTML.
OTHER = "&(?!(?:" + "|".join(name[1:-1] for name, _ in ENTITIES) + ");)(?:#[0-9xX]|[A-Za-z])"
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{0,31};?)")
#: Markup, from left to right: comments, elements whose text is not seen, any other tag.
MARKUP = r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\s*(script|style|noscript|template)\s*>|<[^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"'>]*)[\"']"


def decoded(text: str) -> str:
    """All references of a text as characters, each decoded once; a space that does not break is a space."""
    return REFERENCE.sub(lambda m: _html.unescape(m[0]).replace("\xa0", " "), text)


@F.pandas_udf(T.StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(decoded, na_action="ignore")


def _without_markup(html: Column) -> Column:
    return F.regexp_replace(html, MARKUP, " ")


def _readable(text: Column) -> Column:
    """References decoded, runs of space to one."""
    common = text
    for name, char in ENTITIES:
        common = F.replace(common, F.lit(name), F.lit(char))
    other = text.rlike(OTHER)
    seen = F.when(other, _decoded(F.when(other, text))).otherwise(common)
    # A lone space stays as it is: only what changes is matched.
    return F.trim(F.regexp_replace(seen, r"[\t\r\n\f][ \t\r\n\f]*| [ \t\r\n\f]+", " "))


def plain_text(html: Column) -> Column:
    """The whole visible text of a page: markup to spaces, references decoded, runs of space to one."""
    return _readable(_without_markup(html))



def derive(source: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records per response: a metadata record (application/warc-fields) and a conversion record (text/plain).

    source: record_id, target_uri, warc_date, content_type, payload_digest, payload (text); other columns are dropped
    unless keep names them. Both records refer to the response by WARC-Refers-To, keep its address and date, and state its
    payload digest as WARC-Source-Payload-Digest and its type as WARC-Source-Content-Type. The metadata lists the title, the lengths and each link in page
    order (repeated links repeat). Null payload: an empty one; null address, date or type: empty. Repeated responses give
    repeated records. A row-local plan: no shuffle.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    payload = text("payload")
    links = F.regexp_extract_all(payload, F.lit(LINK), F.lit(1))
    base = source.select(
        *keep,
        text("record_id").alias("refers_to"),
        text("target_uri").alias("target_uri"),
        text("warc_date").alias("warc_date"),
        text("content_type").alias("source_content_type"),
        text("payload_digest").alias("source_payload_digest"),
        F.array(
            F.struct(
                F.lit("metadata").alias("record_type"),
                F.lit("application/warc-fields").alias("content_type"),
                F.concat(
                    F.concat(F.lit("title: "), F.trim(F.regexp_replace(F.regexp_extract(payload, TITLE, 1), r"\s+", " ")), F.lit(CRLF)),
                    F.concat(F.lit("sourceLength: "), F.octet_length(payload).cast("string"), F.lit(CRLF)),
                    F.array_join(F.transform(links, lambda u: F.concat(F.lit("outlink: "), u, F.lit(" L a/@href"), F.lit(CRLF))), ""),
                ).alias("block"),
            ),
            F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), _without_markup(payload).alias("block")),
        ).alias("made"),
    )
    out = base.select("*", F.inline("made")).drop("made")
    # The text is there once: references are looked for in it, not in the page.
    out = out.withColumn("block", F.when(F.col("record_type") == "conversion", _readable(F.col("block"))).otherwise(F.col("block")))
    return out.select(
        *keep,
        "record_type",
        _urn(F.col("record_type"), F.col("refers_to")).alias("record_id"),
        "refers_to",
        "target_uri",
        "warc_date",
        "source_content_type",
        "source_payload_digest",
        "content_type",
        F.octet_length("block").cast("long").alias("content_length"),
        _digest(F.col("block")).alias("block_digest"),
        "block",
    )


def serialized(records: DataFrame) -> DataFrame:
    """(value): each derived record as WARC text, but for its last line end, which write_records adds."""
    line = lambda name, col: F.concat(F.lit(f"{name}: "), F.col(col).cast("string"), F.lit(CRLF))
    return records.select(
        F.concat(
            F.lit(VERSION + CRLF),
            line("WARC-Type", "record_type"),
            line("WARC-Record-ID", "record_id"),
            line("WARC-Refers-To", "refers_to"),
            line("WARC-Target-URI", "target_uri"),
            line("WARC-Date", "warc_date"),
            line("WARC-Source-Content-Type", "source_content_type"),
            line("WARC-Source-Payload-Digest", "source_payload_digest"),
            line("WARC-Block-Digest", "block_digest"),
            line("Content-Type", "content_type"),
            line("Content-Length", "content_length"),
            F.coalesce("source_headers", F.lit("")) if "source_headers" in records.columns else F.lit(""),
            F.lit(CRLF),
            F.col("block"),
            F.lit(CRLF),
        ).alias("value")
    )


def write_records(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes derived records as WARC files, one per partition, through Spark's committer."""
    serialized(records).write.option("lineSep", CRLF).option("compression", compression).text(path)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")), keep=("page_id",))


OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
r AS (
  SELECT *, md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || target_uri || '|' || md5(payload)) AS h FROM p),
b AS (
  SELECT page_id, target_uri, payload, '<urn:uuid:' || concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) || '>' AS refers_to
  FROM r),
m AS (
  SELECT page_id, target_uri, payload, refers_to, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'title: ' || trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1), '\s+', ' ', 'g')) || chr(13) || chr(10)
    || 'sourceLength: ' || strlen(payload)::VARCHAR || chr(13) || chr(10)
    || coalesce(array_to_string(list_transform(regexp_extract_all(payload, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"''>]*)["'']', 1), lambda u: 'outlink: ' || u || ' L a/@href' || chr(13) || chr(10)), ''), '') AS block
  FROM b
  UNION ALL
  SELECT page_id, target_uri, payload, refers_to, 'conversion', 'text/plain',
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(payload, '(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\s*(script|style|noscript|template)\s*>|<[^>]*>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \t\r\n\f]+', ' ', 'g'))
  FROM b),
i AS (SELECT *, md5(record_type || '|' || refers_to) AS g FROM m)
SELECT page_id, record_type, '<urn:uuid:' || concat_ws('-', substr(g, 1, 8), substr(g, 9, 4), substr(g, 13, 4), substr(g, 17, 4), substr(g, 21, 12)) || '>' AS record_id,
  refers_to, target_uri, '1970-01-01T00:00:00Z' AS warc_date, 'text/html' AS source_content_type, 'sha256:' || sha256(payload) AS source_payload_digest,
  content_type, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, block
FROM i
"""
