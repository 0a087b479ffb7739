r"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Every response record gives one ``metadata`` record (application/warc-fields: what is known of the source)
and one ``conversion`` record (text/plain). Both name the response in WARC-Refers-To, keep its target
URI and date, and carry the digests and HTTP headers of the source; their own ids follow from the
response's id, so that a repeated run names them alike.

The text of a conversion is the page without scripts, styles and comments, block-level tags as line
breaks, other tags dropped (a tag ends at the first > outside the quotes of its attributes; what is not closed runs to the end of the page), all character references of HTML decoded once (``&nbsp;`` as a plain space),
white space inside a line made one space, and empty lines dropped. References are decoded in an Arrow
function; the step is narrow, and each record is a row of its own. ``serialize`` writes the
source's HTTP headers into the metadata record. The SQL decodes ENTITIES and decimal references alone,
so it holds for pages without others.

Defined results: a null payload is an empty one; a null target URI stays null; repeated responses give
repeated derivatives; an empty table gives no records; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, SLICE_ROWS, slices

#: Character references that the SQL decodes, in this order (&amp; last, which may lack its semicolon).
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&euro;": "€"}
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<noscript\b.*?(?:</noscript\s*>|\z)"
#: The rest of a tag after its name, attribute by attribute: a > between the quotes of a value does not end it, the page's end does.
TAG_REST = r"""[^>=]*+(?:= ?+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+[^>=]*+)*+(?:>|\z)"""
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b" + TAG_REST
TAG = "</?[a-zA-Z!]" + TAG_REST
TITLE = r"(?is)<title[^<>]*>([^<]*)</title"
#: White space that is not already one space; single spaces are most of it and need no work.
SPACE_RUN = r"[\t\n\f\r ]{2,}|[\t\n\f\r]"
_BLANK_RUN, _LINE_ENDS = re.compile("[ \t]{2,}|\t"), re.compile(" ?\n[ \n]*")
DATE = "2024-01-01T00:00:00Z"
HTTP_HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def urn(seed: Column) -> Column:
    """A name-based record id: the MD5 of the seed in the form of a UUID."""
    h = F.md5(seed.cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses_from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of stored pages: record_id, target_uri, warc_date, http_headers, content_type, payload, payload_digest."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(
        urn(F.concat(F.lit("response:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(url_col), F.lit("")))).alias("record_id"),
        F.col(url_col).alias("target_uri"), F.lit(DATE).alias("warc_date"), F.lit(HTTP_HEADERS).alias("http_headers"),
        F.lit("text/html; charset=utf-8").alias("content_type"), payload.alias("payload"), digest(payload).alias("payload_digest"),
    )


def bare_text(html: Column) -> Column:
    """A page without markup, its character references as they were."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    t = F.regexp_replace(t, SPACE_RUN, " ")
    return F.regexp_replace(F.regexp_replace(t, BLOCK, "\n"), TAG, "")


def plain_text(bare: str) -> str:
    """The conversion's text from ``bare_text``."""
    t = html_lib.unescape(bare.replace("&nbsp;", " ")) if "&" in bare else bare
    return _LINE_ENDS.sub("\n", _BLANK_RUN.sub(" ", t)).strip(" \n")


def _with_text(rows: DataFrame) -> DataFrame:
    """``rows`` with the column ``text`` in place of ``bare``, which is the last."""
    kept = rows.columns[:-1]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [plain_text(x) for x in part.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, "text"])

    return rows.mapInArrow(run, schema)


def derivatives(responses: DataFrame) -> DataFrame:
    """Metadata and conversion records of ``responses``, two rows each, with their blocks."""
    r = responses.select("record_id", "target_uri", "warc_date", "http_headers", "content_type", F.coalesce("payload", F.lit("")).alias("payload"), "payload_digest")
    title = F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"\s+", " ")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    source = F.concat(
        line("source-record-id", F.col("record_id")), line("source-payload-digest", F.col("payload_digest")), line("source-content-type", F.col("content_type")),
        line("source-length", F.octet_length("payload").cast("string")), line("title", title),
    )
    r = _with_text(r.select("record_id", "target_uri", "warc_date", "http_headers", "content_type", "payload_digest", source.alias("source"), bare_text(F.col("payload")).alias("bare")))
    fields = F.concat("source", line("text-digest", digest(F.col("text"))), line("text-length", F.octet_length("text").cast("string")))
    kinds = F.explode(F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )).alias("d")
    out = r.select("record_id", "target_uri", "warc_date", "http_headers", F.col("content_type").alias("source_content_type"), F.col("payload_digest").alias("source_digest"), kinds)
    return out.select(
        F.col("d.warc_type").alias("warc_type"), urn(F.concat("d.warc_type", F.lit(":"), "record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
        F.col("d.content_type").alias("content_type"), F.octet_length("d.block").cast("long").alias("content_length"), digest(F.col("d.block")).alias("block_digest"),
        "source_digest", "source_content_type", F.col("http_headers").alias("source_http_headers"), F.col("d.block").alias("block"),
    )


def serialize(records: DataFrame) -> DataFrame:
    """(record_id, record): each derivative as the bytes of a WARC/1.1 record.

    The block of a metadata record ends in the source's HTTP headers, a field ``source-http-header``
    for each line; its length and digest are those of the block as written.
    """
    lines = F.filter(F.split("source_http_headers", "\r?\n"), lambda x: x != "")
    headers = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("source-http-header: "), x, F.lit("\r\n"))), "")
    whole = F.when(F.col("warc_type") == "metadata", F.concat("block", F.coalesce(headers, F.lit("")))).otherwise(F.col("block"))
    records = records.withColumn("block", whole).withColumn("content_length", F.octet_length("block").cast("long")).withColumn("block_digest", digest(F.col("block")))
    head = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    text = F.concat(
        F.lit("WARC/1.1\r\n"), head("WARC-Type", F.col("warc_type")), head("WARC-Record-ID", F.col("record_id")), head("WARC-Refers-To", F.col("refers_to")), head("WARC-Target-URI", F.col("target_uri")),
        head("WARC-Date", F.col("warc_date")), head("WARC-Block-Digest", F.col("block_digest")), head("WARC-Source-Payload-Digest", F.col("source_digest")),
        head("Content-Type", F.col("content_type")), head("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n"),
    )
    return records.select("record_id", text.cast("binary").alias("record"))


def _pieces(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The content of a file piece by piece, gzip members (a record each, as a rule) decompressed one after the other."""
    if raw[:2] != b"\x1f\x8b":
        for at in range(0, len(raw), size):
            yield raw[at : at + size]
        return
    member, at, left = zlib.decompressobj(31), 0, b""
    while left or at < len(raw):
        if not left:
            left, at = raw[at : at + size], at + size
        yield member.decompress(left, size)
        left = member.unconsumed_tail
        if member.eof:
            left = member.unused_data
            if left or at < len(raw):
                member = zlib.decompressobj(31)


def iter_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an uncompressed or gzipped WARC file, one in memory at a time.

    Bytes between records are passed over; a record that the file's end cuts off has what there is of its block.
    """
    held, pieces, ended = bytearray(), _pieces(raw), False

    def more() -> bool:
        nonlocal ended
        piece = next(pieces, None)
        ended = piece is None
        held.extend(piece or b"")
        return not ended

    while True:
        while (start := held.find(b"WARC/")) < 0 and more():
            pass
        if start < 0:
            return
        del held[:start]
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            return
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        heads = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(heads["content-length"]) if heads.get("content-length", "").isdigit() else 0
        while len(held) < end + 4 + size and more():
            pass
        yield heads, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


def parse_records(raw: bytes) -> list[tuple[dict[str, str], bytes]]:
    """All records of a small file."""
    return list(iter_records(raw))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, in the columns that ``derivatives`` takes.

    A file is one row of Spark's binary reader, as it is stored (so below 2 GB compressed); its records
    are decompressed and given one after the other, few at a time.
    """
    names = ["record_id", "target_uri", "warc_date", "http_headers", "content_type", "payload", "payload_digest"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for raw in part.column(0):
                rows, size = [], 0
                for heads, block in iter_records(raw.as_py()):
                    if heads.get("warc-type") != "response":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    http_text = http.decode("latin-1") + "\r\n"
                    kind = next((x.partition(":")[2].strip() for x in http_text.split("\r\n") if x.lower().startswith("content-type:")), None)
                    rows.append((heads.get("warc-record-id"), heads.get("warc-target-uri"), heads.get("warc-date"), http_text, kind, payload.decode("utf-8", "replace"), heads.get("warc-payload-digest")))
                    size += len(payload)
                    if len(rows) >= SLICE_ROWS or size >= SLICE_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    fields = ", ".join(f"{n} string" for n in names)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, fields)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _greedy(pattern: str) -> str:
    """A pattern in which nothing is ever given back, without the signs for that, which RE2 lacks."""
    return _q(pattern.replace("*+", "*").replace("?+", "?"))


def _sql_urn(seed: str) -> str:
    h = f"md5({seed})"
    return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"


def _sql() -> str:
    decoded = "t3"
    for name, char in ENTITIES.items():
        decoded = f"replace({decoded}, {_q(name)}, {_q(char)})"
    crlf = "chr(13) || chr(10)"
    fields = [("source-record-id", "rid"), ("source-payload-digest", "pd"), ("source-content-type", "'text/html; charset=utf-8'"), ("source-length", "strlen(html)::VARCHAR"), ("title", "title"), ("text-digest", "'sha256:' || sha256(txt)"), ("text-length", "strlen(txt)::VARCHAR")]
    meta = " || ".join(f"'{k}: ' || {v} || {crlf}" for k, v in fields)
    return rf"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, {_sql_urn("'response:' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')")} AS rid,
                  'sha256:' || sha256(coalesce(html, '')) AS pd FROM pages),
a AS (SELECT *, regexp_replace(regexp_replace(html, {_q(HIDDEN)}, '', 'g'), {_q(SPACE_RUN)}, ' ', 'g') AS t1, regexp_replace(regexp_extract(html, {_q(TITLE)}, 1), '\s+', ' ', 'g') AS title FROM p),
b AS (SELECT *, regexp_replace(regexp_replace(t1, {_greedy(BLOCK)}, chr(10), 'g'), {_greedy(TAG)}, '', 'g') AS t3 FROM a),
c AS (SELECT *, {decoded} AS t4 FROM b),
e AS (SELECT *, regexp_replace(list_reduce(list_distinct(regexp_extract_all(t4, '&#([0-9]{{2,5}});', 1)), lambda acc, n: replace(acc, '&#' || n || ';', chr(n::INT)), t4), '&amp;?', '&', 'g') AS t5 FROM c),
f AS (SELECT *, trim(regexp_replace(regexp_replace(t5, '[ \t]{{2,}}|\t', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS txt FROM e),
m AS (SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, {meta} AS block FROM f
      UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', txt FROM f)
SELECT warc_type, {_sql_urn("warc_type || ':' || rid")} AS record_id, rid AS refers_to, url AS target_uri, '{DATE}' AS warc_date, content_type,
       strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, pd AS source_digest, 'text/html; charset=utf-8' AS source_content_type
FROM m
"""


ORACLE_SQL = _sql()
