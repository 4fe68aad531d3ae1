"""Derivative WARC records: linked metadata and plain-text conversion records of response records.

A page is first a response record (HTTP headers and body). Of each response two records derive: a
`metadata` record of header fields and outlinks, and a `conversion` record of the page's plain text.
Both keep the response's identifier in WARC-Refers-To, its target, date and source headers, and carry
block and payload digests of their own; record identifiers are name-based, so reruns agree.
Everything is a column expression, so a record is made where its page is read and nothing is shuffled.

The text of a page is its body without scripts, styles, templates and comments; block elements end lines, other
tags vanish (a `<` that begins none stays), numeric entities and those that HTML names are resolved (unknown names stay), runs of blanks
shrink to one and blank lines go.

Defined results: a null url has an empty target, null html has an empty body (and an empty text,
whose conversion record stays, so that links hold); a null page_id enters the identifiers as `null`; line ends in a url or
link are percent-encoded, so they can't end a field; repeated rows give equal records of equal identifiers, as they are one record;
an empty table gives none. A page goes through a fixed number of expressions, each linear in its length but for one replacement a distinct
entity. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entities, numeric or named, but for the ampersand's.
ENTITY = r"&(?!amp;|AMP;|#0*38;|#[xX]0*26;)(?:#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: The names of HTML and their characters, as Python's library lists them.
NAMED = "\x02".join(f"&{name}\x01{value}" for name, value in sorted(html5.items()) if name.endswith(";"))
#: What HTML reads the numbers 128 to 159 as.
C1 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
EPOCH = "2024-01-01T00:00:00Z"


def _character(entity: Column) -> Column:
    """Of an entity; no-break spaces are spaces as `&nbsp;` is, and what is no character is U+FFFD."""
    named = F.str_to_map(F.lit(NAMED), F.lit("\x02"), F.lit("\x01"))
    word = F.when(entity == "&nbsp;", F.lit(" ")).otherwise(F.coalesce(F.try_element_at(named, entity), entity))
    digits = F.regexp_extract(entity, "([0-9a-fA-F]+);", 1)
    code = F.when(entity.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
    wrong = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    old = F.substring(F.lit(C1), (code - 127).cast("int"), F.lit(1))
    return F.when(~F.startswith(entity, F.lit("&#")), word).when(code == 160, F.lit(" ")).when(wrong, F.lit("\ufffd")).when(code.between(128, 159), old).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def plain_text(html: Column) -> Column:
    t = F.coalesce(html, F.lit(""))
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</(script|style|noscript|template)\s*>", "")
    t = F.regexp_replace(t, r"[\t\n\x0B\f\r ]+", " ")
    t = F.regexp_replace(t, rf"(?i)</?({BLOCKS})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"</?[A-Za-z!?][^>]*>", "")
    entities = F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(ENTITY), 0))
    t = F.aggregate(entities, t, lambda done, entity: F.replace(done, entity, _character(entity)))
    t = F.regexp_replace(t, "&(amp|AMP|#0*38|#[xX]0*26);", "&")  # last and at once, so that nothing is resolved twice
    t = F.regexp_replace(t, r" *\n[ \n]*", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"[ ]+", " "), r"^[ \n]+|[ \n]+$", "")


def one_line(value: Column) -> Column:
    """Line ends percent-encoded."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def outlinks(html: Column) -> Column:
    """Distinct values of href in links, in double quotes, single quotes or none."""
    value = r"""(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(value), 1)
    return F.array_distinct(F.transform(found, lambda x: one_line(F.regexp_replace(x, r"""(?s)^(["'])(.*)\1$""", "$2"))))


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title\s*>", 1), r"[\t\n\x0B\f\r ]+", " "))


def record_id(*parts: Column) -> Column:
    """A urn:uuid made from a digest of the parts, in the form of a name-based (version 5) identifier."""
    h = F.sha1(F.concat_ws("\n", *parts).cast("binary"))
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">")
    )


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(value.cast("binary")))


def responses(pages: DataFrame, date: str = EPOCH) -> DataFrame:
    """Response records of pages: page_id, record_id, target_uri, warc_date, http_head, body."""
    body = F.coalesce(F.col("html"), F.lit(""))
    url = F.coalesce(F.col("url"), F.lit(""))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", record_id(F.lit("response"), name, url, digest(body)).alias("record_id"), one_line(url).alias("target_uri"), F.lit(date).alias("warc_date"), head.alias("http_head"), body.alias("body"))


def derivatives(response: DataFrame) -> DataFrame:
    """Two rows for each response: its metadata and its conversion record, with headers and block."""
    based = response.withColumns(
        {
            "_text": plain_text(F.col("body")),
            "_payload": digest(F.col("body")),
            "_source_block": digest(F.concat("http_head", "body")),
            "_links": outlinks(F.col("body")),
            "_title": title(F.col("body")),
        }
    )
    meta = F.concat(
        F.lit("fetchStatus: 200\r\ncharset: utf-8\r\ntitle: "),
        F.col("_title"),
        F.lit("\r\nsourcePayloadDigest: "),
        F.col("_payload"),
        F.lit("\r\n"),
        F.array_join(F.transform("_links", lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))), ""),
    )

    def made(kind: str, block: Column, mime: str) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), block.alias("block"), F.lit(mime).alias("content_type"))

    both = based.withColumn("r", F.explode(F.array(made("metadata", meta, "application/warc-fields"), made("conversion", F.col("_text"), "text/plain"))))
    return both.select(
        "page_id",
        F.col("r.record_type").alias("record_type"),
        record_id(F.col("r.record_type"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("r.content_type").alias("content_type"),
        F.octet_length("r.block").cast("long").alias("content_length"),
        digest(F.col("r.block")).alias("block_digest"),
        F.col("_payload").alias("source_payload_digest"),
        F.col("_source_block").alias("source_block_digest"),
        F.size("_links").cast("long").alias("n_outlinks"),
        F.col("http_head").alias("source_headers"),
        F.col("r.block").alias("block"),
    )


def serialized(records: DataFrame) -> DataFrame:
    """The bytes of each record as a WARC file holds them; writing them with the text writer gives a valid file.

    The source's digests and (form-encoded) headers go along in fields of their own.
    """
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), "record_id"),
        F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Target-URI: "), "target_uri"),
        F.concat(F.lit("WARC-Date: "), "warc_date"),
        F.concat(F.lit("WARC-Block-Digest: "), "block_digest"),
        F.concat(F.lit("WARC-Payload-Digest: "), "block_digest"),
        F.concat(F.lit("WARC-Source-Block-Digest: "), "source_block_digest"),
        F.concat(F.lit("WARC-Source-Payload-Digest: "), "source_payload_digest"),
        F.concat(F.lit("WARC-Source-Headers: "), F.url_encode("source_headers")),
        F.concat(F.lit("Content-Type: "), "content_type"),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    )
    return records.select("page_id", "record_type", F.concat(head, F.lit("\r\n\r\n"), "block", F.lit("\r\n\r\n")).cast("binary").alias("record"))
