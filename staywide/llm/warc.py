"""WARC derivatives: metadata and plain-text conversion records of responses."""

from __future__ import annotations

import html as markup
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_parts

WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "text/plain; charset=utf-8"
CRLF = "\r\n"

#: Parts of a page that hold no text. One alternative matches from its start to its own end.
DROPPED = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>"
#: Tags that end a line.
BREAKS = r"(?i)<(?:/?(?:p|div|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|main|blockquote|pre|title)|br|hr)\b[^>]*>"
TAGS = r"<[/!?a-zA-Z][^>]*>"
BLANKS = r"[ \t\r\f\x0B]+"
LINES = r" ?\n[ \n]*"
ENDS = r"^[ \n]+|[ \n]+$"


def _decode(text: str) -> str:
    """All named and numeric character references, each once; a no-break space is a blank."""
    return markup.unescape(text).replace("\xa0", " ")


def decoded(text: Column) -> Column:
    @F.pandas_udf("string")
    def each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in in_parts(texts):
            yield pd.Series([_decode(t) for t in batch], dtype=object)

    # A page is decoded once, whatever is made of its text.
    return each.asNondeterministic()(text)


def plain_text(html: Column) -> Column:
    """The text of a page: without comments, scripts, styles and tags, a line per block."""
    text = F.regexp_replace(html, DROPPED, " ")
    text = F.regexp_replace(text, BREAKS, "\n")
    text = F.regexp_replace(text, TAGS, "")
    text = decoded(text)
    text = F.regexp_replace(text, BLANKS, " ")
    text = F.regexp_replace(text, LINES, "\n")
    return F.regexp_replace(text, ENDS, "")


def digest(block: Column) -> Column:
    """A labelled digest in hexadecimal, as the format allows."""
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(block, "UTF-8"), 256))


def record_id(*parts: Column) -> Column:
    """An identifier that the same parts always give."""
    h = F.md5(F.encode(F.concat_ws("\n", *parts), "UTF-8"))
    return F.concat(
        F.lit("<urn:uuid:"),
        F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)),
        F.lit(">"),
    )


def responses(pages: DataFrame) -> DataFrame:
    """Response records of crawled pages (page_id, url, html).

    A null url or page counts as empty. The identifier is made of number, address and
    digest, so repeated rows give equal records.
    """
    html = F.coalesce("html", F.lit(""))
    url = F.coalesce("url", F.lit(""))
    return (
        pages.select("page_id", url.alias("target_uri"), html.alias("payload"))
        .withColumn("payload_digest", digest(F.col("payload")))
        .select(
            "page_id",
            record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"), F.col("payload_digest")).alias("record_id"),
            "target_uri",
            F.lit(WARC_DATE).alias("warc_date"),
            F.lit("text/html").alias("content_type"),
            "payload",
            "payload_digest",
        )
    )


def derivatives(source: DataFrame) -> DataFrame:
    """Two records per response: its metadata, and its plain text as a conversion.

    Takes (page_id, record_id, target_uri, warc_date, content_type, payload,
    payload_digest). Both refer to the response by its identifier and keep its address and
    date; the metadata record also keeps the source's headers and names the conversion by
    its identifier and digest. A response without text gets an empty conversion.

    Each response is read once and expanded into its two records; nothing is shuffled.
    """
    converted = source.withColumn("text", plain_text(F.col("payload")))
    converted = converted.withColumn("text_digest", digest(F.col("text"))).withColumn(
        "conversion_id", record_id(F.lit("conversion"), F.col("record_id"), F.col("text_digest"))
    )
    fields = F.concat(
        F.lit("source-content-type: "),
        F.coalesce("content_type", F.lit("")),
        F.lit(f"{CRLF}source-payload-digest: "),
        "payload_digest",
        F.lit(f"{CRLF}source-length: "),
        F.octet_length("payload").cast("string"),
        F.lit(f"{CRLF}conversion: "),
        "conversion_id",
        F.lit(f"{CRLF}conversion-digest: "),
        "text_digest",
        F.lit(f"{CRLF}conversion-length: "),
        F.octet_length("text").cast("string"),
        F.lit(CRLF),
    )
    converted = converted.withColumn("fields", fields)
    metadata = F.struct(
        F.lit("metadata").alias("warc_type"),
        record_id(F.lit("metadata"), F.col("record_id"), F.col("text_digest")).alias("record_id"),
        F.lit("application/warc-fields").alias("content_type"),
        digest(F.col("fields")).alias("block_digest"),
        F.col("fields").alias("block"),
    )
    conversion = F.struct(
        F.lit("conversion").alias("warc_type"),
        F.col("conversion_id").alias("record_id"),
        F.lit(PROFILE).alias("content_type"),
        F.col("text_digest").alias("block_digest"),
        F.col("text").alias("block"),
    )
    pair = converted.select("page_id", "target_uri", "warc_date", F.col("record_id").alias("refers_to"), F.explode(F.array(metadata, conversion)).alias("r"))
    return pair.select(
        "page_id",
        "r.warc_type",
        "r.record_id",
        "refers_to",
        "target_uri",
        "warc_date",
        "r.content_type",
        "r.block_digest",
        F.octet_length("r.block").cast("long").alias("content_length"),
        "r.block",
    )


def serialised(records: DataFrame) -> DataFrame:
    """(record): head and block of each record, for a text sink whose line ends with two CRLFs."""
    lines = [
        ("WARC-Type", "warc_type"),
        ("WARC-Record-ID", "record_id"),
        ("WARC-Refers-To", "refers_to"),
        ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "warc_date"),
        ("WARC-Block-Digest", "block_digest"),
        ("Content-Type", "content_type"),
        ("Content-Length", "content_length"),
    ]
    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), *(F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF)) for name, c in lines))
    return records.select(F.concat(head, F.lit(CRLF), "block").alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """One gzipped file of records per task."""
    serialised(records).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
