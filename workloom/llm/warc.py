"""A content-addressed web archive: each payload is stored once, under a strong digest, and the exact headers of every record apart.

``write`` makes a WARC record of every page and puts it into a folder as two tables. ``payloads`` has the bytes of each distinct
payload under their SHA-256; ``records`` has the bytes of each record up to its payload (the WARC fields and the HTTP header) and
the digest of what follows. ``records`` and ``pages`` put the original records and pages together again by joining the two on the
digest. ``export`` writes the records as plain WARC files, and ``read_warc`` reads such files, compressed or not, from anywhere.

Of records with equal payloads of at least ``least`` bytes the one of the largest page_id is a response; the others are revisits
that refer to it and carry no payload. Smaller payloads are all responses, and still stored once.

Digests are verified. Where a payload occurs more than once its bytes are compared, so two payloads with one digest stop the
write; and every payload that is read is digested again, so a damaged one stops the read.

What is shuffled by the write is narrow (digests, addresses, headers); payloads move only where a digest occurs more than once,
one for each task and digest. Digests that occur more than once are broadcast if they are ``BROADCAST_ROWS`` at most, by count, and
joined by a shuffle otherwise. A small payload that very many records share is dealt to as many tasks as it takes.

Defined results
    null html: an empty payload, like an empty text. null page_id: the smallest of all; such records carry no Page-ID, and refer to none if
    none of them has one. null url: urn:page: with the page_id. White space and control characters in a url are written as %20.
    Equal page_ids with equal payloads: the largest url, and of equal rows the first copy, is the response. Very long texts:
    whole. Empty table: an empty archive. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from workloom.llm.mixing import _dealt
from workloom.llm.runtime import materialize, scratch, small_batches

#: Payloads of fewer bytes are never revisited.
LEAST = 1000
#: Digests that may be broadcast (about 200 bytes each), and records that one task joins to a payload that they share.
BROADCAST_ROWS, SHARE = 200_000, 50_000
#: The formats that the records follow.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def _raised(ok: Column, value: Column, message: str) -> Column:
    """The value where ok; anything else ends the job."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("binary"))


def _small(rows: DataFrame) -> DataFrame:
    """A materialized frame, marked for broadcast if it has few rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def _digest(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def _uuid(*parts: Column) -> Column:
    """A name that follows from what is named, so that writing again gives the same bytes."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A field; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _name(page_id: Column, url: Column, digest: Column, copy: Column) -> Column:
    return _uuid(F.coalesce(page_id.cast("string"), F.lit("null")), F.coalesce(url, F.lit("null")), F.hex(digest), copy.cast("string"))


def _address(page_id: Column, url: Column) -> Column:
    return F.coalesce(F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))


def _head(date: str) -> Column:
    """The bytes of a record before its payload, as text, from the columns of ``_judged``."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), _line("Content-Length", F.col("bytes").cast("string")), F.lit(END)
    )
    again = F.col("first").isNotNull()
    kind = F.when(again, "revisit").otherwise("response")
    first = F.col("first")
    fields = [
        F.lit(VERSION + END),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _name(F.col("page_id"), F.col("url"), F.col("digest"), F.col("_copy"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _address(F.col("page_id"), F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", F.when(again, PROFILE)),
        _line("WARC-Refers-To", F.when(again, _name(first["page_id"], first["url"], F.col("digest"), F.lit(0)))),
        _line("WARC-Refers-To-Target-URI", F.when(again, _address(first["page_id"], first["url"]))),
        _line("Page-ID", F.col("page_id").cast("string")),
        _line("Refers-To-Page-ID", F.when(again, first["page_id"].cast("string"))),
        _line("Content-Type", F.concat(F.lit("application/http; msgtype="), F.lit("response"))),
        _line("Content-Length", (F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit(END),
    ]
    return F.concat(*fields, http)


def write(pages: DataFrame, folder: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives pages (page_id, url, html) in the folder; ``date`` is what the records say of their time."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("payload"))
    facts = src.select("page_id", "url", _digest(F.col("payload")).alias("digest"), F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("bytes"))
    rows = materialize(_dealt(facts, facts.columns))
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("best"), F.max("bytes").alias("_bytes"))
    # a payload of some length has one response, so only small ones meet many records
    slices = F.when(F.col("_bytes") < least, F.ceil(F.col("n") / SHARE)).otherwise(1).cast("int")
    shared = _small(materialize(groups.filter("n > 1").select("digest", "best", slices.alias("slices"))))

    own = src.select(_digest(F.col("payload")).alias("digest"), "payload")
    alone = own.join(shared.select("digest"), "digest", "left_anti").withColumn("slices", F.lit(1))
    many = own.join(shared.select("digest", "slices"), "digest").groupBy("digest").agg(F.min("payload").alias("payload"), F.max("payload").alias("_other"), F.max("slices").alias("slices"))
    same = _raised(F.col("payload") == F.col("_other"), F.col("payload"), "two payloads have one digest")
    alone.unionByName(many.select("digest", same.alias("payload"), "slices")).write.parquet(f"{folder}/payloads")

    judged = rows.join(shared, "digest", "left")
    is_first = F.struct("page_id", "url").eqNullSafe(F.col("best")) & (F.col("_copy") == 0)
    judged = judged.withColumn("first", F.when(F.col("best").isNotNull() & (F.col("bytes") >= least) & ~is_first, F.col("best")))
    judged.select("digest", F.coalesce("slices", F.lit(1)).alias("slices"), _head(date).alias("head")).write.parquet(f"{folder}/records")


def field(head: Column, name: str) -> Column:
    """A field of a record's WARC header; null if there is none."""
    warc = F.substring_index(head, END + END, 1)
    return F.nullif(F.regexp_extract(warc, rf"\r\n{re.escape(name)}: ([^\r\n]*)", 1), F.lit(""))


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """digest, payload, slices; the bytes are digested again and held against the digest that they are stored under."""
    rows = spark.read.schema("digest binary, payload binary, slices int").parquet(f"{folder}/payloads")
    return rows.withColumn("payload", _raised(_digest(F.col("payload")) == F.col("digest"), F.col("payload"), "a stored payload is damaged"))


def _heads(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema("digest binary, slices int, head string").parquet(f"{folder}/records")
    return rows.withColumn("type", field(F.col("head"), "WARC-Type"))


def _with_payload(heads: DataFrame, stored: DataFrame) -> DataFrame:
    """Each head with its payload. A payload that many share is there once for each slice of them."""
    dealt = heads.withColumn("_slice", F.pmod(F.xxhash64("head"), F.col("slices")).cast("int"))
    slices = stored.select("digest", "payload", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("_slice"))
    return dealt.join(slices, ["digest", "_slice"]).drop("_slice", "slices")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The original records: digest, type, head and payload. A revisit has no payload; ``record_bytes`` gives the whole record."""
    heads = _heads(spark, folder)
    responses = _with_payload(heads.filter("type = 'response'"), _stored(spark, folder))
    revisits = heads.filter("type = 'revisit'").drop("slices").withColumn("payload", F.lit(None).cast("binary"))
    return responses.unionByName(revisits)


def record_bytes() -> Column:
    """A record of ``records`` as it stands in a WARC file."""
    return F.concat(F.col("head").cast("binary"), F.coalesce("payload", F.lit(b"")), F.lit((END + END).encode()))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """page_id and html of every record, revisits too."""
    heads = _heads(spark, folder)
    # here revisits meet their payload as well, so groups of them are dealt out by what was counted of each digest
    counted = heads.groupBy("digest").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("slices"))
    many = _small(materialize(counted.filter("slices > 1")))
    spread = heads.drop("slices").join(many, "digest", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    stored = _stored(spark, folder).drop("slices").join(many, "digest", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    found = _with_payload(spread, stored)
    return found.select(field(F.col("head"), "Page-ID").cast("long").alias("page_id"), F.col("payload").cast("string").alias("html"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from the records as read back.

    Length and digest are those of the bytes that the joins give: of its own payload for a response, of the response's for a revisit.
    """
    read = records(spark, folder)
    own = read.filter("type = 'response'").select("digest", "head", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    said = F.concat(F.lit("sha1:"), F.col("payload_digest")) == field(F.col("head"), "WARC-Payload-Digest")
    checked = materialize(own.withColumn("payload_digest", F.when(said, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record and its payload differ")))))
    again = _heads(spark, folder).filter("type = 'revisit'").withColumn("_refers", field(F.col("head"), "WARC-Refers-To"))
    wanted = _small(materialize(again.select(F.col("_refers").alias("_name")).distinct()))
    first = checked.withColumn("_name", field(F.col("head"), "WARC-Record-ID")).join(wanted, "_name").select("_name", "payload_bytes", "payload_digest")
    visits = again.join(_small(materialize(first)), F.col("_refers") == F.col("_name"), "left")
    result = lambda rows, kind: rows.select(
        field(F.col("head"), "Page-ID").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.lit(kind).alias("record_type"),
        field(F.col("head"), "Refers-To-Page-ID").cast("long").alias("refers_to"),
    )
    return result(checked, "response").unionByName(result(visits, "revisit"))


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archives pages in a folder that all executors share and lists the records that are read back."""
    folder = scratch(pages.sparkSession)
    write(pages, folder, least)
    return listed(pages.sparkSession, folder)


def export(spark: SparkSession, folder: str, path: str, per_file: int = 10_000, compression: str = "none") -> None:
    """The records as WARC files, in UTF-8: what ends a record in the file is what ends a line of Spark's text writer."""
    text = F.concat(F.col("head"), F.coalesce(F.col("payload").cast("string"), F.lit("")))
    writer = records(spark, folder).select(text.alias("value")).write.option("lineSep", END + END).option("maxRecordsPerFile", per_file)
    writer.option("compression", compression).text(path)


def _members(content: bytes) -> bytes:
    """The bytes of a file of any number of gzip members, or of one that isn't compressed."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(parts)


def split(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (by name as written) and block of each record of a WARC file. Content-Length alone tells where a block ends."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = next(int(v) for k, v in fields.items() if k.lower() == "content-length")
        yield fields, content[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """fields (a map) and block (bytes) of the records of WARC files, gzip members or not. A file, 2 GB at most, is read by one task."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                fields, blocks, held = [], [], 0
                for f, block in split(_members(content.as_py())):
                    fields.append(list(f.items()))
                    blocks.append(block)
                    held += len(block)
                    if held > 8 << 20:
                        yield _batch(fields, blocks)
                        fields, blocks, held = [], [], 0
                if blocks:
                    yield _batch(fields, blocks)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(parse, "fields map<string,string>, block binary")


def _batch(fields: list, blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(fields, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary())], ["fields", "block"])


#: DuckDB SQL for the query's rows.
ORACLE_SQL = f"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, html FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY html) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place > 1 AND payload_bytes >= {LEAST} THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN place > 1 AND payload_bytes >= {LEAST} THEN first END AS refers_to FROM r
"""
