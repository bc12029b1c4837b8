"""A content-addressed WARC archive: payload bytes stored once by a verified digest, exact record headers apart, records rebuilt by joins.

An archive is a folder with two Parquet tables. `payloads` has each distinct payload once: address (SHA-256) and payload.
`headers` has each record's exact header bytes and the address of its full payload. A record is its header, an empty line, its
block (the payload of a response, nothing for a revisit) and two line ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import materialize, parted

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def base32_sha1(hex_digest: Column) -> Column:
    """RFC 4648 base 32 of a hex SHA-1, as WARC digests are written: each five hex digits (20 bits) give four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def part(i: int) -> list[Column]:
        number = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substring(letters, F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]

    return F.concat(*[letter for i in range(8) for letter in part(i)])


def header_field(header: Column, name: str) -> Column:
    """A field of a header that has been decoded; null if it is missing or empty."""
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: ?([^\r\n]*)\r\n", 1), F.lit(""))


def record_uri(page_id: Column) -> Column:
    """The record's URI; characters that a URI or a header cannot have are escaped."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), F.lit(">"))


def page_of(uri: Column) -> Column:
    """The page id, as text, of a record's URI."""
    return F.url_decode(F.regexp_extract(uri, r"^<urn:page:(.*)>$", 1))


def write_archive(pages: DataFrame, path: str, dedup_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for each row: the payload is the html in UTF-8, and null counts as empty.

    Of rows whose payloads are equal and have dedup_bytes or more, the one with the largest id is a response and the others are
    revisits of it; smaller ones are all responses. Equal means equal SHA-256; rows that share an address but differ in length or
    SHA-1 stop the job. Repeated ids are kept: each row is a record. A null url is written as an empty target, line ends in it as
    spaces. An empty table gives an empty archive. Other columns are not kept. Payloads that occur once are written where they are read;
    only copies meet in a shuffle.
    """
    record = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8").alias("payload"))
    record = record.withColumn("address", F.sha2("payload", 256))
    narrow = materialize(record.select("page_id", "url", "address", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")), "records")
    per = narrow.groupBy("address").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"), F.max("bytes").alias("bytes"), (F.min("sha1") != F.max("sha1")).alias("differ"), (F.min("bytes") != F.max("bytes")).alias("lengths"))
    checked = F.when(F.col("differ") | F.col("lengths"), F.raise_error(F.lit("two payloads share a SHA-256 address"))).otherwise(F.col("address"))
    several = materialize(per.where("n > 1").select(checked.alias("address"), "first_id", "bytes"), "copies")
    some, alone = parted(record.select("address", "payload"), F.col("address"), several, F.col("address"))
    alone.unionByName(some.groupBy("address").agg(F.first("payload").alias("payload"))).write.parquet(f"{path}/payloads")
    joined = narrow.join(several.where(F.col("bytes") >= dedup_bytes).select("address", "first_id"), "address", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_uri(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("sha1"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_uri(F.col("first_id")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("bytes")).cast("string")),
    ]
    joined.select("page_id", "address", F.encode(F.concat(F.concat_ws(END, *lines), F.lit(END)), "UTF-8").alias("header")).write.parquet(f"{path}/headers")


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, address, payload and record of each record: its exact bytes as they stand in a WARC file, and the full payload that it stands for.

    Headers meet their payloads by address. A payload that doesn't hash to its address stops the job.
    """
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))))
    joined = headers.join(payloads.select("address", sound.alias("payload")), "address")
    revisit = F.decode("header", "UTF-8").contains(f"{END}WARC-Type: revisit{END}")
    end = lambda n: F.encode(F.lit(END * n), "UTF-8")
    record = F.concat(F.col("header"), end(1), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), end(2))
    return joined.select("page_id", "header", "address", "payload", record.alias("record"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest (hex SHA-1 of the full payload), refers_to, header and record of each record.

    Everything is read from the rebuilt record: type, target and reference from its header, the block from what follows it. A response's
    payload is its block; a revisit's is that of the response that it refers to, found by their common address. A Content-Length
    that isn't the block's, a digest that isn't the payload's and a revisit without such a response stop the job. An
    archive without records gives an empty table.
    """
    built = records(spark, path)
    page_type = built.schema["page_id"].dataType
    block = F.expr("substring(record, octet_length(header) + 3, octet_length(record) - octet_length(header) - 6)")
    text = built.select("page_id", "address", "payload", "record", "header", F.decode("header", "UTF-8").alias("said"), block.alias("block"))
    kind = header_field(F.col("said"), "WARC-Type")
    full = F.when(kind == "revisit", F.col("payload")).otherwise(F.col("block"))
    sha1 = F.sha1(full)
    length = header_field(F.col("said"), "Content-Length").cast("long")
    wrong = (length != F.octet_length("block")) | (header_field(F.col("said"), "WARC-Payload-Digest") != F.concat(F.lit("sha1:"), base32_sha1(F.col("sha1"))))
    facts = text.select("page_id", "address", "said", "header", "record", "block", kind.alias("record_type"), F.octet_length(full).cast("long").alias("payload_bytes"), sha1.alias("sha1"), page_of(header_field(F.col("said"), "WARC-Refers-To")).cast(page_type).alias("refers_to"))
    digest = F.when(wrong, F.raise_error(F.concat(F.lit("a record's length or digest is not its payload's: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))).otherwise(F.col("sha1"))
    headers = spark.read.parquet(f"{path}/headers")
    responses = headers.where(F.decode("header", "UTF-8").contains(f"{END}WARC-Type: response{END}")).groupBy(F.col("address").alias("a")).agg(F.max("page_id").alias("response"))
    revisits = headers.where(F.decode("header", "UTF-8").contains(f"{END}WARC-Type: revisit{END}")).select("address", page_of(header_field(F.decode("header", "UTF-8"), "WARC-Refers-To")).cast(page_type).alias("target")).distinct()
    lost = revisits.join(responses, F.col("address") == F.col("a"), "left").where(~F.coalesce(F.col("target") == F.col("response"), F.lit(False)))
    if not lost.isEmpty():
        raise ValueError("a revisit refers to no response with its payload")
    return facts.select("page_id", header_field(F.col("said"), "WARC-Target-URI").alias("url"), "record_type", "payload_bytes", digest.alias("payload_digest"), "refers_to", "header", "record")


def archive_path(shared: str) -> str:
    return f"{shared}/archive-{uuid.uuid4().hex}"
