"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records put together by joins.

An archive is a folder with two tables. ``payloads`` has a row per distinct payload under its SHA-256, checked against length and
SHA-1 before it is written and after it is read. ``records`` has the exact bytes of each record's WARC and HTTP headers and the
digest. ``restore`` joins the two; the bytes of a record are then its headers, its payload (none in a revisit) and two line ends.

Defined results: a null html or url counts as empty; of records with equal payloads that with the smallest page_id is the
response (all of them, if rows repeat that id; a null id counts as largest), payloads smaller than ``least`` are always
responses; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.plans import storage

#: The base32 alphabet of RFC 4648, a fixed value.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal digest whose length is a multiple of five digits: four letters for each five digits."""
    letter = lambda v, k: F.substring(F.lit(BASE32), F.shiftright(v, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    value = lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(digest) / 5 - 1).cast("int")), lambda i: F.concat(*[letter(value(i), k) for k in range(4)])), "")


def build(pages: DataFrame, least: int = 0) -> DataFrame:
    """A row per page: page_id, record_type, refers_to, header (exact bytes before the payload), digest, payload, size and sha1."""
    base = pages.select("page_id", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\r\\n]", "").alias("uri"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    base = base.select("*", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    return base.select("*", F.lit(least).alias("least"))


def headers(kind: Column, page: Column, uri: Column, sha32: Column, size: Column, first: Column) -> Column:
    """The exact text before the payload of a response, or of the whole of a revisit."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size.cast("string"), F.lit(END + END))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    block = F.char_length(http) + F.when(kind == "response", size).otherwise(F.lit(0))
    revisit = F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}WARC-Refers-To: "), urn(first), F.lit(END))
    return F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), kind, F.lit(f"{END}WARC-Record-ID: "), urn(page), F.lit(f"{END}WARC-Date: {DATE}{END}WARC-Target-URI: "), uri,
        F.lit(f"{END}WARC-Payload-Digest: sha1:"), sha32, F.lit(END), F.when(kind == "revisit", revisit).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{END}Content-Length: "), block.cast("string"), F.lit(END + END), http,
    )


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write the archive of pages to a new folder. Only digests and ids are shuffled for the records; payloads once each."""
    rows = build(pages, least)
    owners = rows.groupBy("digest").agg(F.min("page_id").alias("first"))
    rows.groupBy("digest").agg(F.any_value("payload").alias("payload"), F.any_value("sha1").alias("sha1"), F.any_value("size").alias("size")).select(
        "digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its digest"))).alias("payload"), "sha1", "size",
    ).write.option("compression", "zstd").parquet(f"{path}/payloads")
    marked = rows.drop("payload").join(owners, "digest").withColumn("kind", F.when((F.col("size") < F.col("least")) | F.col("page_id").eqNullSafe(F.col("first")), "response").otherwise("revisit"))
    marked.select(
        "page_id", "digest", headers(F.col("kind"), F.col("page_id"), F.col("uri"), base32_of_hex(F.col("sha1")), F.col("size"), F.col("first")).alias("header"),
    ).write.option("compression", "zstd").parquet(f"{path}/records")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """Records read back: page_id, header, payload (of revisits too, from the response) and record (the exact bytes of the WARC record)."""
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", "payload", F.col("size").alias("stored_size"))
    whole = F.when((F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("stored_size")), F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its digest")))
    joined = spark.read.parquet(f"{path}/records").join(payloads.select("digest", whole.alias("payload")), "digest")
    body = F.when(field("WARC-Type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return joined.select("page_id", "header", "payload", F.concat(F.encode("header", "UTF-8"), body, F.encode(F.lit(END + END), "UTF-8")).alias("record"))


def field(name: str, of: str = "header") -> Column:
    """A named field of a column of headers."""
    return F.regexp_extract(F.concat(F.lit(END), of, F.lit(END)), f"\\r\\n{name}: ([^\\r]*)", 1)


def _cut(bytes_: str, head: str) -> Column:
    """What follows the column head and an empty line in a column of bytes."""
    return F.substring(bytes_, F.octet_length(head) + len(END + END) + 1, F.octet_length(bytes_))


def describe(restored: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, parsed from the bytes of each restored record.

    A record is its WARC headers, an empty line, a block and two line ends; the block is the HTTP headers, an empty line and the body.
    Lengths of block and body and the body's digest must be those that the headers state; a revisit has no body, and its payload,
    which the join brought, must be what its headers state.
    """
    head = lambda c: F.substring_index(F.col(c).cast("string"), END + END, 1)
    one = restored.select("page_id", "record", "payload", head("record").alias("warc"))
    two = one.select("page_id", "payload", "warc", _cut("record", "warc").alias("rest"))
    two = two.select("page_id", "payload", "warc", F.substring("rest", F.lit(1), F.octet_length("rest") - len(END + END)).alias("block"), F.substring("rest", F.octet_length("rest") - len(END + END) + 1, F.lit(len(END + END))).alias("end"))
    three = two.select("*", head("block").alias("http"), field("WARC-Type", "warc").alias("record_type"))
    four = three.select("*", _cut("block", "http").alias("body"), field("Content-Length", "http").cast("long").alias("size"))
    whole = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.col("body"))
    five = four.select("page_id", "warc", "record_type", "size", whole.alias("whole"), (
        (field("Content-Length", "warc").cast("long") == F.octet_length("block")) & (F.col("end") == F.encode(F.lit(END + END), "UTF-8"))
        & (F.octet_length("body") == F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("size")))
    ).alias("framed"))
    six = five.select("*", base32_of_hex(F.sha1("whole")).alias("digest"))
    right = F.col("framed") & (F.octet_length("whole") == F.col("size")) & (F.concat(F.lit("sha1:"), F.col("digest")) == field("WARC-Payload-Digest", "warc"))
    checked = F.when(right, F.col("digest")).otherwise(F.raise_error(F.lit("the record is not what its headers state")))
    return six.select(
        "page_id", F.col("size").alias("payload_bytes"), checked.alias("payload_digest"), "record_type",
        F.nullif(F.regexp_extract(field("WARC-Refers-To", "warc"), "x-page:(-?\\d+)", 1), F.lit("")).cast("long").alias("refers_to"),
    )


def roundtrip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write an archive of pages to the shared folder and describe what is read back."""
    spark = pages.sparkSession
    path = storage.new_path(spark, "warc")
    write(pages, path, least)
    return describe(restore(spark, path))
