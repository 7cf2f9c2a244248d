"""WARC archives as Spark text files: writing captures, reading records, assembling transactions.

A capture is three records: a request, a response or a revisit of an equal
payload's response, and metadata; request and metadata name the response in
``WARC-Concurrent-To``. Of captures with equal payloads (by SHA-1), that with the
largest page_id is the response.

Records are strings that Spark's text writer ends with two line breaks, which is
WARC's own layout; files are gzip-compressed as a whole by default. They are read
by Spark's text reader with the version line as separator, so that large plain
archives are split, and a record's parts are cut by their lengths. (The line
breaks before it are no part of the separator: in runs of line breaks the reader
can miss one that begins in the block read before.) A payload that holds the
version is sent in HTTP chunks that break it, so the separator occurs only at the
head of records.

Transactions are assembled by joining requests and metadata to the response
through the concurrent-to identifiers, and revisits to nothing: they carry the
response's HTTP header, digest and identifier.

Defined results: a null payload or URL is empty. Repeated pages are captures of
their own, of which one may be the response. A null page_id is smaller than any
other. Line breaks and the version in an URL are percent-encoded. Other columns are left out. An
empty table makes no record.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.session import shared_folder

VERSION = "WARC/1.1"
BREAK = "\r\n"
END = BREAK * 2
CHUNK = len(VERSION) - 1
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: four times 40 bits as eight digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _identifier(kind: str, page_id: str = "page_id", url: str = "url", copy: Column | None = None) -> Column:
    """A stable UUID of a capture's record, from the capture's columns."""
    copy = F.col("copy") if copy is None else copy
    name = F.md5(F.concat_ws("|", F.coalesce(F.col(page_id).cast("string"), F.lit("-")), url, "digest", copy.cast("string"), F.lit(kind)).cast("binary"))
    return F.regexp_replace(name, "(.{8})(.{4})(.{4})(.{4})(.{12})", "<urn:uuid:$1-$2-$3-$4-$5>")


def _record(kind: str, identifier: Column, block: Column, block_type: str, *headers: tuple[str, Column]) -> Column:
    lines = [F.lit(f"{VERSION}{BREAK}WARC-Type: {kind}{BREAK}WARC-Record-ID: "), identifier, F.lit(f"{BREAK}WARC-Date: {DATE}")]
    for name, value in headers:
        lines += [F.lit(f"{BREAK}{name}: "), value]
    size = F.octet_length(block).cast("string")
    return F.concat(*lines, F.lit(f"{BREAK}Content-Type: {block_type}{BREAK}Content-Length: "), size, F.lit(END), block)


def _captures(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The response of every payload, with its html; and all pages without it, equal rows counted in ``n``."""
    url = F.coalesce("url", F.lit(""))
    for plain, coded in (("\r", "%0D"), ("\n", "%0A"), (VERSION, VERSION.replace(".", "%2E"))):
        url = F.replace(url, F.lit(plain), F.lit(coded))
    filled = pages.select("page_id", url.alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    digest = base32_sha1(F.col("html").cast("binary"))
    filled = filled.withColumns({"digest": digest, "payload_bytes": F.octet_length("html").cast("long")})
    # Equal payloads are combined before the shuffle; one of each remains.
    best = filled.groupBy("digest").agg(F.max(F.struct("page_id", "url", "html")).alias("best"))
    first = best.select("digest", "best.*").withColumn("payload_bytes", F.octet_length("html").cast("long"))
    copies = filled.groupBy("page_id", "url", "digest", "payload_bytes").agg(F.count("*").cast("int").alias("n"))
    return first, copies


def _records(captures: DataFrame, kind: str) -> DataFrame:
    """``captures`` as three records each."""
    http = f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}"
    length = F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string"))
    me, target, digest = _identifier("capture"), ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    if kind == "response":
        chunked = F.concat(F.lit(f"{http}Transfer-Encoding: chunked{END}"), _chunked(F.col("html")))
        block = F.when(F.contains("html", F.lit(VERSION)), chunked).otherwise(F.concat(F.lit(http), length, F.lit(END), "html"))
        main = _record("response", me, block, "application/http;msgtype=response", target, digest)
    else:
        profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        refers = ("WARC-Refers-To", F.col("response_id"))
        main = _record("revisit", me, F.concat(F.lit(http), length, F.lit(END)), "application/http;msgtype=response", target, digest, profile, refers)
    together = ("WARC-Concurrent-To", me)
    get = F.concat(F.lit("GET "), "url", F.lit(f" HTTP/1.1{END}"))
    request = _record("request", _identifier("request"), get, "application/http;msgtype=request", target, together)
    fields = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(BREAK), F.lit("refersToPage: "), F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit(BREAK))
    metadata = _record("metadata", _identifier("metadata"), fields, "application/warc-fields", target, together)
    return captures.select(F.explode(F.array(request, main, metadata)).alias("record"))


def write_archives(pages: DataFrame, path: str, compression: str = "gzip", salts: int = 16) -> None:
    """Write the captures of ``pages`` (page_id, url, html) to a new folder of archives.

    Payloads are shuffled once, after equal ones were combined. Revisits meet
    their response by digest, without payloads, and a popular digest is split
    over ``salts`` tasks.
    """
    first, copies = _captures(pages)
    response = first.withColumn("copy", F.lit(1)).withColumn("refers_to", F.lit(None).cast("long"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt")
    # The same rows as ``first``, found without carrying payloads a second time.
    best = copies.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("best")).select("digest", "best.*")
    known = best.select("digest", F.col("page_id").alias("refers_to"), F.col("url").alias("first_url"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    met = copies.select("*", salt).join(known, ["digest", "salt"])
    own = F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.col("url") == F.col("first_url"))
    from_ = F.when(own, 2).otherwise(1)
    again = met.where(from_ <= F.col("n")).withColumn("copy", F.explode(F.sequence(from_, "n")))
    revisit = again.drop("salt").withColumn("response_id", _identifier("capture", "refers_to", "first_url", F.lit(1)))
    records = _records(response, "response").unionAll(_records(revisit, "revisit"))
    records.write.option("lineSep", END).option("compression", compression).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: record_id, type, target_uri, concurrent_to, refers_to_id, payload_digest, http, payload.

    ``http`` is the HTTP header (or the fields of metadata) and ``payload`` the
    body as bytes, without HTTP chunks.
    """
    schema = T.StructType([T.StructField("value", T.StringType())])
    # An archive holds plain records only; whatever its folder is called, no columns come from it.
    lines = spark.read.schema(schema).option("lineSep", VERSION + BREAK).text(path)
    head = F.substring_index("value", END, 1)
    rows = lines.select("value", head.alias("head"))
    header = lambda name: F.regexp_extract("head", f"(?:^|\\r\\n){name}: ([^\\r\\n]*)", 1)
    data = F.expr("substring(cast(value as binary), octet_length(head) + 5, int(length))")
    rows = rows.withColumn("length", header("Content-Length")).where("length <> ''").withColumn("block", data)
    rows = rows.withColumn("http", F.substring_index(F.col("block").cast("string"), END, 1))
    body = F.expr("substring(block, octet_length(http) + 5)")
    chunked = F.contains("http", F.lit("Transfer-Encoding: chunked"))
    return rows.select(
        header("WARC-Record-ID").alias("record_id"),
        header("WARC-Type").alias("type"),
        header("WARC-Target-URI").alias("target_uri"),
        header("WARC-Concurrent-To").alias("concurrent_to"),
        header("WARC-Refers-To").alias("refers_to_id"),
        F.regexp_extract("head", "(?:^|\\r\\n)WARC-Payload-Digest: sha1:([^\\r\\n]*)", 1).alias("payload_digest"),
        "http",
        F.when(chunked, _unchunked(body)).otherwise(body).alias("payload"),
    )


def _chunked(html: Column) -> Column:
    """The bytes of a text in HTTP chunks of seven, one less than the version line has."""
    data, size = html.cast("binary"), F.octet_length(html)
    part = lambda i: F.substring(data, i * CHUNK + 1, CHUNK)
    whole = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int")), lambda i: F.concat(
        F.octet_length(part(i)).cast("string"), F.lit(BREAK), part(i).cast("string"), F.lit(BREAK)
    ))
    return F.concat(F.array_join(whole, ""), F.lit(f"0{END}"))


def _unchunked(body: Column) -> Column:
    """The bytes that ``_chunked`` made a body of; every chunk but the last has the same length."""
    stride = CHUNK + 5
    last = F.floor((F.octet_length(body) - 6) / stride).cast("int")
    rest = (F.octet_length(body) - 5 - last * stride - 5).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(body, i * stride + 4, F.when(i == last, rest).otherwise(CHUNK)).cast("string"))
    return F.array_join(parts, "").cast("binary")


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response, metadata.

    Sizes and digests are taken from the payloads before the join, so a query
    that asks for nothing else shuffles no payload.
    """
    said = F.regexp_extract("http", "(?:^|\\r\\n)Content-Length: ([0-9]+)", 1).cast("long")
    read = F.col("type") == "response"
    main = records.where("type in ('response', 'revisit')").select(
        F.col("record_id").alias("capture_id"), "type", "target_uri", "refers_to_id", "payload",
        F.when(read, F.octet_length("payload").cast("long")).otherwise(said).alias("payload_bytes"),
        F.when(read, base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )
    request = records.where("type = 'request'").select(F.col("concurrent_to").alias("capture_id"), F.col("record_id").alias("request_id"), F.col("http").alias("request_http"))
    field = lambda name: F.regexp_extract("http", f"(?:^|\\r\\n){name}: ([^\\r\\n]*)", 1)
    metadata = records.where("type = 'metadata'").select(
        F.col("concurrent_to").alias("capture_id"), F.col("record_id").alias("metadata_id"),
        F.nullif(field("pageId"), F.lit("")).cast("long").alias("page_id"),
        F.nullif(field("refersToPage"), F.lit("")).cast("long").alias("refers_to"),
    )
    met = main.join(request, "capture_id").join(metadata, "capture_id")
    return met.select(
        "capture_id",
        F.struct(F.col("request_id").alias("record_id"), F.col("request_http").alias("http")).alias("request"),
        F.struct("type", "target_uri", "refers_to_id", "payload_bytes", "payload_digest", "payload").alias("response"),
        F.struct(F.col("metadata_id").alias("record_id"), "page_id", "refers_to").alias("metadata"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and assemble the captures read back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return captures(read_records(spark, path))
