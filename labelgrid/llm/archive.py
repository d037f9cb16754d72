"""Content-addressed WARC archive: payloads once by digest, exact record headers apart, joins to read."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, tune, written

#: Bytes of html for each bucket of stored payloads: a bucket is read by one task.
BUCKET_BYTES = 128 << 20
_CRLF = "\r\n"
_ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base-32 digits."""
    hexed = F.sha1(payload)
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.lpad(F.conv(F.substring(hexed, i * 5 + 1, F.lit(5)), 16, 32), 4, "0"),
    )
    return F.translate(F.concat_ws("", groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def payload_table(pages: DataFrame) -> DataFrame:
    """(digest, payload, owner): each payload once, by SHA-256, with the smallest page_id that has it.

    Copies meet in map-side aggregation first; copies of one digest that differ in length are an
    error. page_id has to be sortable; its nulls own nothing unless all pages with a payload lack it.
    """
    payload = _payload(F.col("html"))
    once = (
        pages.select("page_id", F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
        .groupBy("digest").agg(
            F.min("page_id").alias("owner"), F.first("payload").alias("payload"),
            F.min(F.octet_length("payload")).alias("least"), F.max(F.octet_length("payload")).alias("most"),
        )
    )
    same = F.when(F.col("least") == F.col("most"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payloads of two lengths share the digest "), F.col("digest")))
    )
    return _bucketed(once.select("digest", same.alias("payload"), "owner"), buckets_for(pages))


def buckets_for(pages: DataFrame) -> int:
    """A bucket for each BUCKET_BYTES of html, and no fewer than the session's shuffle partitions."""
    total = pages.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    return max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))


def _bucketed(once: DataFrame, buckets: int) -> DataFrame:
    """once, grouped by digest, written in buckets of digest: a join by digest reads it without an exchange.

    The groups are made in as many partitions as there are buckets, so each bucket is one file. The
    catalogue names the table only while it is opened.
    """
    spark = once.sparkSession
    name, setting = f"payloads_{uuid.uuid4().hex}", "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(buckets))
    try:
        (
            once.write.bucketBy(buckets, "digest").option("compression", "zstd")
            .option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
        )
    finally:
        spark.conf.set(setting, before)
    opened = spark.table(name)
    opened.schema  # resolved: from here on it is its files
    spark.sql(f"DROP TABLE {name}")
    return opened


def _one_line(url: Column) -> Column:
    """A URL whose control characters and spaces are percent-encoded: line ends would end the field."""
    spelt = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"^[\x00-\x20\x7f]$"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), F.array_join(spelt, "")).otherwise(url)


def header_table(pages: DataFrame, payloads: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(page_id, digest, head, own): exact header bytes of each page's record, written.

    own: a response, whose block goes on with the payload. Others are revisits of the owner.
    """
    payload = _payload(F.col("html"))
    index = pages.select(
        "page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"), base32_sha1(payload).alias("sha1"),
        _one_line(F.coalesce("url", F.lit(""))).alias("url"),
    )
    owners = written(payloads.select("digest", "owner"))
    own = F.col("page_id").eqNullSafe(F.col("owner"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
        F.col("size").cast("string"), F.lit(_CRLF * 2),
    )
    length = F.octet_length(http) + F.when(own, F.col("size")).otherwise(0)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1" + _CRLF), F.lit("WARC-Type: "), F.when(own, "response").otherwise("revisit"),
        F.lit(f"{_CRLF}WARC-Record-ID: <{_ID}"), name("page_id"), F.lit(f">{_CRLF}WARC-Date: {date}{_CRLF}WARC-Target-URI: "), F.col("url"),
        F.lit(f"{_CRLF}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(own, "").otherwise(F.concat(F.lit(f"{_CRLF}WARC-Profile: {_PROFILE}{_CRLF}WARC-Refers-To: <{_ID}"), name("owner"), F.lit(">"))),
        F.lit(f"{_CRLF}Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "), length.cast("string"), F.lit(_CRLF * 2), http,
    )
    return written(
        index.join(owners, "digest").select("page_id", "digest", head.cast("binary").alias("head"), own.alias("own"))
    )


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, digest, own, record): the bytes of every original record.

    Only responses meet payloads, one each, so no payload is copied to its revisits. Rows of headers
    that repeat give records that repeat; empty tables give none.
    """
    end = F.lit((_CRLF * 2).encode())
    responses = headers.where("own").join(payloads.select("digest", "payload"), "digest").select(
        "page_id", "digest", "own", F.concat("head", "payload", end).alias("record")
    )
    return responses.unionByName(headers.where("NOT own").select("page_id", "digest", "own", F.concat("head", end).alias("record")))


def payload_of_revisits(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, payload) of every revisit, resolved by its digest; a payload is copied to each revisit of it."""
    return headers.where("NOT own").join(payloads.select("digest", "payload"), "digest").select("page_id", "payload")


def archive_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads), both written, of WARC records that exist: (page_id, record) with the records' exact bytes.

    The head of a record is all before its payload, WARC and HTTP headers alike, and is kept as it is;
    payloads are stored once by their SHA-256. A block that is no HTTP message (warcinfo, metadata, a resource) is a
    payload as a whole. Records without a payload are heads alone. Versions 1.0 and 1.1, names in any case.
    reconstruct() gives equal bytes back. A record that isn't whole raises; null records are left out.
    """
    tune(records.sparkSession)
    kind = records.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, heads, bodies = [], [], []
            for page, record in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = record.as_py()
                if raw is None:
                    continue
                *_, payload = parse_record(raw)
                pages.append(page)
                heads.append(raw[: len(raw) - len(payload) - 4])
                bodies.append(payload)
            yield pa.RecordBatch.from_arrays([pa.array(pages, batch.schema.field(0).type), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], ["page_id", "head", "payload"])

    # `own` here: the record carries its payload, as each of these did.
    split = written(
        records.select("page_id", "record").mapInArrow(run, f"page_id {kind}, head binary, payload binary")
        .withColumn("digest", F.sha2("payload", 256)).withColumn("own", F.octet_length("payload") > 0)
    )
    payloads = split.where("own").groupBy("digest").agg(F.first("payload").alias("payload"), F.min("page_id").alias("owner"))
    return split.select("page_id", "digest", "head", "own"), written(payloads)


def _fields(lines: list[str]) -> dict[str, str]:
    """Header lines as a map by lower-cased name; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of the bytes of a record of version 1.0 or 1.1; raises if they don't agree.

    Fields are named in lower case. The payload of an HTTP message, by its content type or, without one, by how it begins, is its body; of any other block, such as warcinfo or
    metadata, it is the block, without HTTP fields.
    """
    head, _, block = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogateescape").split(_CRLF)
    fields = _fields(lines)
    if version.strip() not in ("WARC/1.0", "WARC/1.1") or not fields.get("content-length", "").isdigit():
        raise ValueError("not a whole WARC record")
    size = int(fields["content-length"])
    if block[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    block = block[:size]
    http, blank, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("content-type", "").lower()
    if not blank or not (kind.startswith("application/http") if kind else block.startswith(b"HTTP/")):
        return fields, {}, block
    return fields, _fields(http.decode("utf-8", "surrogateescape").split(_CRLF)[1:]), payload


def read_records(records: DataFrame) -> DataFrame:
    """What each record of reconstruct() says: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's size and SHA-1 are those of the payload read back, and have to equal its header's; its
    SHA-256 has to be the key it was stored by. A revisit's size and SHA-1 have to equal those of the
    response that holds its payload. Raises where they don't; an empty table gives no rows.
    """
    tune(records.sparkSession)
    kind = records.schema["page_id"].dataType.simpleString()

    def bare(name: str) -> str:
        return name[1 + len(_ID) : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, key, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                fields, http, payload = parse_record(record.as_py())
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                size = int(http["content-length"])
                if bare(fields["warc-record-id"]) != ("" if page is None else str(page)):
                    raise ValueError(f"the record of page {page} names another")
                if fields["warc-type"] == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if (found, len(payload)) != (digest, size):
                        raise ValueError(f"the payload of page {page} differs from its header")
                    if hashlib.sha256(payload).hexdigest() != key:
                        raise ValueError(f"the payload of page {page} differs from its key {key}")
                refers = fields.get("warc-refers-to")
                rows.append((size, digest, fields["warc-type"], bare(refers) if refers else None))
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                ["page_id", "digest", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    out = written(records.select("page_id", "digest", "record").mapInArrow(
        run, f"page_id {kind}, digest string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    ))
    # Repeats of the page that owns a payload are all responses and agree: each was checked by itself.
    held = out.where("record_type = 'response'").groupBy("digest").agg(
        F.min("payload_bytes").alias("held_bytes"), F.min("payload_digest").alias("held_digest")
    )
    met = out.join(held, "digest", "left")
    right = (F.col("record_type") == "response") | (
        F.col("payload_bytes").eqNullSafe(F.col("held_bytes")) & F.col("payload_digest").eqNullSafe(F.col("held_digest"))
    )
    said = F.when(right, F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("the revisit of digest "), F.col("digest"), F.lit(" differs from the payload held")))
    )
    refers = F.when(F.col("refers_to") != "", F.col("refers_to")).cast(kind)
    return met.select("page_id", "payload_bytes", said.alias("payload_digest"), "record_type", refers.alias("refers_to"))


def archive_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of pages (page_id, url, html), both written.

    A null html counts as empty; an empty payload is a payload like any other; rows repeated whole
    with the smallest page_id of their payload are all responses; an empty table gives empty tables;
    other columns are not archived.
    """
    payloads = payload_table(pages)
    return header_table(pages, payloads), payloads


def op9_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archive's records say of every page, read back.

    A null html is an empty payload, which is one like any other; a null page_id owns a payload only
    if all its pages lack one; rows repeated whole with the smallest page_id are all responses; no
    rows give none.
    """
    headers, payloads = archive_pages(table(spark, sf_dir, "pages"))
    return read_records(reconstruct(headers, payloads))
