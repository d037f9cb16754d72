"""Interleaved document sequences: HTML with media references, resolved by joins on payload digests."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, tune, written

#: Samples in a row of a stored picture; payloads are filled with zero bytes to whole rows.
ROW = 64
#: Digests that a storing task remembers, and documents on a page of document_pages().
STORED = 100_000
PER_PAGE = 8
_SCHEME = "media:"
_BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "br", "hr", "blockquote", "pre", "figure", "header", "footer", "nav", "main", "aside", "title", "body", "html", "head"}
_SILENT = {"script", "style", "template"}


# Payloads as 8-bit grey pictures (binary PGM)


def to_picture(payload: bytes) -> bytes:
    """The payload, a positive multiple of ROW bytes, as an 8-bit grey picture with one sample a byte."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def from_picture(media: bytes) -> bytes:
    """The samples of such a picture; raises if it is cut short or of another kind."""
    kind, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a whole 8-bit grey picture")
    return samples


def picture_feature(samples: bytes) -> str:
    """Rows, mean, deviation and entropy of the samples, and their histogram in 16 bins."""
    data = np.frombuffer(samples, np.uint8)
    counts = np.bincount(data, minlength=256)
    n, values = len(data), np.arange(256)
    mean = float((counts * values).sum() / n)
    deviation = float(np.sqrt((counts * (values - mean) ** 2).sum() / n))
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    bins = "-".join(map(str, counts.reshape(16, 16).sum(axis=1).tolist()))
    return f"rows={n // ROW};mean={mean:.4f};std={deviation:.4f};bits={entropy:.4f};hist={bins}"


def padded(text: Column) -> Column:
    """UTF-8 bytes of a text (null: empty) filled with zero bytes to a positive multiple of ROW."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    room = F.when(n == 0, F.lit(ROW)).otherwise(F.pmod(-n, F.lit(ROW)))
    return F.concat(raw, F.substring(F.lit(bytes(ROW)), F.lit(1), room))


def store_media(payloads: DataFrame) -> DataFrame:
    """payloads (payload) written as pictures: (digest, media), digest the payload's SHA-256.

    A task stores a payload once, as far as it remembers: STORED digests. Tasks don't know of one
    another, so a payload may be stored by several; readers go by digest. To store it once in all,
    every payload would have to be shuffled. Empty tables give empty stores; payloads are never null
    and have a positive multiple of ROW bytes.
    """
    tune(payloads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored: set[bytes] = set()
        for batch in batches:
            digests, pictures = [], []
            for p in batch.column(0):
                raw = p.as_py()
                digest = hashlib.sha256(raw)
                if digest.digest() in stored:
                    continue
                if len(stored) >= STORED:
                    stored.clear()
                stored.add(digest.digest())
                digests.append(digest.hexdigest())
                pictures.append(to_picture(raw))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(pictures, pa.binary())], ["digest", "media"])

    return written(payloads.select("payload").mapInArrow(run, "digest string, media binary"))


def read_media(store: DataFrame) -> DataFrame:
    """One row per digest of a store: what the stored bytes hold, checked against the digest.

    Raises on a picture cut short or of another digest; an empty store gives no rows.
    """
    tune(store.sparkSession)
    ddl = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                media = media.as_py()
                samples = from_picture(media)
                sha = hashlib.sha256(samples).hexdigest()
                if sha != digest:
                    raise ValueError(f"stored payload {digest} reads back as {sha}")
                rows.append(
                    (digest, len(samples), sha, zlib.crc32(samples[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), picture_feature(samples))
                )
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in ddl.split(", ")]
            )

    read = store.select("digest", "media").mapInArrow(run, ddl)
    return read.groupBy("digest").agg(*[F.first(c).alias(c) for c in read.columns if c != "digest"])


# HTML to sequences


class _Reader(HTMLParser):
    """Collects text runs and media references in the order of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self._text: list[str] = []
        self._caption: list[str] | None = None
        self._figure: list[dict] = []
        self._silent = 0

    def flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text = []
        if text:
            self.items.append({"kind": "text", "text": text})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self._silent += 1
        elif tag == "figcaption":
            self.flush()
            self._caption = []
        elif tag in ("img", "audio", "video", "source"):
            self.flush()
            named = dict(attrs)
            src = named.get("src") or ""
            size = named.get("data-bytes") or ""
            item = {
                "kind": "media", "ref": src.removeprefix(_SCHEME) if src.startswith(_SCHEME) else src,
                "caption": named.get("alt"), "name": named.get("data-name"), "n_bytes": int(size) if size.isdecimal() and len(size) < 19 else None,
            }
            self.items.append(item)
            self._figure.append(item)
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self._figure = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _SILENT:
            self._silent -= 1

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self._silent = max(0, self._silent - 1)
        elif tag == "figcaption" and self._caption is not None:
            caption = " ".join("".join(self._caption).split())
            self._caption = None
            for item in self._figure:  # a caption belongs to the media of its figure
                item["caption"] = caption
        elif tag in _BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self._silent:
            (self._text if self._caption is None else self._caption).append(data)


def parse_page(html: str | None) -> list[dict]:
    """Items of a page in order, with their positions from 0."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    if reader._caption:  # a caption without an end is text
        reader._text += reader._caption
    reader.flush()
    keys = ("kind", "text", "ref", "caption", "name", "n_bytes")
    return [{"pos": k} | {x: item.get(x) for x in keys} for k, item in enumerate(reader.items)]


_ITEM = "struct<pos: int, kind: string, text: string, ref: string, caption: string, name: string, n_bytes: bigint>"


def parse_sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id_col and sequence, the array of text and media items of each page in order.

    A null or empty page has an empty sequence; repeated rows give equal rows; an empty table gives
    none; broken markup is read as far as it goes; other columns are not carried.
    """
    tune(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    item = pa.list_(
        pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string()), ("name", pa.string()), ("n_bytes", pa.int64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_page(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, item)], ["id", "sequence"])

    return (
        pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
        .mapInArrow(run, f"id {kind}, sequence array<{_ITEM}>").withColumnRenamed("id", id_col)
    )


def resolve_sequences(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """One row per item of each sequence, with media's columns for the references it resolves.

    media has one row per digest. Both sides of the join are exchanged by digest alone, so adaptive
    execution can split a digest that many pages refer to. Text items and unresolved references keep
    null columns; position, name and caption stay with their item. A page without items has no rows;
    sequences' own columns must not be called like an item's fields or media's columns.
    """
    item = free_name(sequences, "item")
    items = sequences.select("*", F.explode("sequence").alias(item)).drop("sequence")
    items = items.select(*[c for c in items.columns if c != item], f"{item}.*")
    return items.join(media, items["ref"] == media["digest"], "left").drop("digest")


def interleaved(resolved: DataFrame, id_col: str) -> DataFrame:
    """id_col and items: the rows of resolve_sequences() of each page as one array again, in order of position.

    Texts and media alternate as on the page. A page is one group, as it was one document of HTML; pages
    without an id are one page.
    """
    fields = ["pos", *[c for c in resolved.columns if c not in (id_col, "pos")]]
    return resolved.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))


def _escaped(c: Column) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def document_pages(docs: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """(page, html): pages that show the texts of per_page documents each as pictures, between text.

    Before a picture stands its document's source and after it its language, where docs has such
    columns. The picture is named by doc_id (no name for a null one) and refers to the digest of the
    padded text, so equal texts refer to one payload. Documents are put on pages in the order of
    their rows; only digests and sizes are exchanged. A null text is an empty one; no rows give none.
    """
    kept = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    text = F.col("text")
    index = written(
        docs.select(
            F.col("doc_id").cast("string").alias("name"), *kept, F.sha2(padded(text), 256).alias("digest"),
            F.octet_length(F.coalesce(text, F.lit(""))).alias("size"), F.monotonically_increasing_id().alias("row"),
        )
    )
    part = F.concat(
        F.lit("<section><p>"), _escaped(F.col("source")), F.lit('</p><figure><img src="media:'), F.col("digest"), F.lit('" data-bytes="'), F.col("size").cast("string"),
        F.when(F.col("name").isNotNull(), F.concat(F.lit('" data-name="'), _escaped(F.col("name")))).otherwise(""),
        F.lit('"><figcaption>document '), _escaped(F.col("name")), F.lit("</figcaption></figure><p>"), _escaped(F.col("lang")), F.lit("</p></section>"),
    )
    pages = index.groupBy(F.floor(F.col("row") / per_page).alias("page")).agg(F.array_sort(F.collect_list(F.struct("row", part.alias("part")))).alias("parts"))
    return pages.select("page", F.concat(F.lit("<article>"), F.array_join("parts.part", ""), F.lit("</article>")).alias("html"))


def op8_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored and reread payload of every document, found through the pages that refer to it.

    A null text is an empty one, of 64 zero bytes; a null doc_id is kept; repeated rows give equal
    values; no rows give none.
    """
    docs = table(spark, sf_dir, "documents")
    store = store_media(docs.select(padded(F.col("text")).alias("payload")))
    sequences = parse_sequences(document_pages(docs), "page", "html")
    rows = resolve_sequences(sequences, written(read_media(store))).where(F.col("kind") == "media")
    return rows.select(
        F.col("name").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes",
        "media_sha256", "feature", "page", F.col("pos").alias("position"), "caption",
    )
