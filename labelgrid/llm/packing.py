"""Bounded-space online packing of token sequences into windows of fixed length."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import in_groups, table, tune, written

#: Open windows per partition, and input partitions whose leftovers are merged together.
OPEN_WINDOWS = 16
MERGE_FAN_IN = 8
#: A gap of fewer tokens is padded rather than filled with a cut piece.
LEAST_CUT = 16

_FIELDS = [
    ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("left", pa.bool_()), ("ids", pa.binary()),
]
_DDL = ", ".join(
    f"{n} {'boolean' if t == pa.bool_() else 'binary' if t == pa.binary() else 'long'}" for n, t in _FIELDS
)


class WordIds:
    """Ids of texts by the tokenizers library, with a bounded memory of words already encoded."""

    def __init__(self, text: str, most: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(text)
        # For words that are normalised already: a second normalisation could change them.
        self._words = Tokenizer.from_str(json.dumps(json.loads(text) | {"normalizer": None}))
        for t in (self._tokenizer, self._words):
            t.no_truncation()
            t.no_padding()
        vocab = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self._ends[i] = token.endswith("</w>")
        self._known: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}
        self._most = most

    def _plain(self, text: str, tokenizer=None) -> bytes:
        return np.array((tokenizer or self._tokenizer).encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        runs = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
        found = self._words.encode_batch_fast(runs, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
        cuts = np.flatnonzero(self._ends[ids]) + 1
        if len(cuts) == len(words):
            data, at = ids.tobytes(), 0
            for word, cut in zip(words, (cuts * 4).tolist()):
                self._known[word] = data[at:cut]
                at = cut
        else:
            for word in words:
                self._known[word] = self._plain(word, self._words)

    def _learn_chunks(self, new: list[str]) -> None:
        split = [bpe.split_words(c) for c in new]
        words = {w for ws in split for w in ws}
        if unknown := words.difference(self._known):
            if len(self._known) + len(unknown) > self._most:
                self._known.clear()
                unknown = words
            self._learn(list(unknown))
        known = self._known
        for chunk, ws in zip(new, split):
            self._chunks[chunk] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])

    def many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; words new to all of them are encoded together."""
        parts = [None if "<|" in t else bpe.chunks(t) for t in texts]
        every = set().union(*[p for p in parts if p])
        if new := every.difference(self._chunks):
            if len(self._chunks) + len(new) > self._most:
                self._chunks.clear()
                new = every
            self._learn_chunks(list(new))
        known = self._chunks.__getitem__
        return [self._plain(t) if p is None else b"".join(map(known, p)) for t, p in zip(texts, parts)]


_LOADED: dict[int, WordIds] = {}


def word_ids(text: str) -> WordIds:
    """The encoder of this file, built once in each Python process."""
    key = zlib.crc32(text.encode())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordIds(text)
    return _LOADED[key]


class Window:
    __slots__ = ("free", "pieces")

    def __init__(self, size: int):
        self.free, self.pieces = size, []

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        self.pieces.append((doc, start, ids, total))
        self.free -= len(ids) // 4


class Packer:
    """Keeps a fixed number of open windows; places best-fit; lets the fullest go when none fits."""

    def __init__(self, size: int, windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT):
        self.size, self.windows, self.least_cut = size, windows, least_cut
        self.open: list[Window] = []

    def put(self, doc, ids: bytes) -> Iterator[Window]:
        """Takes a document's ids; yields the windows that this closes."""
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            whole = Window(self.size)
            whole.add(doc, at, ids[4 * at : 4 * (at + self.size)], total)
            at += self.size
            yield whole
        while at < total:
            rest = total - at
            fitting = [w for w in self.open if w.free >= rest]
            if fitting:
                best = min(fitting, key=lambda w: w.free)
                best.add(doc, at, ids[4 * at :], total)
                if not best.free:
                    self.open.remove(best)
                    yield best
                return
            if len(self.open) < self.windows:
                new = Window(self.size)
                new.add(doc, at, ids[4 * at :], total)
                self.open.append(new)
                return
            fullest = min(self.open, key=lambda w: w.free)
            if fullest.free >= self.least_cut:
                cut = at + fullest.free
                fullest.add(doc, at, ids[4 * at : 4 * cut], total)
                at = cut
            self.open.remove(fullest)
            yield fullest


def _rows(window: Window, sequence: int, left: bool, keep_ids: bool) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, total in window.pieces:
        n = len(ids) // 4
        yield doc, start, n, zlib.crc32(ids), total, sequence, offset, left, ids if keep_ids or left else None
        offset += n


def _batch(rows: list[tuple], kind: pa.DataType, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * (1 + len(_FIELDS))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def merge_leftovers(pieces: list[tuple], size: int) -> Iterator[Window]:
    """Full windows of the pieces (doc, start, ids, doc_tokens) in order, then windows of falling powers of two."""
    rest = sum(len(p[2]) // 4 for p in pieces)
    window = None
    for doc, start, ids, total in pieces:
        at = 0
        while at < len(ids) // 4:
            if window is None:
                room = size if rest >= size else 1 << (rest.bit_length() - 1)
                window = Window(room)
            take = min(window.free, len(ids) // 4 - at)
            window.add(doc, start + at, ids[4 * at : 4 * (at + take)], total)
            at += take
            rest -= take
            if not window.free:
                yield window
                window = None


def pack_documents(
    df: DataFrame, id_col: str, text_col: str, size: int = 4096, end_id: int = 2,
    path: str | None = None, keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids.

    Each document is its ids and end_id. Windows fill up inside each input partition; what stays
    open at its end is merged over groups of MERGE_FAN_IN partitions, so no task holds more than a
    constant number of windows. Sequences shorter than size are a power of two, or lack fewer than
    LEAST_CUT tokens. A null text counts as empty, and an empty text gives one piece with end_id
    alone; repeated rows are packed one by one; an empty table gives no rows; other columns of df
    are not carried. size must be a power of two.
    """
    spark = df.sparkSession
    tune(spark)
    source = bpe.broadcast_file(spark, path)
    kind = df.schema[id_col].dataType
    end = int(end_id).to_bytes(4, "little")

    def schema_for(id_type: pa.DataType) -> pa.Schema:
        return pa.schema([("id", id_type), *_FIELDS])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer, closed, out, schema, part = word_ids(source.value), Packer(size), 0, [], None, 0
        for batch in batches:
            schema = schema or schema_for(batch.schema.field(0).type)
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            docs = iter(batch.column(0).to_pylist())
            for group in in_groups([t or "" for t in batch.column(1).to_pylist()]):
                for ids in ids_of.many(group):
                    for window in packer.put(next(docs), ids + end):
                        out += _rows(window, (part << 32) + closed, False, keep_ids)
                        closed += 1
            yield _batch(out, kind, schema)
            out = []
        for k, window in enumerate(packer.open):
            out += _rows(window, (part << 32) + closed + k, True, keep_ids)
        if out:
            yield _batch(out, kind, schema)

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        rows = t.select(["id", "start", "ids", "doc_tokens"]).to_pydict()
        group = (t.column("sequence_id")[0].as_py() >> 32) // MERGE_FAN_IN
        out = []
        for k, window in enumerate(merge_leftovers(list(zip(*rows.values())), size)):
            out += _rows(window, (1 << 62) + (group << 32) + k, False, keep_ids)
        return pa.Table.from_batches([_batch(out, kind, schema_for(t.schema.field("id").type))])

    ddl = f"id {kind.simpleString()}, {_DDL}"
    first = written(
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
        .mapInArrow(pack, ddl)
    )
    done = first.where(~F.col("left"))
    part = F.shiftright(F.col("sequence_id"), 32)
    merged = (
        first.where("left").withColumn("merge_group", F.floor(part / MERGE_FAN_IN))
        .groupBy("merge_group").applyInArrow(merge, ddl)
    )
    out = done.unionByName(merged).drop("left").withColumnRenamed("id", id_col)
    return out if keep_ids else out.drop("ids")


def op6_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most 4096 tokens.

    A null or empty text is its end mark alone; a null doc_id is kept; repeated rows are packed one by one; no rows give none.
    """
    return pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", keep_ids=False)
