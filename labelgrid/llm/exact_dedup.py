"""Exact duplicates: composable polynomial fingerprints, and a comparison chunk by chunk before they are believed.

A normalised text is a polynomial over its bytes, taken at two points modulo the prime 2^61 - 1. The hash of two
texts end to end is the first one's shifted by the second one's length plus the second one's, so the parts of a
huge text are hashed by different tasks and their hashes added up, in any order. Texts of equal length and hashes
are then compared with the one that stays, a chunk at a time, in a stream that holds one chunk. Should one differ,
it and others like it are a group of their own.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import table, tune, written

#: The modulus, and the points at which a text's polynomial is taken.
PRIME = (1 << 61) - 1
POINTS = (0x0B5297A4D3C1E86B, 0x13D9F0C2A7B45E19)
#: Bytes hashed and compared at a time; bytes of a text that one task hashes by itself.
CHUNK, SPAN = 1 << 16, 1 << 20
#: Texts compared with one copy of the text that stays.
MET = 1024

FINGERPRINT = ["n_bytes", "h1", "h2"]
#: A power is held as three numbers of 21 bits, so that sums over a chunk are exact in a float.
_LIMB = 21


@functools.cache
def _powers(points: tuple[int, ...]) -> np.ndarray:
    """Limbs of each point's powers CHUNK - 1 to 0, a column each."""
    out = np.empty((CHUNK, 3 * len(points)))
    for k, x in enumerate(points):
        power = 1
        for i in range(CHUNK - 1, -1, -1):
            out[i, 3 * k : 3 * k + 3] = power & 0x1FFFFF, power >> _LIMB & 0x1FFFFF, power >> 2 * _LIMB
            power = power * x % PRIME
    return out


def shifted(h: tuple[int, ...], n_bytes: int, points: tuple[int, ...] = POINTS) -> tuple[int, ...]:
    """The hash of a text in front of n_bytes more, without theirs."""
    return tuple(a * pow(x, n_bytes, PRIME) % PRIME for a, x in zip(h, points))


def combined(a: tuple[int, ...], b: tuple[int, ...], n_bytes_b: int, points: tuple[int, ...] = POINTS) -> tuple[int, ...]:
    """The hash of two texts end to end, from their hashes and the length of the second."""
    return tuple((x + y) % PRIME for x, y in zip(shifted(a, n_bytes_b, points), b))


def fingerprint(body: bytes, points: tuple[int, ...] = POINTS) -> tuple[int, ...]:
    """The values of the polynomial of these bytes; 0 for no bytes."""
    table, found = _powers(points), (0,) * len(points)

    def hashes(sums: np.ndarray) -> tuple[int, ...]:
        s = [int(x) for x in sums]
        return tuple((s[k] + (s[k + 1] << _LIMB) + (s[k + 2] << 2 * _LIMB)) % PRIME for k in range(0, len(s), 3))

    raw = np.frombuffer(body, np.uint8)
    whole = len(raw) // CHUNK
    for at in range(0, whole, 16):
        chunks = raw[at * CHUNK : min(at + 16, whole) * CHUNK].reshape(-1, CHUNK)
        for sums in chunks.astype(np.float64) @ table:
            found = combined(found, hashes(sums), CHUNK, points)
    rest = raw[whole * CHUNK :]
    if len(rest):
        found = combined(found, hashes(rest.astype(np.float64) @ table[CHUNK - len(rest) :]), len(rest), points)
    return found


def _marked(df: DataFrame, id_col: str, text_col: str, carry: list[str], points: tuple[int, ...]) -> DataFrame:
    """(row, id, own, n_bytes, h1, h2, text_sha256, body), written; hashes are null where body is longer than SPAN.

    row numbers the rows; own holds the columns of carry; body is the text in UTF-8 with A-Z in lower case.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(0)
    given = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), own.alias("own"))
    added = [StructField(c, LongType()) for c in FINGERPRINT]
    schema = StructType([given.schema["id"], given.schema["own"], *added, StructField("text_sha256", StringType()), StructField("body", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [(t.as_py() or "").encode("utf-8", "surrogatepass").lower() for t in batch.column(1)]
            found = [fingerprint(b, points) if len(b) <= SPAN else (None, None) for b in bodies]
            hashes = [pa.array([h[k] for h in found], pa.int64()) for k in range(2)]
            sha = pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string())
            sizes = pa.array(map(len, bodies), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sizes, *hashes, sha, pa.array(bodies, pa.binary())], schema.names)

    return written(given.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def _of_spans(huge: DataFrame, points: tuple[int, ...]) -> DataFrame:
    """(row, h1, h2) of huge bodies: spans are hashed apart, each shifted by what follows it, and added up."""
    last = F.floor((F.col("n_bytes") - 1) / SPAN).cast("int")
    spans = huge.select("row", "n_bytes", "body", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    spans = spans.select("row", "n_bytes", "k", F.substring("body", F.col("k") * SPAN + 1, F.lit(SPAN)).alias("part")).repartition("row", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for n, k, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                raw = part.as_py()
                found.append(shifted(fingerprint(raw, points), n - k * SPAN - len(raw), points))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([h[j] for h in found], pa.int64()) for j in range(2)]], ["row", "h1", "h2"])

    total = lambda c: (F.sum(F.col(c).cast("decimal(38,0)")) % F.lit(PRIME)).cast("long").alias(c)
    return spans.mapInArrow(run, "row long, h1 long, h2 long").groupBy("row").agg(total("h1"), total("h2"))


def _unequal(bodies: DataFrame) -> DataFrame:
    """The rows of bodies (row, leader, n_bytes, n, body) that differ from the body of their leader's row.

    The chunks of a place in a group's bodies meet in one task, at most about MET of them with a copy of the
    leader's, which comes first; the task holds that one chunk.
    """
    parts = F.ceil(F.col("n") / MET).cast("int")
    is_leader = F.col("row") == F.col("leader")
    last = F.floor((F.col("n_bytes") - 1) / CHUNK).cast("int")
    salts = F.when(is_leader, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("row"), parts).cast("int")))
    chunks = bodies.where("n_bytes > 0").select("row", "leader", "body", salts.alias("salts"), F.explode(F.sequence(F.lit(0), last)).alias("k"))
    chunks = chunks.select("row", "leader", "k", F.explode("salts").alias("salt"), F.substring("body", F.col("k") * CHUNK + 1, F.lit(CHUNK)).alias("chunk"))
    cell = ["leader", "k", "salt"]
    dealt = chunks.repartition(*cell).sortWithinPartitions(*cell, (F.col("row") != F.col("leader")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, b""
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            odd = []
            for row, leader, k, salt, chunk in zip(*columns, batch.column(4)):
                if row == leader:
                    now, held = (leader, k, salt), chunk.as_py()
                elif now != (leader, k, salt):
                    raise ValueError(f"no chunk {k} of row {leader} to compare row {row} with")
                elif chunk.as_py() != held:
                    odd.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(odd, pa.int64())], ["row"])

    return dealt.mapInArrow(run, "row long").distinct()


def _leaders(prints: DataFrame, by: list[str]) -> DataFrame:
    """For each group its size n and the row that stays, leader: that of the largest id, of the last row among equals."""
    top = F.max(F.struct("id", "row"))
    return prints.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), top.alias("top")).select(*by, "n", F.col("top.row").alias("leader"), F.col("top.id").alias("keep_id"))


def exact_groups(df: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None, points: tuple[int, ...] = POINTS) -> DataFrame:
    """(id, own, keep_id, group_size, kept, text_sha256) for every row of df; own is a struct of the columns of carry.

    Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. The row with the
    largest id stays; of rows that repeat it one stays. A null id is smaller than any other, so it is a keep_id
    only where its whole group lacks ids. An empty table gives no rows. What is compared is the whole text.
    """
    tune(df.sparkSession)
    marked = _marked(df, id_col, text_col, carry or [], points)
    narrow = ["row", "id", "own", *FINGERPRINT, "text_sha256"]
    long = marked.where("h1 IS NULL")
    summed = long.drop("body", "h1", "h2").join(_of_spans(long, points), "row")
    prints = written(marked.where("h1 IS NOT NULL").select(*narrow).unionByName(summed.select(*narrow)))

    moved: list[DataFrame] = []
    open_rows, groups = prints, None
    while True:
        found = _leaders(open_rows, FINGERPRINT)
        groups = groups or found
        met = open_rows.select("row", *FINGERPRINT).join(found.where("n > 1"), FINGERPRINT).select("row", "leader", "n")
        unequal = written(_unequal(marked.select("row", "n_bytes", "body").join(met, "row")))
        if unequal.isEmpty():
            break
        moved.append(unequal)
        open_rows = written(prints.join(unequal, "row", "left_semi"))
    if moved:
        # A row that differed from the leaders of k rounds is equal to that of the next one.
        rounds = functools.reduce(DataFrame.unionByName, moved).groupBy("row").agg(F.count(F.lit(1)).alias("round"))
        prints = written(prints.join(rounds, "row", "left").withColumn("round", F.coalesce("round", F.lit(0))))
        by = [*FINGERPRINT, "round"]
        groups = _leaders(prints, by)
    else:
        by = FINGERPRINT
    kept = (F.col("row") == F.col("leader")).alias("kept")
    return prints.join(groups, by).select("id", "own", "keep_id", F.col("n").alias("group_size"), kept, "text_sha256")


def drop_exact_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df that stay in exact_groups(), with all columns."""
    found = exact_groups(df, id_col, text_col, df.columns)
    return found.where("kept").select(*[F.col("own").getField(c).alias(c) for c in df.columns])


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document, the size of its group and the digest of its normalised text.

    Null texts are empty ones; a null doc_id is smaller than any other; of rows repeated whole one stays.
    """
    found = exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")
