"""SimHash near-duplicates: a binary trie of fingerprints joined with itself.

Only different fingerprints enter the trie (trie.py), so copies cost nothing, and tasks return links
that join what was not yet joined, never all pairs. Two forms: near_duplicate_components() links
64-bit fingerprints within a few bits; similar_components() spreads the trie of a long fingerprint over
cells of least hashes, some of which any two texts as similar as asked have in common, however many
texts there are, and checks what meets on whole shingle sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trie
from .common import free_name, table, tune, written
from .components import connected_components

BITS = 64
#: Bits of a long fingerprint, and of what is checked behind a trie's 64 bits when links are first looked for.
LONG, CHECK = 512, 128
#: Least hashes of a shingle set; how many make the key of a cell and how many cells a text is in, at first and
#: in place of cells of more than CELL texts.
LEAST, BANDS, CELL = 64, ((3, 10), (6, 32)), 1 << 12
#: Rounds in which torn components are joined by single links before all their pairs are compared.
ROUNDS = 3


def _shingle_hashes(text: str | None, width: int, seed: int) -> Iterator[bytes]:
    """XXH64 digests, big-endian and end to end, of the shingles of width words (A-Z in lower case), some at a time.

    A text of fewer words is one shingle; a text without words has none.
    """
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if n <= width:
        yield digest(joined, seed)
        return
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends[width - 1 :].tolist()
    for at in range(0, len(ends), 1 << 16):
        yield b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])])


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over shingles of width words, repeats included; 0 for a text without words."""
    counts, n = np.zeros(BITS, np.int64), 0
    for raw in _shingle_hashes(text, width, seed):
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def with_fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    tune(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _pairs(rows: dict[str, np.ndarray], found, name: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Batches (u, v) of the column name at the pairs of rows found."""
    for i, j in found:
        yield pa.RecordBatch.from_arrays([pa.array(rows[name][i], kind), pa.array(rows[name][j], kind)], ["u", "v"])


def fingerprint_links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(u, v): links whose components are those of all pairs of fp within max_bits differing bits.

    fps holds different fingerprints fp, signed longs without nulls; an empty table gives no links.
    """
    tune(fps.sparkSession)

    def links(rows: DataFrame, width: int) -> DataFrame:
        def key(rows):
            return rows["rest"].view(np.uint64) << np.uint64(BITS - width)

        def found(rows, keys, bounds):
            fp = rows["fp"].view(np.uint64)
            near = lambda i, j: np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
            yield from _pairs(rows, trie.walk(keys, bounds, width, [max_bits] * (width + 1), near), "fp", pa.int64())

        return trie.over_cells(rows.drop("id"), key, found, "u long, v long")

    whole = fps.select(F.lit(0).cast("long").alias("cell"), F.col("fp").alias("rest"), "fp", F.col("fp").alias("id"))
    return functools.reduce(DataFrame.unionByName, [links(*part) for part in trie.in_cells(whole, BITS, max_bits)])


def near_duplicate_components(df: DataFrame, id_col: str, text_col: str, max_bits: int = 3) -> DataFrame:
    """(id, fp, component_id): the smallest id among the documents whose fingerprints are linked.

    Null and empty texts have fingerprint zero and are linked like any other; a null id is not a
    candidate for component_id but gets its component's; repeated rows are kept, one row each; an
    empty table gives no rows; other columns of df are not carried.
    """
    rows = written(with_fingerprints(df, id_col, text_col))
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("least")))
    labels = written(connected_components(fingerprint_links(nodes.select("fp"), max_bits)))
    own = nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = written(own.join(least, "component").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select("id", "fp", "component_id")


# By similarity


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted different 64-bit hashes of the shingles of width words; a shorter text is one, a blank one none."""
    return np.unique(np.frombuffer(b"".join(_shingle_hashes(text, width, 42)), ">u8").astype(np.uint64))


_ODD = np.random.default_rng(5).integers(0, 2**64, LONG // 64, np.uint64) | np.uint64(1)


def long_fingerprint(found: np.ndarray) -> bytes:
    """LONG-bit SimHash of a set of hashes: each is stretched to LONG bits, a bit is 1 if set in over half."""
    counts = np.zeros(LONG, np.int64)
    for at in range(0, len(found), 255):  # sums of 255 bits fit a byte
        x = found[at : at + 255, None] * _ODD
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        counts += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(found)).tobytes()


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of the SimHashes of two sets of one size and this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _bound(bits: int, similarity: float, deviations: float = 4.0) -> int:
    """Differing bits among bits that only one in some 30,000 pairs of this similarity exceeds (3.1 deviations: one in 1,000)."""
    p = differing_share(similarity)
    return min(bits, math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p))))


def _node(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


_FACTORS = np.random.default_rng(7).integers(0, 2**64, LEAST, np.uint64) | np.uint64(1)


def least_hashes(found: np.ndarray) -> np.ndarray:
    """The least of LEAST different 32-bit hashes over a set; each is shared by two sets in as many cases as their similarity says."""
    least = np.full(LEAST, 2**32 - 1, np.uint32)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, ((found[at : at + 4096, None] * _FACTORS) >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return least


def bands(level: int) -> np.ndarray:
    """Which least hashes make each cell's key: rows of places."""
    size, n = BANDS[level]
    if size * n <= LEAST:
        return np.arange(size * n).reshape(n, size)
    return np.argsort(np.random.default_rng(level).random((n, LEAST)), axis=1)[:, :size]


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc, node, bits, least): node is a digest of the shingle set, so equal sets are one node; bits its long fingerprint, least its least hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch.column(1)]
            made = [map(f, sets) for f in (_node, long_fingerprint, lambda x: least_hashes(x).tobytes())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.binary()) for x in made]], ["doc", "node", "bits", "least"])

    return docs.select(F.col("doc_id").alias("doc"), "text").mapInArrow(run, f"doc {kind}, node binary, bits binary, least binary")


def _in_bands(nodes: DataFrame, level: int, turn: int, check: int) -> DataFrame:
    """A row for each cell of a node: cell, id, key (64 bits of its fingerprint), c0 … (the next check bits), and label, if there is one.

    turn says at which word of the fingerprint its 64 bits begin.
    """
    places = bands(level)
    n_words = 1 + check // 64
    kept = ["id", *[c for c in ("label",) if c in nodes.columns]]
    names = ["cell", "key", *[f"c{k}" for k in range(n_words - 1)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            words = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").reshape(n, -1).astype(np.uint64).view(np.int64)
            words = [pa.array(np.ascontiguousarray(words[:, (turn + k) % words.shape[1]])) for k in range(n_words)]
            least = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, LEAST).astype(np.uint64)
            for t, at in enumerate(places):
                cell = np.full(n, level << 32 | t, np.uint64)
                for k in at:
                    cell = (cell ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                    cell ^= cell >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), *words, *batch.columns[2:]], [*names, *kept])

    ddl = ", ".join(f"{c} long" for c in (*names, *kept))
    return nodes.select("bits", "least", *kept).mapInArrow(run, ddl)


def _too_large(rows: DataFrame) -> DataFrame:
    """(cell, n, heavy): cells of more than CELL rows; heavy is the label that most of them have, if there are labels."""
    if "label" not in rows.columns:
        return rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    most = rows.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("cell")
    return most.agg(F.sum("k").alias("n"), F.max_by("label", "k").alias("heavy"), F.max("k").alias("k")).where(F.col("n") > CELL)


def _parted(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows of too large cells in cells of about CELL.

    Without labels each row goes to one part. With labels those of a cell's most frequent label go to one part
    each, and the others, which may be linked with any, to all parts; should they be many too, to pairs of parts.
    A cell of one label has nothing to link.
    """
    parts = F.ceil(F.col("n") / (CELL // 2)).cast("int")
    met = rows.join(hot, "cell").withColumn("own", F.pmod(F.xxhash64("id"), parts).cast("int"))
    if "label" not in rows.columns:
        return met.select(F.xxhash64("cell", "own").alias("cell"), *[c for c in rows.columns if c != "cell"])
    light = F.col("label") != F.col("heavy")
    few = F.col("n") - F.col("k") <= CELL // 2
    every = F.sequence(F.lit(0), parts - 1)
    met = met.where(F.col("k") < F.col("n")).withColumn("other", F.explode(F.when(few & ~light, F.array("own")).otherwise(every)))
    pair = F.when(few, F.array(F.col("other"), F.col("other"))).otherwise(F.array(F.least("own", "other"), F.greatest("own", "other")))
    return met.select(F.xxhash64("cell", pair).alias("cell"), *[c for c in rows.columns if c != "cell"])


def _walked(rows: DataFrame, similarity: float, check: int, deviations: float, all_pairs: bool) -> DataFrame:
    """(u, v) of ids in a cell whose keys stay within what texts of this similarity differ in, on the way down and in the bits behind."""
    most = _bound(check, similarity, deviations)
    budgets = [_bound(k, similarity) for k in range(65)]
    labelled = "label" in rows.columns

    def found(rows, keys, bounds):
        checked = [rows[f"c{k}"].view(np.uint64) for k in range(check // 64)]
        near = lambda i, j: sum(np.bitwise_count(c[i] ^ c[j]).astype(np.int16) for c in checked) <= most
        yield from _pairs(rows, trie.walk(keys, bounds, 64, budgets, near, rows["label"] if labelled else None, all_pairs), "id", pa.int64())

    return trie.over_cells(rows, lambda rows: rows["key"].view(np.uint64), found, "u long, v long")


def candidate_links(nodes: DataFrame, similarity: float, turn: int = 0, all_pairs: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(u, v) of ids of nodes (id, bits, least) that meet in a cell and come close there; and what was left out.

    As many links as join the same components, of unlike labels if there is a column label; with all_pairs all pairs of unlike
    labels. A node is in a fixed number of cells, whatever their number; nodes of too large cells are in
    others of more hashes too. What is too large then is cut to parts; without labels rows of different parts don't meet,
    and those cells come second, (cell, id), for a call with labels.
    """
    labelled = "label" in nodes.columns
    check, deviations = (LONG - 64, 3.1) if labelled else (CHECK, 4.0)
    rows = _in_bands(nodes, 0, turn, check)
    hot = written(_too_large(rows))
    links = [_walked(rows.join(hot.select("cell"), "cell", "left_anti"), similarity, check, deviations, all_pairs)]
    left = None
    if not hot.isEmpty():
        again = nodes.join(written(rows.join(hot.select("cell"), "cell", "left_semi").select("id").distinct()), "id", "left_semi")
        rows = _in_bands(again, 1, turn, check)
        hot = written(_too_large(rows))
        links.append(_walked(rows.join(hot.select("cell"), "cell", "left_anti"), similarity, check, deviations, all_pairs))
        if not hot.isEmpty():
            links.append(_walked(_parted(rows, hot), similarity, check, deviations, all_pairs))
            left = None if labelled else rows.join(hot.select("cell"), "cell", "left_semi").select("cell", "id")
    found = functools.reduce(DataFrame.unionByName, links)
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), left


def _similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets, read from a document of each node, are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch.column(2)]
            own = [(i, s.view(np.int64)) for i, n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets) if n == _node(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in own], pa.int64()), pa.array([s for _, s in own], pa.list_(pa.int64()))], ["id", "found"]
            )

    wanted = written(
        pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct().join(nodes.select("id", "node", F.col("doc").alias("least")), "id")
    )
    # Rows that share a doc_id may have other texts; a node is read from one that has its set.
    met = docs.select("doc_id", "text").join(wanted.hint("merge"), F.col("doc_id") == F.col("least"))
    sets = written(met.select("id", "node", "text").mapInArrow(run, "id long, found array<long>").dropDuplicates(["id"]))
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("found").alias("x")), "u").join(
        sets.select(F.col("id").alias("v"), F.col("found").alias("y")), "v"
    )
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("u", "v")


def similar_components(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc, component_id): the smallest doc_id among documents linked by a Jaccard similarity of at least similarity.

    Compared are the sets of shingles of width words. Equal sets are one node of the trie. Candidates
    that join its components are checked first; where some fail the check, others between the parts of that
    component are, in a few rounds one for each part and then all that are left, so every candidate pair
    is joined or was compared. Texts without words are one set, unlike all others; rows without a doc_id are left out;
    repeated rows give equal rows; an empty table gives none.
    """
    tune(docs.sparkSession)
    docs = docs.where(F.col("doc_id").isNotNull())
    rows = written(_signatures(docs, width))
    nodes = rows.groupBy("node").agg(F.min("doc").alias("doc"), F.first("bits").alias("bits"), F.first("least").alias("least"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()))
    met, left = candidate_links(nodes, similarity)
    met = written(met)
    near = written(_similar(met, nodes, docs, width, similarity))
    labels = written(connected_components(near))

    def further(apart: DataFrame, turn: int, all_pairs: bool) -> int:
        """Looks for links among nodes (node) of unlike components; how many candidates there were."""
        nonlocal met, near, labels
        again = apart.select(F.col("node").alias("id")).distinct().join(nodes.select("id", "bits", "least"), "id").join(labels.withColumnRenamed("node", "id"), "id", "left")
        again = written(again.select("id", "bits", "least", F.coalesce("component", "id").alias("label")))
        rest = written(candidate_links(again, similarity, turn, all_pairs)[0].join(met, ["u", "v"], "left_anti"))
        if rest.isEmpty():
            return 0
        met = met.unionByName(rest)
        near = near.unionByName(written(_similar(rest, nodes, docs, width, similarity)))
        labels = written(connected_components(near))
        return rest.count()

    if left is not None:
        of = written(left.join(labels.withColumnRenamed("node", "id"), "id", "left").select("cell", F.col("id").alias("node"), F.coalesce("component", "id").alias("label")))
        mixed = of.groupBy("cell").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("cell")
        further(of.join(mixed, "cell", "left_semi"), 0, False)

    def torn() -> DataFrame:
        """Nodes of components of candidate links that the checked links leave in parts."""
        loose = written(connected_components(met)).withColumnRenamed("component", "loose")
        parts = loose.join(labels, "node", "left").select("node", "loose", F.coalesce("component", "node").alias("label"))
        return parts.join(parts.groupBy("loose").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("loose"), "loose", "left_semi")

    # Single links first, each time in another order: they join most parts, and few pairs are left to compare.
    for turn in range(1, ROUNDS + 2):
        apart = written(torn())
        if apart.isEmpty() or (not further(apart, turn, turn > ROUNDS) and turn > ROUNDS):
            break
    own = nodes.join(labels, nodes["id"] == labels["node"], "left").select(nodes["node"], "doc", F.coalesce("component", "id").alias("component"))
    least = own.groupBy("component").agg(F.min("doc").alias("component_id"))
    by_node = written(own.join(least, "component").select("node", "component_id"))
    return rows.select("doc", "node").join(by_node, "node").select(F.col("doc").alias("id"), "component_id")


def _first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    mark = free_name(docs, "gone")
    gone = written(found.where("id > component_id").select(F.col("id").alias(mark)).distinct())
    return docs.join(gone, docs["doc_id"] == F.col(mark), "left_anti")


def drop_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The document of smallest doc_id of each component of similar_components(), with all its columns.

    Rows without a doc_id cannot be told apart and stay; rows that repeat the doc_id kept stay too.
    """
    return _first_of_each(docs, similar_components(docs, width, similarity))


def drop_near_duplicates(docs: DataFrame, max_bits: int = 3) -> DataFrame:
    """The document of smallest doc_id of each component of near_duplicate_components(), with all its columns.

    Rows without a doc_id cannot be told apart and stay; rows that repeat the doc_id kept stay too.
    """
    return _first_of_each(docs, near_duplicate_components(docs, "doc_id", "text", max_bits))


def op2_trie_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.

    Null, empty and blank texts have fingerprint zero and are linked like any other; a null doc_id is
    never a component_id unless its whole component lacks ids; repeated rows give equal rows.
    """
    found = near_duplicate_components(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
