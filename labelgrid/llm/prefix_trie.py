"""Conversations as a prefix trie: which turns they begin with in common, and what that saves.

Conversations are arrays of turn digests, sorted over the whole cluster, so those that share a beginning are
neighbours. A task sweeps its part of the order with a stack: the longest common prefix of two neighbours tells
which nodes end between them. Nodes that could go on in a neighbouring part, those on a part's first and last
path, leave as partial sums under a digest of their path; sums of equal digests make the whole node.

A long conversation is cut into blocks of BLOCK turns, each sorted under a digest of all turns before it, so no
row, stack or window group holds more than a block; a node at a block's end is the root of the blocks after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tune, written

#: Turns of a block; children that wait for their parent's number; bytes of ids held for a node.
BLOCK, WAITING, ENDS = 128, 4096, 1 << 16
#: Turns a rebuilt conversation takes over: the CRC-32 of its number modulo this, from the first of each FAMILY.
HEADS, FAMILY = 9, 5

_EMPTY = hashlib.sha256().hexdigest()
_NODE = "kind string, key binary, parent_key binary, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, asked boolean"
_PART = "group binary, bytes long, is_root boolean, path long, ends string"


# Turns


def numbered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, turn_id, bytes): a turn's place in its conversation from 0, the digest of its role and text, and its text's size.

    Ordered by turn, null first, equal turns by turn_id; a null role or text is an empty one; repeated rows are
    turns of their own; rows without a conversation are left out. Places are counted over a sorted table, by how many turns
    of the conversation its parts hold, so a conversation of any length is spread over tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.unhex(F.sha2(F.concat(F.sha2(role, 256), text), 256)).alias("turn_id"), F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv_id", "turn", "turn_id", "tie"]
    placed = [F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")]
    kept = written(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn_id", "bytes", *placed))
    runs = kept.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return kept.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "turn_id", "bytes")


def _head(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) rebuilt: the first h turns of conversation c - c % FAMILY, then c's own after its first h.

    h is the CRC-32 of the decimal c modulo HEADS, so what is taken over is at most HEADS - 1 turns. conversations
    is (conv_id, length), with those that are left without a turn.
    """
    turns = written(turns)
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", _head(F.col("conv_id")))
    convs = convs.withColumn("giver", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS - 1)).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn_id", "bytes"))).alias("head")
    )
    given = convs.join(heads.withColumnRenamed("conv_id", "giver"), "giver", "left")
    given = given.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h").cast("int")))
    given = written(given.withColumn("taken", F.size("head").cast("long")))
    own = turns.where(F.col("pos") >= _head(F.col("conv_id"))).join(given.select("conv_id", "h", "taken"), "conv_id")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_id", "bytes")
    taken = given.select("conv_id", F.inline("head")).select("conv_id", "pos", "turn_id", "bytes")
    length = (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")
    return taken.unionByName(own), given.select("conv_id", length)


# Blocks


def _prefixes(blocks: DataFrame) -> DataFrame:
    """(conv_id, b, prefix, next): digests of all turns before the block and before the one after it; of full blocks.

    A block's digest depends on its place, so the exclusive or of those before a block is a digest of their
    sequence; there is one short row for each block of a conversation.
    """
    own = F.sha2(F.concat(F.col("b").cast("string"), F.lit(":"), F.array_join(F.transform("turn_ids", F.hex), "")), 256)
    numbers = [F.conv(F.substring("own", 15 * k + 1, 15), 16, 10).cast("long") for k in range(4)]
    all_before = Window.partitionBy("conv_id").orderBy("b")

    def digest(over) -> Column:
        xors = [F.coalesce(F.bit_xor(f"x{k}").over(over), F.lit(0)).cast("string") for k in range(4)]
        return F.unhex(F.sha2(F.concat_ws(":", *xors), 256))

    rows = blocks.select("conv_id", "b", own.alias("own")).select("conv_id", "b", *[x.alias(f"x{k}") for k, x in enumerate(numbers)])
    before = digest(all_before.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("conv_id", "b", F.when(F.col("b") > 0, before).otherwise(F.lit(b"")).alias("prefix"), digest(all_before.rowsBetween(Window.unboundedPreceding, 0)).alias("next"))


def _blocks(turns: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """(conv_id, b, prefix, next, turn_ids, bytes, ends), written: a row for each block, and one for a conversation without turns.

    ends: the conversation ends in the block. next is null in blocks that aren't full.
    """
    b = F.floor(F.col("pos") / block).cast("long").alias("b")
    found = turns.groupBy("conv_id", b).agg(F.sort_array(F.collect_list(F.struct("pos", "turn_id", "bytes"))).alias("turns"))
    found = found.select("conv_id", "b", F.col("turns.turn_id").alias("turn_ids"), F.col("turns.bytes").alias("bytes"))
    length = convs.select("conv_id", "length")
    found = written(found.join(length, "conv_id").withColumn("ends", (F.col("b") + 1) * block >= F.col("length")).drop("length"))
    none = length.where("length = 0").select(
        "conv_id", F.lit(0).cast("long").alias("b"), F.array().cast("array<binary>").alias("turn_ids"), F.array().cast("array<bigint>").alias("bytes"), F.lit(True).alias("ends")
    )
    full = F.size("turn_ids") == block
    # Blocks that are followed, and those after them; any other has no block before it and isn't full.
    long = found.where(full | (F.col("b") > 0))
    digests = _prefixes(long)
    cut = long.join(digests, ["conv_id", "b"]).withColumn("next", F.when(full, F.col("next")))
    short = found.where(~full & (F.col("b") == 0)).unionByName(none)
    short = short.withColumn("prefix", F.lit(b"")).withColumn("next", F.lit(None).cast("binary"))
    return written(cut.unionByName(short))


# The sweep


class _Node:
    __slots__ = ("key", "level", "bytes", "open", "n", "least", "children", "leaves", "saved", "ended", "size", "asked", "chunked", "waiting")

    def __init__(self, key: bytes, level: int, size: int, is_open: bool):
        self.key, self.level, self.bytes, self.open = key, level, size, is_open
        self.n = self.children = self.leaves = self.saved = self.size = 0
        self.least: int | None = None
        self.asked = self.chunked = False
        self.ended: list[int] = []
        self.waiting: list[dict] = []


def _root_key(b: int, prefix: bytes) -> bytes:
    return hashlib.sha256(b"%d:" % b + prefix).digest()


class _Sweep:
    """A stack over a part of the sorted blocks; records gathers what leaves it."""

    def __init__(self, part: int, block: int):
        self.block, self.paths, self.records = block, part << 33, []
        self.stack: list[_Node] = []
        self.group: tuple[int, bytes] | None = None
        self.turns: list[bytes] = []
        self.first = True

    def row(self, b: int, prefix: bytes, following: bytes | None, turns: list[bytes], sizes: list[int], conv: int, ends: bool) -> None:
        if self.group != (b, prefix):
            self.pop_to(0)
            if self.stack:
                self.close(self.stack.pop())
            # The root of later blocks is a node of the block before, so it is never closed here.
            self.group, self.turns = (b, prefix), []
            self.stack = [_Node(_root_key(b, prefix), 0, 0, self.first or b > 0)]
        shared = 0
        for x, y in zip(self.turns, turns):
            if x != y:
                break
            shared += 1
        self.pop_to(shared)
        for level in range(shared + 1, len(turns) + 1):
            last = level == self.block
            key = _root_key(b + 1, following) if last else hashlib.sha256(self.stack[-1].key + turns[level - 1]).digest()
            self.stack.append(_Node(key, level, sizes[level - 1], self.first))
        self.turns = turns
        if self.first:
            self.path()
            self.first = False
        top = self.stack[-1]
        top.n += 1
        top.least = conv if top.least is None else min(conv, top.least)
        if ends:
            top.ended.append(conv)
            top.size += len(str(conv)) + 1
            if top.size > ENDS:
                self.chunk(top)
        elif not top.open:
            top.open = True
            self.path()

    def path(self) -> None:
        """Leave the way to the top of the stack."""
        self.paths += 1
        for node in self.stack[1 if self.group[0] else 0 :]:
            self.records.append({"kind": "path", "key": node.key, "path": self.paths, "depth": node.level})

    def chunk(self, node: _Node) -> None:
        if node.ended:
            self.records.append({"kind": "ends", "key": node.key, "conv_id": node.ended[0], "ends": ",".join(map(str, node.ended))})
        node.ended, node.size, node.chunked = [], 0, True

    def pop_to(self, level: int) -> None:
        while len(self.stack) > level + 1:
            node = self.stack.pop()
            self.close(node)

    def close(self, node: _Node) -> None:
        """A node leaves the stack: whole, to wait for its parent's number, or as partial sums if it is open."""
        b, _ = self.group
        parent = self.stack[-1] if self.stack else None
        if parent:
            parent.n += node.n
            if node.least is not None and (parent.least is None or node.least < parent.least):
                parent.least = node.least
        if node.open or not parent:
            if parent:
                parent.open = True
            self.chunk(node)
            self.give(node, None)
            self.records.append({
                "kind": "part", "key": node.key, "parent_key": parent.key if parent else None, "conv_id": node.least, "depth": b * self.block + node.level,
                "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved,
                "group": _root_key(*self.group), "bytes": node.bytes, "is_root": not parent and b > 0,
            })
            return
        leaves = node.leaves + (not node.children)
        saved = node.saved + (node.n - 1) * node.bytes
        parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + leaves, parent.saved + saved
        if node.chunked:
            self.chunk(node)
        self.give(node, node.least)
        ends = None if node.chunked else hashlib.sha256(",".join(map(str, node.ended)).encode()).hexdigest()
        parent.waiting.append({
            "kind": "node", "key": node.key, "parent_key": parent.key, "conv_id": node.least, "depth": b * self.block + node.level, "n_convs": node.n,
            "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "asked": node.asked,
        })
        if len(parent.waiting) >= WAITING:
            parent.asked = True
            self.give(parent, None)

    def give(self, node: _Node, conv: int | None) -> None:
        """The children that wait leave, with their parent's number if it is known."""
        for child in node.waiting:
            child["parent_conv_id"] = conv
        self.records += node.waiting
        node.waiting = []

    def end(self) -> None:
        if self.stack:
            for node in self.stack:
                node.open = True
            self.path()
            self.pop_to(0)
            self.close(self.stack.pop())


def _swept(blocks: DataFrame, block: int) -> DataFrame:
    order = ["b", "prefix", "turn_ids", "conv_id"]
    dealt = blocks.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("b", "prefix", "next", "turn_ids", "bytes", "conv_id", "ends", F.spark_partition_id().alias("part"))
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(c, kinds[k]) for c, k in (x.split() for x in f"{_NODE}, {_PART}".split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = None
        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)])
            for *row, part in rows:
                sweep = sweep or _Sweep(part, block)
                sweep.row(*row)
                if len(sweep.records) >= 4 * WAITING:
                    yield pa.RecordBatch.from_pylist(sweep.records, schema)
                    sweep.records = []
        if sweep:
            sweep.end()
            yield pa.RecordBatch.from_pylist(sweep.records, schema)

    return written(dealt.mapInArrow(run, f"{_NODE}, {_PART}"))


# Stitching


def _hashed_ends(chunks: DataFrame) -> DataFrame:
    """(key, ends_sha256): the chunks of a node's ids, in order, go through one hash; none is held longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], ["key", "hashed"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "hashed"])

    dealt = chunks.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ends")
    return dealt.mapInArrow(run, "key binary, hashed string")


SUMS = ["n_leaves", "saved_tokens"]


def _below(owned: DataFrame, rows: DataFrame, line: str, place: str) -> DataFrame:
    """(key, n_leaves, saved_tokens): the sums of owned (key, ...) over every key and those below it.

    rows (line, key, place) are ways down the tree; a key counts on the least of its lines, and is above all that
    comes later there.
    """
    least = rows.groupBy("key").agg(F.min(line).alias("on"))
    mine = [F.when(F.col("on") == F.col(line), F.col(c)).otherwise(0).alias(c) for c in SUMS]
    marked = rows.join(least.join(owned, "key"), "key").select(line, "key", place, *mine)
    down = Window.partitionBy(line).orderBy(F.desc(place))
    run = marked.select("key", *[F.sum(c).over(down).alias(c) for c in SUMS])
    return run.groupBy("key").agg(*[F.sum(c).alias(c) for c in SUMS])


def _stitched(swept: DataFrame, blocks: DataFrame) -> DataFrame:
    """The nodes that left as partial sums, whole: key, parent_key, conv_id, depth, n_convs, n_children and sums."""
    parts = swept.where("kind = 'part'")
    total = [F.sum(c).alias(c) for c in ("n_children", *SUMS)]
    nodes = parts.where("NOT is_root").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("group").alias("group"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.max("bytes").alias("bytes"), F.sum("n_convs").alias("n_convs"), *total,
    )
    nodes = written(nodes)
    roots = parts.where("is_root").groupBy("key").agg(*total)
    found = nodes.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("open_children")).where("key IS NOT NULL")
    of_roots = roots.select("key", F.col("n_children").alias("later_children"))
    own = nodes.join(found, "key", "left").join(of_roots, "key", "left")
    own = own.withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)) + F.coalesce("later_children", F.lit(0)))
    own = own.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
    own = written(own.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes")).drop("open_children", "later_children"))
    sums = own.select("key", *SUMS)
    later = blocks.where("b > 0").select("conv_id", "b", _group_key().alias("key"))
    if not later.isEmpty():
        # What the blocks under a node add to it: sums over a block, then down the blocks of conversations.
        of_blocks = roots.select("key", *SUMS).unionByName(own.select(F.col("group").alias("key"), *SUMS)).groupBy("key").agg(*total[1:])
        added = _below(of_blocks, later, "conv_id", "b")
        sums = sums.unionByName(added.join(own.select("key"), "key", "left_semi")).groupBy("key").agg(*total[1:])
    paths = swept.where("kind = 'path'").select("path", "key", "depth")
    return own.drop(*SUMS).join(_below(sums, paths, "path", "depth"), "key")


def _group_key() -> Column:
    return F.unhex(F.sha2(F.concat(F.concat(F.col("b").cast("string"), F.lit(":")).cast("binary"), F.col("prefix")), 256))


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int | None = None) -> DataFrame:
    """The nodes of the prefix trie of turns (conv_id, pos, turn_id, bytes) and convs (conv_id, length).

    pos runs from 0 without gaps in each conversation; turn_id says which turns are equal. A node is a sequence of the first
    d turns of some conversation: conv_id (the smallest that starts with it) and depth d name it; parent_conv_id,
    n_convs (that start with it), n_children, n_leaves (childless nodes from it down), saved_tokens (bytes of
    turns that need not be read again: of each node from it down, one less than its n_convs times its bytes),
    ends_sha256 (digest of the conversations that end there, ascending, comma-joined). Conversations without
    turns end at the root; without any conversation there is no node.
    """
    tune(turns.sparkSession)
    block = block or BLOCK
    blocks = _blocks(turns, convs, block)
    swept = _swept(blocks, block)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *SUMS, "ends_sha256"]
    whole = swept.where("kind = 'node'")
    stitched = written(_stitched(swept, blocks))
    ends = written(_hashed_ends(swept.where("kind = 'ends'")))
    numbers = whole.where("asked").unionByName(stitched, allowMissingColumns=True).select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    known = whole.where("parent_conv_id IS NOT NULL AND ends_sha256 IS NOT NULL").select(*columns)
    rest = whole.where("parent_conv_id IS NULL OR ends_sha256 IS NULL").unionByName(stitched, allowMissingColumns=True)
    rest = rest.join(numbers, "parent_key", "left").join(ends, "key", "left")
    rest = rest.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")).withColumn("ends_sha256", F.coalesce("ends_sha256", "hashed", F.lit(_EMPTY)))
    return known.unionByName(rest.select(*columns))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations.

    Turns are ordered by number, null first, equal numbers by the digest of role and text; null roles and texts
    are empty; repeated rows are turns of their own; rows without a conv_id belong to no conversation; an empty
    table has no node.
    """
    turns, convs = rebuilt(numbered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie(turns, convs)
