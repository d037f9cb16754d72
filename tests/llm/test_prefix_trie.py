"""The prefix trie against brute force: blocks, parts and hot nodes of every kind."""

import collections
import hashlib
import random
import zlib

import pytest

from labelgrid.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn int, role string, text string, part string, b long"


def brute(rows):
    """Nodes of the trie of all rebuilt conversations, as tuples of COLUMNS."""
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256((hashlib.sha256(role.encode()).hexdigest() + text).encode()).digest()
            turns[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [(r, t) for _, _, _, r, t in sorted(x)] for c, x in turns.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, x in made.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    children = collections.defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    sums = {}
    for k in sorted(members, key=len, reverse=True):
        leaves, saved = sum(sums[x][0] for x in children[k]), sum(sums[x][1] for x in children[k])
        sums[k] = (leaves or 1, saved + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0))
    ends = {k: ",".join(str(c) for c in sorted(m) if len(made[c]) == len(k)) for k, m in members.items()}
    return collections.Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), *sums[k], hashlib.sha256(ends[k].encode()).hexdigest())
        for k, m in members.items()
    )


def conversations(seed, n, words=2, longest=12):
    """Conversations of few different turns, so that they share long beginnings; some ids and rows are odd."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.choice([1, 2, 3, longest])):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user", "w" * rng.randrange(1, words + 1)))
    rng.shuffle(rows)
    return [*rows, (rows[0][0], None, None, None), (None, 1, "user", "lost"), (rows[1][0], 3, "user", None), rows[2], (10**12, 0, "user", "é🙂"), (5 * 10**11, 1, "a", "")]


def nodes(spark, rows, **how):
    df = spark.createDataFrame([(*r, "mine", 7) for r in rows], TURNS).repartition(5)
    turns, convs = prefix_trie.rebuilt(prefix_trie.numbered_turns(df))
    return collections.Counter(tuple(r) for r in prefix_trie.prefix_trie(turns, convs, **how).select(*COLUMNS).collect())


@pytest.mark.parametrize("block, parts", [(128, 4), (2, 7), (3, 1), (1, 4)])
def test_blocks_and_parts(spark, monkeypatch, block, parts):
    """Nodes that go over the edges of parts and blocks; few children wait and few ids are held at a time."""
    monkeypatch.setattr(prefix_trie, "WAITING", 3)
    monkeypatch.setattr(prefix_trie, "ENDS", 6)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = conversations(block, 60)
        assert nodes(spark, rows, block=block) == brute(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_one_long_conversation_and_many_equal_ones(spark):
    """A conversation of half the turns, and a node where half of the conversations end."""
    rows = [(7, t, "user", "x" * (t % 3)) for t in range(300)] + [(c, t, "user", "same") for c in range(1000, 1100) for t in range(10)]
    assert nodes(spark, rows, block=16) == brute(rows)


def test_no_conversations(spark):
    assert not nodes(spark, [(None, 1, "user", "lost")])
