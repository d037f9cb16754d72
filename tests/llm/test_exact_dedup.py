"""Exact duplicates: fingerprints that add up, texts of many chunks, fingerprints that collide, rows that stay."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from labelgrid.llm import exact_dedup


def brute(rows):
    """(doc_id, keep_id, group_size, kept, digest) of (doc_id, text) rows, counted."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().lower()].append(i)
    out = collections.Counter()
    for body, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(ids):
            out[i, ids[-1], len(ids), k == len(ids) - 1, hashlib.sha256(body).hexdigest()] += 1
    return out


def found(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("mine"), "n": F.lit(1)}).repartition(3)
    out = exact_dedup.exact_groups(docs, "doc_id", "text", **how)
    return collections.Counter(tuple(r) for r in out.select("id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_hashes_of_parts_add_up():
    """Whole texts, their parts put together, and the polynomial itself."""
    rng = random.Random(2)
    for n in (0, 1, 1000, exact_dedup.CHUNK, exact_dedup.CHUNK + 1, 17 * exact_dedup.CHUNK + 5):
        body = rng.randbytes(n)
        want = []
        for x in exact_dedup.POINTS:
            h = 0
            for b in body:
                h = (h * x + b) % exact_dedup.PRIME
            want.append(h)
        assert exact_dedup.fingerprint(body) == tuple(want)
        cut = rng.randrange(n + 1)
        a, b = exact_dedup.fingerprint(body[:cut]), exact_dedup.fingerprint(body[cut:])
        assert exact_dedup.combined(a, b, n - cut) == tuple(want)


def some_rows(rng):
    texts = ["Same", "sAME", "É", "é", "", None, "x" * 5000 + "a", "x" * 5000 + "b", "X" * 5000 + "A", "tail", "İ"]
    return [(i, rng.choice(texts)) for i in range(80)] + [(3, "Same"), (200, "same"), (200, "same"), (None, "alone"), (None, "É"), (None, "alone")]


@pytest.mark.parametrize("chunk, span", [(1 << 16, 1 << 20), (64, 256)])
def test_groups(spark, monkeypatch, chunk, span):
    """Also with texts of many spans, hashed by different tasks, and of many chunks."""
    monkeypatch.setattr(exact_dedup, "CHUNK", chunk)
    monkeypatch.setattr(exact_dedup, "SPAN", span)
    monkeypatch.setattr(exact_dedup, "MET", 3)
    exact_dedup._powers.cache_clear()
    try:
        rows = some_rows(random.Random(chunk))
        assert found(spark, rows) == brute(rows)
    finally:
        exact_dedup._powers.cache_clear()


def test_fingerprints_that_collide(spark):
    """At the points 0 and 1 texts of one length, one last byte and one sum of bytes collide; the comparison parts them."""
    rng = random.Random(9)
    rows = [(i, "".join(rng.sample("abc", 3)) + "z") for i in range(60)] + [(i, "abcz") for i in range(100, 110)]
    assert found(spark, rows, points=(0, 1)) == brute(rows)


def test_rows_that_stay_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "A", "x"), (2, "a", "y"), (3, "b", "z"), (3, "b", "z")], "doc_id long, text string, leader string")
    assert sorted(map(tuple, exact_dedup.drop_exact_duplicates(docs, "doc_id", "text").collect())) == [(2, "a", "y"), (3, "b", "z")]
    assert exact_dedup.drop_exact_duplicates(docs.limit(0), "doc_id", "text").count() == 0
