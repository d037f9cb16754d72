"""Near-dedup by similarity, as the pipeline has it, against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from labelgrid.llm import simhash

from .test_operators import WORD, prose, roots


def families(rng, n, edits):
    out = []
    for _ in range(n):
        base = prose(rng, 120).split()
        for k in edits:
            w = list(base)
            for j in rng.sample(range(120), k):
                w[j] = "edited" + str(rng.randrange(9))
            out.append(" ".join(w))
    return out


def components(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return roots(len(texts), near)


def test_near_dedup_stage_against_all_pairs(spark):
    texts = families(random.Random(6), 6, (0, 1, 2, 3, 6, 12)) + ["one two", "one two", "", None]
    texts.append(texts[0])
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([*set(components(texts)), None], key=str)
    assert simhash.similar_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [12])
def test_a_family_whose_copies_are_about_as_similar_as_asked(spark, monkeypatch, cell):
    """Links that fail the check must not hide those that pass it; also where cells are cut to salted parts."""
    monkeypatch.setattr(simhash, "CELL", cell)
    texts = families(random.Random(7), 2, [2] * 25 + [3] * 25)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    assert got == dict(enumerate(components(texts)))


def similar_sets(rng, n):
    """Pairs of sets of similarity 0.80 to 0.81."""
    for _ in range(n):
        shared = rng.integers(0, 2**64, 160, np.uint64)
        yield [np.unique(np.concatenate([shared, rng.integers(0, 2**64, 19, np.uint64)])) for _ in range(2)]


def test_recall_of_pairs_at_the_similarity_asked():
    """Share of pairs of similarity 0.80 to 0.81 that meet in a cell, at first and where those are too large, and that come close in both passes.

    Nothing of it depends on the number of texts.
    """
    met = {k: [] for k in ("cell 0", "cell 1", "first", "again")}
    for a, b in similar_sets(np.random.default_rng(4), 2000):
        same = simhash.least_hashes(a) == simhash.least_hashes(b)
        for level in (0, 1):
            met[f"cell {level}"].append(same[simhash.bands(level)].all(axis=1).any())
        x, y = (np.unpackbits(np.frombuffer(simhash.long_fingerprint(s), np.uint8)) for s in (a, b))
        apart = x != y
        for name, check, deviations in (("first", simhash.CHECK, 4.0), ("again", simhash.LONG - 64, 3.1)):
            on_the_way = all(n <= simhash._bound(k + 1, 0.8) for k, n in enumerate(np.cumsum(apart[:64])))
            met[name].append(on_the_way and apart[64 : 64 + check].sum() <= simhash._bound(check, 0.8, deviations))
    shares = {k: np.mean(v) for k, v in met.items()}
    assert all(x >= 0.99 for x in shares.values()), shares
    print(shares)


def texts_of(rng, n):
    return [prose(rng, 60) for _ in range(n)]


def signatures(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return simhash._signatures(docs, 5).selectExpr("doc AS id", "bits", "least")


def test_copies_of_a_text_do_not_depend_on_the_number_of_texts(spark):
    rng = random.Random(12)
    for n in (20, 400):
        assert simhash._in_bands(signatures(spark, texts_of(rng, n)), 0, 0, simhash.CHECK).count() == 10 * n


def test_a_hot_cell_gives_as_many_links_as_texts(spark, monkeypatch):
    """Many near copies are in one cell and in parts of it: the candidates join them, and don't pair them all."""
    monkeypatch.setattr(simhash, "CELL", 40)
    rng = random.Random(13)
    base = prose(rng, 200).split()
    texts = []
    for k in range(300):
        w = list(base)
        w[rng.randrange(200)] = f"edit{k}"
        texts.append(" ".join(w))
    links, left = simhash.candidate_links(signatures(spark, texts), 0.8)
    assert links.count() < 40 * 300 and left is not None
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in simhash.similar_components(docs).collect()} == {0}
