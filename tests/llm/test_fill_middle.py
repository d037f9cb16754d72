"""Fill-in-the-middle: offsets of every code point, marks in and around texts, carried columns."""

import random

import numpy as np
from pyspark.sql import functions as F

from labelgrid.llm import fill_middle

from .test_queries import brute_middle


def test_offsets_of_every_code_point():
    """One match for each of them, also for marks that join, surrogates' neighbours and ends of lines."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    rng = random.Random(5)
    odd = ["".join(rng.choices("ab \r\n\u0301\u200d🙂é<PSM>", k=k)) for k in range(80)]
    for t in [every, every[::-3], "", "a" * (fill_middle.RUN + 7), *odd]:
        assert np.array_equal(fill_middle.offsets(t), np.arange(len(t)))


def test_the_worker_forgets_pieces(monkeypatch):
    monkeypatch.setattr(fill_middle, "KNOWN", 3)
    monkeypatch.setattr(fill_middle, "_KNOWN", [])
    t = "many different pieces " * 50
    assert np.array_equal(fill_middle.offsets(t), np.arange(len(t)))
    assert len(fill_middle._KNOWN[0]) <= 3


def test_outputs_and_the_way_back(spark):
    """Every form occurs, texts of parts of marks come back, and columns are carried."""
    rng = random.Random(8)
    texts = ["".join(rng.choices(["<", ">", "P", "S", "M", "<P", "S>", "é", "\n"], k=rng.randrange(12))) for _ in range(400)]
    docs = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(texts)], "doc_id long, text string, form string").withColumn("own", F.col("form"))
    out = fill_middle.with_middles_last(docs, "doc_id", "text").withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    rows = out.collect()
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"} and {r["own"] for r in rows} == {"mine"}
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_middle(r["doc_id"], t)
        assert r["back"] == r["text"] == t
