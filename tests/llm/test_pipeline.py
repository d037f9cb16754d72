"""The pipeline's stages over small documents, each held to its operator's brute force."""

import random

import corpus_pipeline
from labelgrid.llm import pii

from .test_operators import brute_lines, prose
from .test_similar import components


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    texts = ["\n".join(prose(rng, 30, "etaoinshr") for _ in range(5)) for _ in range(12)]
    texts += [texts[3], texts[4] + "\nAll rights reserved by somebody or other today", "too short", None, "| a " * 90]
    texts.append(texts[5].replace("\n", " mail x@y.example.com \n", 1))
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append(now.orderBy("doc_id").collect())
        if k < 4:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert k in (0, 2) or all(r["n_chars"] == len(r["text"]) for r in seen[-1])
    good, lines, unique, clean, packed = seen
    assert {r["doc_id"] for r in good} == set(range(14)) | {17}
    want = brute_lines([(r["doc_id"], r["text"]) for r in good])
    assert {r["doc_id"]: r["text"] for r in lines} == {i: t for i, t in want.items() if t.strip()}
    group = components([r["text"] for r in lines])
    assert {r["doc_id"] for r in unique} == {r["doc_id"] for k, r in enumerate(lines) if group[k] == k}
    assert all(not pii.base_spans(r["text"]) for r in clean)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in unique}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
