"""Quality score by a byte-level convolutional network in numpy, trained on labelled documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune

FILTERS, TAPS = 24, 6
#: Bytes in a block; a chunk is CHUNK blocks and chunks begin at every block, so they overlap.
BLOCK, CHUNK = 128, 4
HIDDEN = 16
#: Labelled documents of each class that training may use at most.
TRAIN_PER_CLASS = 1000
_SLAB = 1024


def lay_out(texts: list[str | None]) -> tuple[np.ndarray, list[int], list[int]]:
    """The texts' bytes one after another, each filled with zeros to whole blocks; block bounds; sizes."""
    parts, bounds, sizes = [], [0], []
    for t in texts:
        raw = (t or "").encode("utf-8", "replace")
        blocks = max(1, -(-(len(raw) + TAPS - 1) // BLOCK))
        parts.append(raw + bytes(blocks * BLOCK - len(raw)))
        bounds.append(bounds[-1] + blocks)
        sizes.append(len(raw))
    return np.frombuffer(b"".join(parts) + bytes(TAPS - 1), np.uint8), bounds, sizes


def block_peaks(data: np.ndarray, kernel: np.ndarray, bounds: list[int], where: bool = False):
    """Largest answer of each filter in each block, and the byte it came from if asked.

    Of a text's last block the last TAPS - 1 places are left out: there filters read on into the next text.
    """
    lasts = np.array(bounds[1:]) - 1
    n = (len(data) - TAPS + 1) // BLOCK
    peaks = np.empty((n, FILTERS), np.float32)
    spots = np.empty((n, FILTERS), np.int64) if where else None
    for a in range(0, n, _SLAB):
        b = min(n, a + _SLAB)
        size = (b - a) * BLOCK
        answer = kernel[0].take(data[a * BLOCK : a * BLOCK + size], axis=0)
        for j in range(1, TAPS):
            answer += kernel[j].take(data[a * BLOCK + j : a * BLOCK + j + size], axis=0)
        answer = answer.reshape(b - a, BLOCK, FILTERS)
        answer[lasts[(lasts >= a) & (lasts < b)] - a, BLOCK - TAPS + 1 :] = -np.inf
        if where:
            at = answer.argmax(axis=1)
            spots[a:b] = at + (np.arange(a, b) * BLOCK)[:, None]
            peaks[a:b] = np.take_along_axis(answer, at[:, None], 1)[:, 0]
        else:
            answer.max(axis=1, out=peaks[a:b])
    return peaks, spots


def chunk_peaks(peaks: np.ndarray, where: bool = False):
    """Max-pooled filters of each overlapping chunk of a document's blocks, and the blocks they came from."""
    n = len(peaks)
    width = min(CHUNK, n)
    views = np.stack([peaks[k : n - width + 1 + k] for k in range(width)])
    if not where:
        return views.max(axis=0), None
    best = views.argmax(axis=0)
    return np.take_along_axis(views, best[None], 0)[0], best + np.arange(n - width + 1)[:, None]


def combined(act: np.ndarray, size: int) -> np.ndarray:
    """Mean, least and largest activation over a document's chunks, and its length on two scales."""
    return np.concatenate([act.mean(axis=0), act.min(axis=0), act.max(axis=0), [np.log1p(size) / 8, 32 / (32 + size)]])


def probability(features: np.ndarray, p: dict) -> np.ndarray:
    # Row by row the same sums, whatever else is in the batch; a matrix product is not.
    product = lambda x, w: (x[:, :, None] * w).sum(axis=1)
    z = product(np.tanh(product(features, p["w1"]) + p["b1"]), p["w2"]) + p["b2"]
    return 1 / (1 + np.exp(-np.clip(z[:, 0], -30, 30)))


def score(texts: list[str | None], p: dict) -> np.ndarray:
    """Probability of label 1 for each text; all bytes of each are read."""
    data, bounds, sizes = lay_out(texts)
    peaks, _ = block_peaks(data, p["kernel"], bounds)
    acts = (np.tanh(chunk_peaks(peaks[a:b])[0] + p["bias"]) for a, b in zip(bounds, bounds[1:]))
    return probability(np.stack([combined(a, n) for a, n in zip(acts, sizes)]), p)


def _shortened(text: str, rng: np.random.Generator) -> str:
    """Now and then a short stretch of a good text, so that good texts of few words are learnt too."""
    if rng.random() > 0.2:
        return text
    size = int(16 * 16 ** rng.random())
    at = int(rng.integers(0, max(1, len(text) - size)))
    return text[at : at + size]


def train(
    texts: list[str], labels: list[int], share: float | None = None, least_steps: int = 320, batch: int = 32, seed: int = 3
) -> dict:
    """Parameters after Adam over mini-batches; gradients flow to the bytes that won the pooling.

    share: label 1's share among all labels, where the texts are drawn by class; the last bias is
    moved from the drawn share to it.
    """
    rng = np.random.default_rng(seed)
    p = {
        "kernel": rng.normal(0, 0.35, (TAPS, 256, FILTERS)), "bias": np.full(FILTERS, -1.0),
        "w1": rng.normal(0, 0.2, (3 * FILTERS + 2, HIDDEN)), "b1": np.zeros(HIDDEN),
        "w2": rng.normal(0, 0.4, (HIDDEN, 1)), "b2": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return p | {"w2": np.zeros_like(p["w2"]), "b2": np.full(1, 4.0 if len(y) and y[0] else -4.0 if len(y) else 0.0, np.float32)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    rounds = -(-len(y) // batch)
    epochs = max(8, -(-least_steps // rounds))
    step, total = 0, epochs * rounds
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            data, bounds, sizes = lay_out([_shortened(texts[i], rng) if y[i] else texts[i] for i in pick])
            peaks, spots = block_peaks(data, p["kernel"], bounds, where=True)
            acts, blocks, rows = [], [], []
            for a, b, size in zip(bounds, bounds[1:], sizes):
                top, block = chunk_peaks(peaks[a:b], where=True)
                act = np.tanh(top + p["bias"])
                acts.append(act)
                blocks.append(block + a)
                rows.append(combined(act, size))
            x = np.stack(rows)
            hidden = np.tanh(x @ p["w1"] + p["b1"])
            z = (hidden @ p["w2"] + p["b2"])[:, 0]
            dz = ((1 / (1 + np.exp(-z)) - y[pick]) / len(pick))[:, None]
            dh = (dz @ p["w2"].T) * (1 - hidden * hidden)
            g = {"w2": hidden.T @ dz, "b2": dz.sum(axis=0), "w1": x.T @ dh + 1e-4 * p["w1"], "b1": dh.sum(axis=0)}
            dx = dh @ p["w1"].T
            g["kernel"], g["bias"] = np.zeros_like(p["kernel"]), np.zeros_like(p["bias"])
            lanes = np.arange(FILTERS)
            for d, act, block in zip(dx, acts, blocks):
                grad = np.repeat(d[None, :FILTERS] / len(act), len(act), axis=0)
                grad[act.argmin(axis=0), lanes] += d[FILTERS : 2 * FILTERS]
                grad[act.argmax(axis=0), lanes] += d[2 * FILTERS : 3 * FILTERS]
                grad *= 1 - act * act
                g["bias"] += grad.sum(axis=0)
                from_byte = spots[block, lanes]
                for j in range(TAPS):
                    np.add.at(g["kernel"][j], (data[from_byte + j], np.broadcast_to(lanes, block.shape)), grad)
            step += 1
            rate = 0.012 * min(1.0, 2 * (1 - step / (total + 1)))
            for k, d in g.items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    if share is not None and 0 < share < 1:
        drawn = float(y.mean())
        p["b2"] = p["b2"] + np.float32(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))
    return p


def held_out(id_col: str):
    """Whether a row's label is kept from training."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def training_rows(
    docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS
) -> tuple[list[tuple[str, int]], float | None]:
    """(text, quality) of at most per_class labelled documents of each class, none of them held out.

    An id with both labels counts as 0. Ids are drawn by hash from the narrow label table; only then are their texts read, through a
    broadcast of the drawn ids, whose number is bounded by the parameter. The second result is label
    1's share among all labels open to training.
    """
    spark = docs.sparkSession
    open_to_us = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    drawn = [
        (row["doc_id"], q)
        for q in (0, 1)
        for row in open_to_us.where(F.col("quality") == q).select("doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    ]
    share = open_to_us.agg(F.avg("quality")).first()[0]
    if not drawn:
        return [], share
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = spark.createDataFrame(drawn, f"doc_id {kind}, quality int").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").collect()
    return [(r["text"] or "", r["quality"]) for r in sorted(rows, key=lambda r: r["doc_id"])], share


def score_documents(docs: DataFrame, parameters: dict) -> DataFrame:
    """doc_id and score for every row of docs, from the text alone.

    A null text counts as empty and an empty text is scored as one chunk of zero bytes; repeated rows
    get equal scores; an empty table gives no rows; other columns are not carried.
    """
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = score(texts, parameters).astype(np.float64) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op5_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, by a network trained on labelled ones that are not held out.

    Null and empty texts have one score; a null doc_id is kept and never trained on; equal texts have
    equal scores; no rows give none; without labels every score is one half.
    """
    docs = table(spark, sf_dir, "documents")
    rows, share = training_rows(docs, table(spark, sf_dir, "labels"))
    parameters = train([t for t, _ in rows], [q for _, q in rows], share)
    return score_documents(docs, parameters).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
