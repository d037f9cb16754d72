"""The query functions and the pipeline over one small table of awkward rows, each held to brute force.

The table has null ids, null, blank, empty and long texts, ties, rows repeated whole, ids repeated with other
texts, and columns called like those that operators add.
"""

import collections
import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelgrid.llm import archive, bpe, byte_cnn, exact_dedup, fill_middle, line_dedup, media, packing, pii, prefix_trie, quality_rules, sharding, simhash

from . import test_exact_dedup, test_prefix_trie
from .test_operators import brute_fingerprint, brute_lines, brute_quality, prose, roots, tokenizer  # noqa: F401

CLASHING = ["shard", "slot", "region", "fp", "node", "component", "words", "lines", "digest", "ids", "sequence_id", "score", "n_lines", "__doc", "part", "row", "id", "spans", "page"]


def texts():
    rng = random.Random(21)
    base = [prose(rng, 70, "etaoinshr") for _ in range(5)]
    near = base[0].split()
    near[5] = "changed"
    return [
        *base, base[1], " ".join(near), base[2] + "\n" + base[3], None, "", " \t\n", "one", "One two", "x y z " * 40,
        "mail a.b@c.example.com from 10.0.0.1 or +1 (555) 010-9999 4111 1111 1111 1111 or 555-010-9999",
        "\n".join(prose(rng, 30, "etaoinshr") for _ in range(120)), "İ̙ Σίσυφος é 🙂 <|endoftext|>",
    ]


def rows():
    out = [(i, t) for i, t in enumerate(texts())]
    return [*out, out[0], (3, "another text of row three " * 12), (None, base_text()), (None, base_text())]


def base_text():
    return texts()[4]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("small")
    extra = [F.lit(f"mine {c}").alias(c) for c in CLASHING]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.select("*", *extra).repartition(3).write.parquet(str(root / "documents.parquet"))
    rng = random.Random(3)
    spark.createDataFrame([(i, rng.randrange(2), 0) for i in range(17)] + [(4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    html = ["<p>a</p>", None, "<p>a</p>", "", "é" * 50, "<p>a</p>"]
    pages = [(i, f"http://x/{i}", h) for i, h in enumerate(html)] + [(0, "http://x/0", "<p>a</p>"), (None, "u", "<p>a</p>"), (None, "u", "alone")]
    spark.createDataFrame(pages, "page_id long, url string, html string").select("*", *extra).write.parquet(str(root / "pages.parquet"))
    talks = spark.createDataFrame(test_prefix_trie.conversations(31, 25), "conv_id long, turn int, role string, text string")
    talks.select("*", *extra).repartition(3).write.parquet(str(root / "conversations.parquet"))
    return str(root)


@pytest.fixture(scope="module")
def none(spark, folder, tmp_path_factory):
    root = tmp_path_factory.mktemp("none")
    for name in ("documents", "labels", "pages", "conversations"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(root / f"{name}.parquet"))
    return str(root)


def held(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_op1(spark, folder, none):
    df = sharding.op1_hash_tree_sharding(spark, folder)
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key") for i, t in rows())
    assert held(df, "doc_id", "size", "text_crc32", "law") == want
    slots = collections.defaultdict(list)
    for r in df.collect():
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 8 and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(n == 1 for n in collections.Counter(i for i, _ in {(r["doc_id"], r["shard"]) for r in df.collect()}).values())
    assert sharding.op1_hash_tree_sharding(spark, none).count() == 0


def test_op2(spark, folder, none):
    given = rows()
    fps = [brute_fingerprint(t) for _, t in given]
    group = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {g: min((i for (i, _), h in zip(given, group) if h == g and i is not None), default=None) for g in group}
    want = collections.Counter((i, f"{fp:016x}", least[g]) for (i, _), fp, g in zip(given, fps, group))
    assert held(simhash.op2_trie_simhash(spark, folder), "doc_id", "fingerprint", "component_id") == want
    assert simhash.op2_trie_simhash(spark, none).count() == 0


def test_op3(spark, folder, none):
    df = quality_rules.op3_quality_cascade(spark, folder)
    want = collections.Counter()
    for i, t in rows():
        n, chars, symbols, dups, repeats = brute_quality(t)
        failed = n < 50 or 100 * repeats > 50 * n
        upper = sum(c.isupper() for c in t or "")
        lines = sum(bool(x.strip()) for x in (t or "").split("\n"))
        bad = 10 * symbols > n or 10 * upper > 4 * chars or 2 * dups > lines or not 2 * n <= chars <= 20 * n
        want[i, n, chars, symbols, dups, repeats, failed, not (failed or bad)] += 1
    assert held(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == want
    assert quality_rules.op3_quality_cascade(spark, none).count() == 0


def test_op4(spark, folder, none):
    df = line_dedup.op4_line_dedup(spark, folder)
    # Rows repeated whole are one document; a null id comes first.
    order = sorted(set(rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] != texts()[3] if r[0] == 3 else 0))
    kept = brute_lines([((i, t), t) for i, t in order])
    assert held(df, "doc_id", "kept_sha256") == collections.Counter((i, sha(kept[i, t] or "")) for i, t in rows())
    assert line_dedup.op4_line_dedup(spark, none).count() == 0


def test_op5(spark, folder, none):
    df = byte_cnn.op5_byte_cnn_quality(spark, folder)
    name = lambda i: "" if i is None else str(i)
    assert held(df, "doc_id", "held_out") == collections.Counter((i, zlib.crc32(name(i).encode()) % 4 == 2) for i, _ in rows())
    scores = collections.defaultdict(set)
    for r in df.collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        scores[r["doc_id"]].add(r["score"])
    assert all(len(s) == 1 for i, s in scores.items() if i != 3) and len(scores[3]) == 2
    assert scores[1] == scores[5] and scores[8] == scores[9]  # equal texts; a null text is an empty one
    assert byte_cnn.op5_byte_cnn_quality(spark, none).count() == 0


def test_op6(spark, folder, none, tokenizer):  # noqa: F811
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    out = packing.op6_online_packing(spark, folder).collect()
    for r in out:
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for at in sequences.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 4096
    ids = {}
    times = collections.Counter(rows())
    for (i, t), n in times.items():
        ids[i, t] = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    want = collections.Counter()
    for (i, t), n in times.items():
        want[i] += n * len(ids[i, t])
    assert sum(r["length"] for r in out) == sum(want.values())
    for (i, total), found in pieces.items():
        of = [x for (k, _), x in ids.items() if k == i and len(x) == total]
        assert of and all(any(zlib.crc32(x[s : s + n].tobytes()) == crc for x in of) for s, n, crc in found)
        covered = collections.Counter(p for s, n, _ in found for p in range(s, s + n))
        assert set(covered.values()) <= {1, 2} and set(covered) == set(range(total))
    assert packing.op6_online_packing(spark, none).count() == 0


def test_op7(spark, folder, none):
    import re

    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= sum(c.isdigit() for c in s) <= 19 and pii.luhn("".join(c for c in s if c.isdigit()))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= sum(c.isdigit() for c in s) <= 15),
    }
    df = pii.op7_bilstm_crf_pii(spark, folder)
    want, spans = collections.Counter(), {}
    for i, t in rows():
        found = sorted((m.start(), k, m.end()) for k, (name, (p, good)) in enumerate(patterns.items()) for m in re.finditer(p, t or "") if good(m.group()))
        base = ",".join(f"{list(patterns)[k]}:{a}:{b}" for a, k, b in found)
        want[(i, *[sum(k == n for _, k, _ in found) for n in range(4)], sha(base))] += 1
        spans[i, sha(base)] = set(base.split(",")) - {""}
    assert held(df, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    for r in df.collect():
        every = r["spans"].split(",") if r["spans"] else []
        assert spans[r["doc_id"], r["base_sha256"]] <= set(every)
        assert [int(s.split(":")[1]) for s in every] == sorted(int(s.split(":")[1]) for s in every)
        if r["doc_id"] == 14:
            at = texts()[14].index("555-010-9999")
            assert f"phone:{at}:{at + 12}" in every
    assert pii.op7_bilstm_crf_pii(spark, none).count() == 0


def test_op8(spark, folder, none):
    df = media.op8_interleaved_media(spark, folder)
    want = collections.Counter()
    for i, t in rows():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want[i, len(raw), len(payload), digest(payload), zlib.crc32(payload[-64:]), len(stored), digest(stored), media.picture_feature(payload)] += 1
    assert held(df, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature") == want
    assert media.op8_interleaved_media(spark, none).count() == 0


def test_op9(spark, folder, none):
    import base64

    given = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    owner = {}
    for i, h in given:
        if i is not None:
            owner[h or ""] = min(i, owner.get(h or "", i))
    want = collections.Counter()
    for i, h in given:
        raw, first = (h or "").encode(), owner.get(h or "")
        own = i == first
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else first] += 1
    assert held(archive.op9_content_archive(spark, folder), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert archive.op9_content_archive(spark, none).count() == 0


def test_op10(spark, folder, none, tokenizer):  # noqa: F811
    want = collections.Counter()
    for i, t in rows():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))] += 1
    assert held(bpe.op10_prefix_dp_bpe(spark, folder), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.op10_prefix_dp_bpe(spark, none).count() == 0


def brute_middle(i, t):
    t, x = t or "", hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    if not t or h3 % 100 >= 90 or any(m in t for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]
    return n, "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]


def test_op11(spark, folder, none):
    want = collections.Counter()
    for i, t in rows():
        *parts, out = brute_middle(i, t)
        want[(i, *parts, sha(out), sha(t or ""))] += 1
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert held(fill_middle.op11_fill_in_middle(spark, folder), *names) == want
    assert fill_middle.op11_fill_in_middle(spark, none).count() == 0


def test_op12(spark, folder, none):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert held(prefix_trie.op12_prefix_trie(spark, folder), *test_prefix_trie.COLUMNS) == test_prefix_trie.brute(rows)
    assert prefix_trie.op12_prefix_trie(spark, none).count() == 0


def test_op13(spark, folder, none):
    df = exact_dedup.op13_exact_dedup(spark, folder)
    assert held(df, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == test_exact_dedup.brute(rows())
    assert exact_dedup.op13_exact_dedup(spark, none).count() == 0


def test_pipeline(spark, folder, none):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert all(r[c] == f"mine {c}" for r in out.select(*CLASHING).collect() for c in CLASHING), name
        now = spark.createDataFrame(out.collect(), out.schema)
    kept = {r["doc_id"] for r in now.collect()}
    packed = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in packed.collect()} == kept
    assert corpus_pipeline.run(spark, none).count() == 0
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])
