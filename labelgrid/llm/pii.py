"""Personal data: spans of fixed patterns, and more found by a character-level BiLSTM-CRF."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tagger
from .common import in_groups, table, tune
from .tagger import KINDS

Span = tuple[int, int, int]  # start, kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match ends at the end of a run of digits, so the next begins at the start of one.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CLUE = re.compile(r"[0-9@]")
_PHONE_LOOSE = re.compile(r"\+?[0-9(][\x20()./0-9-]+[0-9]")

#: Windows of WIDTH characters, STEP apart: they overlap by WIDTH - STEP.
WIDTH, STEP = 256, 224
_EDGE = (WIDTH - STEP) // 2
#: Windows scored together, and so what is held of a text's scores at once; runs decoded together. Products of
#: this size are too small for NumPy's BLAS to share among threads, which cost more CPU time than they save.
_BLOCK = 1024
#: Weights of a window's scores where windows overlap: a window knows least at its edges.
_TAPER = np.minimum(1, np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1)) / (WIDTH - STEP + 1)).astype(np.float32)


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_ip(s: str) -> bool:
    return all(map(_byte, s.split(".")))


def is_card(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def is_phone(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern in linear time: each takes the run of local letters before an @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind. Kinds may overlap one another."""
    found: list[Span] = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if _CLUE.search(text):
        for kind, pattern, good in ((1, _IP, is_ip), (2, _CARD, is_card), (3, _PHONE, is_phone)):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if good(m.group())]
    return sorted(found)


def text_scores(texts: list[str], parameters: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs (places, scores) of the texts laid end to end, each text after _EDGE places of padding and before as many.

    Windows cover every character, and where they overlap their scores are averaged by _TAPER. Runs
    follow one another; no more than about _BLOCK windows are held, however long a text is.
    """
    pad = np.zeros(_EDGE, np.int8)
    x = np.concatenate([a for t in texts for a in (pad, tagger.classes(t), pad)])
    n_windows = max(1, -(-(len(x) - WIDTH) // STEP) + 1)
    x = np.concatenate([x, np.zeros((n_windows - 1) * STEP + WIDTH - len(x), np.int8)])
    views = np.lib.stride_tricks.sliding_window_view(x, WIDTH)[::STEP]
    weight = np.zeros(WIDTH - STEP, np.float32)  # of what the windows before have given to the places they share
    given = np.zeros((WIDTH - STEP, tagger.N_TAGS), np.float32)
    for at in range(0, n_windows, _BLOCK):
        e = tagger.scores(views[at : at + _BLOCK], parameters)
        n = len(e)
        total = np.zeros(((n - 1) * STEP + WIDTH, tagger.N_TAGS), np.float32)
        weights = np.zeros(len(total), np.float32)
        total[: WIDTH - STEP], weights[: WIDTH - STEP] = given, weight
        e = e * _TAPER[:, None]
        total[: n * STEP] += e[:, :STEP].reshape(-1, tagger.N_TAGS)
        weights[: n * STEP] += np.tile(_TAPER[:STEP], n)
        tail = np.arange(n)[:, None] * STEP + np.arange(STEP, WIDTH)
        total[tail] += e[:, STEP:]
        weights[tail] += _TAPER[STEP:]
        done = len(total) if at + n == n_windows else n * STEP
        given, weight = total[n * STEP :], weights[n * STEP :]
        yield at * STEP, total[:done] / weights[:done, None]


def decoded(texts: list[str], parameters: dict) -> tuple[np.ndarray, np.ndarray]:
    """(places, tags): the tags that are not outside on the best path over each whole text.

    Places count over the texts laid end to end as in text_scores(). Where outside leads by far for
    long enough the path is certain (tagger.certainty); only the stretches between are decoded, which
    gives the path that decoding every place would.
    """
    lead, reach = tagger.certainty(parameters)
    held: list[tuple[int, np.ndarray]] = []  # (start, scores) of stretches that may hold a span
    tail = np.empty((0, tagger.N_TAGS), np.float32)
    for start, e in text_scores(texts, parameters):
        e = np.concatenate([tail, e])
        start -= len(tail)
        doubt = np.flatnonzero(e[:, 0] - e[:, 1:].max(axis=1) < lead)
        edges = np.flatnonzero(np.diff(doubt) > 2 * reach) if len(doubt) else doubt
        firsts, lasts = (doubt[np.concatenate([[0], edges + 1])], doubt[np.concatenate([edges, [-1]])]) if len(doubt) else (doubt, doubt)
        for a, b in zip(firsts.tolist(), lasts.tolist()):
            a, b = max(0, a - reach), min(len(e), b + reach + 1)
            held.append((start + a, e[a:b].copy()))
        tail = e[max(0, len(e) - 2 * reach) :]
    return _paths(_joined(held), tagger.transitions(parameters))


def _joined(held: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """Stretches in order, those that meet or overlap made one."""
    out: list[tuple[int, np.ndarray]] = []
    for start, e in held:
        if out and start <= out[-1][0] + len(out[-1][1]):
            first, before = out[-1]
            out[-1] = (first, np.concatenate([before[: start - first], e]) if start + len(e) > first + len(before) else before)
        else:
            out.append((start, e))
    return out


def _paths(stretches: list[tuple[int, np.ndarray]], move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    stretches.sort(key=lambda s: len(s[1]))
    places, tags = [np.empty(0, np.int64)], [np.empty(0, np.int8)]
    for at in range(0, len(stretches), _BLOCK):
        some = stretches[at : at + _BLOCK]
        longest = len(some[-1][1])
        e = np.zeros((len(some), longest, tagger.N_TAGS), np.float32)
        e[:, :, 0] = 1e3  # behind a stretch's end all is outside
        for k, (_, own) in enumerate(some):
            e[k, : len(own)] = own
        found = tagger.best_path(e, move)
        k, i = np.nonzero(found)
        places.append(np.array([s for s, _ in some])[k] + i)
        tags.append(found[k, i])
    places, tags = np.concatenate(places), np.concatenate(tags)
    order = np.argsort(places, kind="stable")
    return places[order], tags[order]


def tagged_spans(texts: list[str], parameters: dict) -> list[list[Span]]:
    """For each text the spans that the tagger finds in it, by start."""
    places, tags = decoded(texts, parameters) if texts else (np.empty(0, np.int64), np.empty(0, np.int8))
    out: list[list[Span]] = []
    at = 0
    for text in texts:
        a, b = np.searchsorted(places, [at, at + len(text) + 2 * _EDGE])
        out.append(_spans((places[a:b] - at - _EDGE).tolist(), tags[a:b].tolist(), len(text)))
        at += len(text) + 2 * _EDGE
    return out


def _spans(places: list[int], tags: list[int], size: int) -> list[Span]:
    """Spans of the tags at these places: an inner tag goes on with the span of its kind just before it."""
    spans: list[Span] = []
    for place, tag in zip(places, tags):
        kind = (tag - 1) // 2
        if tag % 2 == 0 and spans and spans[-1][1] == kind and spans[-1][2] == place:
            spans[-1] = (spans[-1][0], kind, place + 1)
        else:
            spans.append((place, kind, place + 1))
    return [(max(a, 0), k, min(b, size)) for a, k, b in spans if b > 0 and a < size]


def _good(kind: int, s: str) -> bool:
    """Whether a tagged string can be what its tag says, though the base pattern did not take it.

    An address may lack a dot or have letters the pattern does not know; an IP or a card number may stand among other
    digits, with which the pattern took it and let it go; a phone number may lack the plus sign, and then has 10 digits, or 11
    with a leading 1: that is how numbers are written within a country, and shorter or longer runs are mostly not numbers to call.
    """
    if kind == 0:
        return s.count("@") == 1 and 0 < s.index("@") < len(s) - 1 and not any(map(str.isspace, s))
    if kind == 1:
        return _IP.fullmatch(s) is not None and is_ip(s)
    if kind == 2:
        return _CARD.fullmatch(s) is not None and is_card(s)
    return _PHONE_LOOSE.fullmatch(s) is not None and (is_phone(s) if s[0] == "+" else 10 <= len(_digits(s)) <= 11)


def added_spans(text: str, tagged: list[Span], base: list[Span]) -> list[Span]:
    """Tagged spans, grown to the edges of their words, that pass _good() and meet no base span."""
    starts, ends = _covered(base)
    out: list[Span] = []
    for start, kind, end in tagged:
        if kind in (0, 3):
            while start > 0 and text[start - 1].isalnum() and text[start].isalnum():
                start -= 1
            while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
                end += 1
        while start < end and text[start].isspace():
            start += 1
        while end > start and (text[end - 1].isspace() or text[end - 1] in ".,;:"):
            end -= 1
        k = bisect.bisect_left(starts, end)  # of what is covered only the last run that begins before end can reach past start
        if start < end and (not k or ends[k - 1] <= start) and _good(kind, text[start:end]):
            out.append((start, kind, end))
            starts.insert(k, start)
            ends.insert(k, end)
    return out


def _covered(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs that spans, by start, cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span, or run of overlapping spans, replaced by the name of the first one's kind."""
    out, done = [], 0
    for a, k, b in spans:
        if a >= done:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _mapped(df: DataFrame, text_col: str, ddl: str, fields: list[pa.Field], row) -> DataFrame:
    """df's columns and fields, made by row(text, base, spans) for each row."""
    tune(df.sparkSession)
    parameters = tagger.trained()
    names, at = df.columns, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            made = []
            for group in in_groups(texts):
                for text, tagged in zip(group, tagged_spans(group, parameters)):
                    base = base_spans(text)
                    made.append(row(text, base, sorted(base + added_spans(text, tagged, base))))
            columns = list(zip(*made)) if made else [()] * len(fields)
            extra = [pa.array(c, f.type) for c, f in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *extra], schema=pa.schema([*batch.schema, *fields])
            )

    kept = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    return df.mapInArrow(run, f"{kept}, {ddl}")


def find_personal_data(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, counts of base spans by kind, base_sha256, n_added and all spans, for each row of df.

    Base spans come from the fixed patterns; the tagger adds spans that meet none of them. A null
    text counts as empty; an empty text has no spans; repeated rows give equal rows; an empty table
    gives none; other columns are not carried.
    """

    def row(text: str, base: list[Span], spans: list[Span]) -> tuple:
        counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
        return (*counts, hashlib.sha256(spelled(base).encode()).hexdigest(), len(spans) - len(base), spelled(spans))

    fields = [pa.field(f"n_{k}", pa.int64()) for k in KINDS]
    fields += [pa.field("base_sha256", pa.string()), pa.field("n_added", pa.int64()), pa.field("spans", pa.string())]
    ddl = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in fields)
    return _mapped(df.select(id_col, text_col), text_col, ddl, fields, row).drop(text_col)


def redact_personal_data(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data in text replaced by the name of its kind; null texts stay null."""
    spare = "__redacted"
    while spare in docs.columns:
        spare += "_"
    found = _mapped(
        docs, "text", f"`{spare}` string", [pa.field(spare, pa.string())], lambda text, base, spans: (redacted(text, spans),)
    )
    return found.withColumn(
        "text", F.when(F.col("text").isNotNull(), F.col(spare))
    ).drop(spare)


def op7_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts of base spans, their digest and all spans.

    Null and empty texts have no spans; a null doc_id is kept; repeated rows give equal rows; no rows give none.
    """
    found = find_personal_data(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added")
