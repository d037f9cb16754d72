"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and the middle is moved to the end.

Where code points begin comes from the tokenizers library: a Split pre-tokenizer whose pattern matches any
one code point and isolates each match. Nothing is trained. The length of the array of offsets is the number
of code points, and the offsets of the ranks drawn are where the text is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, tune

#: The marks of the parts in an output, and a pattern of all of them.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = "<[PSM]>"
#: Percent of texts that are cut, and of these that have the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Pieces whose offsets a worker remembers; code points of a text taken at once; how those are cut into pieces.
KNOWN = 1 << 18
RUN = 1 << 20
_PIECES = re.compile(r"(?s).[^\s]{0,4}").findall


class _Known(dict):
    """Offsets within a piece, as bytes, by piece; forgets all when there are too many."""

    def __init__(self):
        from tokenizers import Regex, pre_tokenizers

        self._split = pre_tokenizers.Split(Regex(r"[\x{0}-\x{10FFFF}]"), "isolated")

    def __missing__(self, piece: str) -> bytes:
        found = bytes(at for _, (at, _) in self._split.pre_tokenize_str(piece))
        if len(self) >= KNOWN:
            self.clear()
        self[piece] = found
        return found


_KNOWN: list[_Known] = []


def offsets(text: str) -> np.ndarray:
    """Where each code point of the text begins, by a Split pre-tokenizer with isolated matches; the length is their number.

    Each match is one code point whatever stands around it, so the offsets within a short piece are the same
    wherever it stands: a worker asks the pre-tokenizer once for a piece that recurs, remembers a bounded
    number of them, and shifts them to their place.
    """
    if not _KNOWN:
        _KNOWN.append(_Known())
    runs = [np.zeros(0, np.uint32)]
    for start in range(0, len(text), RUN):
        parts = list(map(_KNOWN[0].__getitem__, _PIECES(text[start : start + RUN])))
        sizes = np.fromiter(map(len, parts), np.uint32, len(parts))
        first = start + np.cumsum(sizes, dtype=np.uint32) - sizes
        runs.append(np.frombuffer(b"".join(parts), np.uint8) + np.repeat(first, sizes))
    return np.concatenate(runs)


class Middled(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def middled(text: str, draws: tuple[int, int, int, int]) -> Middled:
    """The text with its middle moved to the end: psm or spm, or plain where it is left as it is."""
    at = offsets(text)
    n = len(at)
    h1, h2, h3, h4 = draws
    if not n or h3 % 100 >= CUT or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return Middled(n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m = (int(at[k]) if k < n else len(text) for k in (a, b))
    prefix, middle, suffix = text[:p], text[p:m], text[m:]
    if h4 % 100 < SUFFIX_FIRST:
        return Middled(n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Middled(n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def with_middles_last(df: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """df with n, form, prefix_chars, middle_chars and output for every row; of its own columns those of carry, or all.

    The draws are the first four groups of eight digits of the SHA-256 of `1:` and the decimal id, so a row gets
    the same cut in every run and partitioning. A null text counts as empty and is plain; a null id draws as an
    empty one; texts that hold a mark are plain; repeated rows give equal rows; no rows give none. A column of df
    called like one of the five is replaced.
    """
    tune(df.sparkSession)
    draws = free_name(df, "draws")
    hexed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    given = df.withColumn(draws, F.array(*[F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]))
    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in added]
    carried = [df.schema[c] for c in kept]
    own_text = kept.index(text_col) if text_col in kept else len(kept)
    text = [] if text_col in kept else [F.col(f"`{text_col}`")]
    given = given.select(*[F.col(f"`{c}`") for c in kept], *text, draws)
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [middled(t.as_py() or "", d.as_py()) for t, d in zip(batch.column(own_text), batch.columns[-1])]
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *[pa.array(c, t) for c, t in zip(columns, types)]], [*kept, *added])

    made = ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in zip(added, types))
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in carried], made])
    return given.mapInArrow(run, ddl)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of.

    A text that is cut holds no mark, and no mark can arise across the edge of another, so the three marks of an
    output are the ones that were put there.
    """
    part = F.split(output, MARKS)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, sizes of the parts, and digests of the output and of the text rebuilt from it, for every document.

    Null texts are empty and plain; a null doc_id draws as an empty one; repeated rows give equal rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_middles_last(docs, "doc_id", "text", ["doc_id"])
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
