"""Word BPE by dynamic programming over prefixes, and its decoding.

A word is a string over 512 symbols: a byte, or a last byte (the byte plus 256). An automaton with
suffix links reports, at every prefix, the vocabulary entries that end there. Of these, exactly one
is the last token of the prefix's encoding: the one whose pair with the last token of the prefix
before it is compatible. It is stored per prefix, and back-pointers from the full word give the ids.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune

#: Words, and as many chunks between white space, kept per Python worker before its tables are emptied; bounds memory, not results.
CACHE_WORDS = 300_000
CACHE_PAIRS = 1_000_000
_END = "</w>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, inverted."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Memo(dict):
    """A dict that computes missing values and empties itself at a size."""

    def __init__(self, make, most: int):
        super().__init__()
        self._make, self._most = make, most

    def __missing__(self, key):
        if len(self) >= self._most:
            self.clear()
        value = self[key] = self._make(key)
        return value


def _latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@functools.cache
def _unassigned() -> str:
    """Letters and digits, as the regex module has them, that Python's own, earlier tables lack."""
    import regex

    return "".join(
        regex.findall(
            r"[\p{L}\p{N}]", "".join(c for c in map(chr, range(0x370, 0xE0000)) if unicodedata.category(c) == "Cn")
        )
    )


@functools.cache
def _late_lower() -> dict[int, str]:
    """Lower case of those letters, as the tokenizers library has it."""
    from tokenizers import normalizers

    lower = normalizers.Lowercase().normalize_str
    return {ord(c): low for c in _unassigned() if (low := lower(c)) != c}


@functools.cache
def _nfc():
    from tokenizers import normalizers

    return normalizers.NFC().normalize_str


def normalised(text: str) -> str:
    """text in normal form C and lower case, as the file's normaliser has it.

    The composition is the tokenizers library's own: Python's tables are of another Unicode version
    and order some marks otherwise. Latin-1 text is in normal form C.
    """
    if not text.isascii() and not _latin1(text):
        # One letter at a time, as the file's normaliser does: no special form for a final sigma.
        text = _nfc()(text).replace("Σ", "σ").translate(_late_lower())
    return text.lower()


def _ranges(letters: str) -> str:
    """The letters as ranges for a character class."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, set(letters))):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@functools.cache
def _word_patterns():
    """findall for words; a search for letters and digits whose class differs between Unicode versions,
    and a findall for texts that have any.

    The regex module knows a later Unicode than the tokenizers library. Code points that Python's own,
    earlier tables leave unassigned are put to the library.
    """
    import regex
    from tokenizers import Regex, pre_tokenizers

    new = _unassigned()
    known = {
        c for p in (r"\p{L}", r"\p{N}")
        for w, _ in pre_tokenizers.Split(Regex(p), "removed", invert=True).pre_tokenize_str(new) for c in w
    }
    odd = _ranges("".join(set(new) - known))
    plain = regex.compile(r"\p{L}+|\p{N}|'(?:s|t|re|ve|m|ll|d)|[^\s\p{L}\p{N}]+").findall
    if not odd:
        return plain, lambda text: None, plain
    other = regex.compile(
        r"(?V1)[\p{L}--[" + odd + r"]]+|[\p{N}--[" + odd + r"]]|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\p{L}\p{N}]|[" + odd + "])+"
    )
    return plain, re.compile("[" + odd + "]").search, other.findall


#: Space to str.split(), not to the tokenizer file's pattern.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")


def chunks(text: str) -> list[str]:
    """The normalised text, without special tokens, cut at white space. No word spans two chunks."""
    import regex

    text = normalised(text)
    if _SEPARATORS.search(text):
        return [c for c in regex.split(r"\s+", text) if c]
    return text.split()


def split_words(chunk: str) -> list[str]:
    """Words of a chunk, as the tokenizer file's pattern splits them."""
    if chunk.isalpha():  # letters of Python's tables are letters of the pattern's
        return [chunk]
    if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
        return [chunk[:-1], chunk[-1]]
    plain, odd, other = _word_patterns()
    if not chunk.isascii() and not _latin1(chunk) and odd(chunk):
        return other(chunk)
    return plain(chunk)


class WordBpe:
    """Encoder and decoder of a word-end byte BPE file (text of a tokenizers JSON)."""

    def __init__(self, text: str):
        import ahocorasick
        import regex

        spec = json.loads(text)
        model, letters = spec["model"], _byte_letters()
        self.tokens: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.tokens |= {i: t for t, i in special.items()}

        def symbols(token: str) -> str:
            end = token.endswith(_END)
            body = [letters[c] for c in token.removesuffix(_END)]
            if end:
                body[-1] += 256
            return "".join(map(chr, body))

        ids = model["vocab"]
        self._string = {i: symbols(t) for t, i in ids.items() if t not in special}
        #: pair of ids -> (rank, merged id); parts: merged id -> (rank, left, right)
        self._merge: dict[tuple[int, int], tuple[int, int]] = {}
        self._parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = ids[left + right]
            self._merge[ids[left], ids[right]] = (rank, made)
            self._parts.setdefault(made, (rank, ids[left], ids[right]))
        self._spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self._fits = _Memo(self._compatible, CACHE_PAIRS)
        automaton = ahocorasick.Automaton()
        self._whole: dict[int, bool] = {}
        for i, s in self._string.items():
            if self._reachable(i):
                automaton.add_word(s, (i, len(s)))
        automaton.make_automaton()
        self._automaton = automaton
        self._split_special = regex.compile("|".join(map(regex.escape, special))).split if special else None
        self._find_special = regex.compile("|".join(map(regex.escape, special))).findall if special else None
        self._word_text = _Memo(lambda w: " ".join(map(str, self._encode_word(w))), CACHE_WORDS)
        self._chunk_text = _Memo(lambda c: " ".join([self._word_text[w] for w in split_words(c)]), CACHE_WORDS)

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at the left (0) or right (1) edge while token is built: (token, rank of the merge that ends it)."""
        key = (token, side)
        if key not in self._spines:
            out, ends = [], float("inf")
            while True:
                out.append((token, ends))
                part = self._parts.get(token)
                if part is None:
                    break
                ends, token = part[0], part[1 + side]
            self._spines[key] = out[::-1]
        return self._spines[key]

    def _meets(self, left: int, right: int, before: float) -> bool:
        """Whether some merge of rank under before joins left's edge to right's while both are being built."""
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            rank = self._merge.get((x, y), (float("inf"),))[0]
            # Of equal merges the leftmost goes first: x may be taken at its own rank, y may not.
            if rank < before and rank < x_ends and rank <= y_ends:
                return True
            if x_ends == y_ends == float("inf"):
                return False
            if x_ends <= y_ends:
                i += 1
            if y_ends <= x_ends:
                j += 1

    def _compatible(self, pair: tuple[int, int]) -> bool:
        return not self._meets(*pair, before=float("inf"))

    def _reachable(self, token: int) -> bool:
        """Whether the token's own string encodes to just this token."""
        if token not in self._whole:
            part = self._parts.get(token)
            self._whole[token] = part is None or (
                self._reachable(part[1]) and self._reachable(part[2]) and not self._meets(part[1], part[2], part[0])
            )
        return self._whole[token]

    def encode_symbols(self, s: str) -> list[int]:
        n = len(s)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        fits = self._fits
        for end, (token, length) in self._automaton.iter(s):
            end += 1
            start = end - length
            if last[end] < 0 and (start == 0 or last[start] >= 0 and fits[last[start], token]):
                last[end], size[end] = token, length
        out, i = [], n
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def _encode_word(self, word: str) -> list[int]:
        s = word.encode("utf-8", "surrogatepass").decode("latin-1")
        return self.encode_symbols(s[:-1] + chr(ord(s[-1]) + 256))

    def stretches(self, text: str) -> Iterator[tuple[list[str], str | None]]:
        """Chunks, and the special token after them if any."""
        if self._find_special is None or "<|" not in text:
            yield chunks(text), None
            return
        parts, found = self._split_special(text), self._find_special(text)
        for k, part in enumerate(parts):
            yield chunks(part), found[k] if k < len(found) else None

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.id_text(text).split()]

    def id_text(self, text: str) -> str:
        """The decimal ids joined by one space."""
        out: list[str] = []
        for parts, special in self.stretches(text):
            out += map(self._chunk_text.__getitem__, parts)
            if special:
                out.append(str(self.special[special]))
        return " ".join(out)

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))

    def decode_id_text(self, text: str, memo: dict[str, str]) -> str:
        """decode() of decimal ids joined by one space."""
        return " ".join(map(memo.__getitem__, text.split(" "))) if text else ""

    def decimal_tokens(self) -> dict[str, str]:
        return {str(i): t for i, t in self.tokens.items()}


_LOADED: dict[str, WordBpe] = {}


def load(text: str) -> WordBpe:
    """The encoder of this file, built once in each Python process."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(text)
    return _LOADED[key]


def broadcast_file(spark: SparkSession, path: str | None):
    """The tokenizer file's text for the executors; its size is the vocabulary's, whatever the data."""
    with open(path or default_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """id_col, n_tokens, ids (decimal, joined by one space) and decoded, for every row of df.

    A null text counts as empty; an empty text has no ids and decodes to an empty text; repeated
    rows give equal rows; an empty table gives none; other columns of df are not carried.
    """
    spark = df.sparkSession
    tune(spark)
    source = broadcast_file(spark, path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(source.value)
        spelled = bpe.decimal_tokens()
        for batch in batches:
            ids = [bpe.id_text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()),
                    pa.array(ids, pa.string()),
                    pa.array([bpe.decode_id_text(x, spelled) for x in ids], pa.string()),
                ],
                ["id", "n_tokens", "ids", "decoded"],
            )

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens long, ids string, decoded string"
    )
    return out.withColumnRenamed("id", id_col)


def digest_documents(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """encode_documents() with the SHA-256 of ids and of the decoded text in their place.

    Hashed in the worker: the long forms don't leave it.
    """
    spark = df.sparkSession
    tune(spark)
    source = broadcast_file(spark, path)
    kind = df.schema[id_col].dataType.simpleString()

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(source.value)
        spelled = bpe.decimal_tokens()
        for batch in batches:
            rows = []
            for t in batch.column(1):
                ids = bpe.id_text(t.as_py() or "")
                rows.append((ids.count(" ") + 1 if ids else 0, sha(ids), sha(bpe.decode_id_text(ids, spelled))))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return out.withColumnRenamed("id", id_col)


def op10_prefix_dp_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens, digest of the ids and digest of what they decode to, for every document.

    A null text is an empty one and has no ids; a null doc_id is kept; repeated rows give equal rows; no rows give none.
    """
    return digest_documents(table(spark, sf_dir, "documents"), "doc_id", "text")
