"""Quality rules as a short-circuit cascade, ordered by rejections per cost measured on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE_CLASS, bind, table, words_of, written

#: Positions of up to this many bits share a long with a hash; longer texts take the exact path.
_POS_BITS = 20
_POS_MASK = (1 << _POS_BITS) - 1


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("long")


def n_upper(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{Lu}]+", "")).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.concat_ws("", words)).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(
        F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WHITE_CLASS.replace("[", "[^"))
    )


def line_counts(text: Column) -> Column:
    """Struct (lines, dups) of longs: lines with a word, and those of them equal to an earlier one."""
    return bind(
        lines_with_words(text),
        lambda a: F.struct(F.size(a).cast("long").alias("lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dups")),
    )


def n_dup_lines(text: Column) -> Column:
    return line_counts(text)["dups"]


def _covered(starts: Column) -> Column:
    """Words in the union of the 3-word windows at these sorted starts."""
    gaps = F.transform(starts, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - x, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)


def _repeats_exact(words: Column) -> Column:
    """n_repeat_words by sorting the windows themselves; for texts that the hashed path declines."""
    windows = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.struct(F.slice(words, i + 1, F.lit(3)).alias("w"), i.alias("i")),
        )
    )
    found = bind(
        windows,
        lambda s: F.array_sort(
            F.transform(
                F.filter(
                    s,
                    lambda x, k: F.coalesce(F.get(s, k - 1)["w"] == x["w"], F.lit(False))
                    | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    return bind(found, _covered)


def n_repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are hashed, and (hash, position) pairs packed in longs are sorted, so equal windows
    become neighbours in linear memory. Neighbours are then compared as words: a text in which two
    different windows share a hash, or with more positions than the packing holds, takes the exact
    path, so the count is exact.
    """

    def hashed(w: Column) -> Column:
        packed = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.shiftleft(
                F.shiftright(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), _POS_BITS), _POS_BITS
            ).bitwiseOR(i.cast("long")),
        )

        def same(a: Column, b: Column) -> Column:
            return F.coalesce(F.shiftright(a, _POS_BITS) == F.shiftright(b, _POS_BITS), F.lit(False))

        def window(x: Column) -> Column:
            return F.slice(w, x.bitwiseAND(F.lit(_POS_MASK)).cast("int") + 1, F.lit(3))

        def verified(d: Column) -> Column:
            clash = F.exists(
                F.transform(d, lambda x, k: same(F.get(d, k - 1), x) & (window(F.get(d, k - 1)) != window(x))),
                lambda bad: bad,
            )
            starts = F.sort_array(F.transform(d, lambda x: x.bitwiseAND(F.lit(_POS_MASK)).cast("int")))
            return F.when(clash, F.lit(None).cast("int")).otherwise(bind(starts, _covered))

        twice = bind(
            F.sort_array(packed),
            lambda s: F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x)),
        )
        return bind(twice, verified)

    n = F.size(words)
    fast = F.when(n <= _POS_MASK, hashed(words))
    return (
        F.when(n < 3, F.lit(0)).otherwise(F.coalesce(fast, _repeats_exact(words))).cast("long")
    )


class Measures:
    """What rules look at: a text, its words, and counts made of them, or taken from columns that hold them already."""

    def __init__(self, text: Column, words: Column, **known: Column):
        self.text, self.words, self._known = text, words, known

    def _of(self, name: str, make) -> Column:
        return self._known[name] if name in self._known else make()

    @property
    def n_words(self) -> Column:
        return self._of("n_words", lambda: F.size(self.words))

    @property
    def word_chars(self) -> Column:
        return self._of("word_chars", lambda: word_chars(self.words))

    @property
    def n_symbols(self) -> Column:
        return self._of("n_symbols", lambda: n_symbols(self.text))

    @property
    def n_upper(self) -> Column:
        return self._of("n_upper", lambda: n_upper(self.text))

    @property
    def n_repeat_words(self) -> Column:
        return self._of("n_repeat_words", lambda: n_repeat_words(self.words))

    @property
    def lines(self) -> Column:
        """Struct (lines, dups)."""
        return self._of("lines", lambda: line_counts(self.text))


@dataclass(frozen=True)
class Rule:
    """name and the condition, over Measures, under which a document goes."""

    name: str
    rejects: Callable[[Measures], Column]


def default_rules() -> list[Rule]:
    return [
        Rule("too_short", lambda m: m.n_words < 50),
        Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
        Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
        Rule("capitals", lambda m: 10 * m.n_upper > 4 * m.word_chars),
        Rule("repeated_lines", lambda m: bind(m.lines, lambda x: 2 * x["dups"] > x["lines"])),
        Rule("word_length", lambda m: bind(m.word_chars, lambda n: (n < 2 * m.n_words) | (n > 20 * m.n_words))),
    ]


@dataclass(frozen=True)
class Estimate:
    """A rule's measured seconds for the sample and the share of the sample that it rejects."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def plan_cascade(docs: DataFrame, rules: list[Rule], sample_rows: int = 256, least_seconds: float = 0.1, measured: bool = False) -> list[Estimate]:
    """The rules by falling share of rejected rows per second, on a sample of about sample_rows rows.

    Rows are drawn evenly over the whole table and written once; their number is bounded by four times
    sample_rows. A rule runs over so many copies of the sample that it takes least_seconds longer than
    a rule that does nothing, which outweighs what starting a job takes. The order sets only how soon a
    row's verdict is known, never the verdict. An empty table keeps the rules' order. measured: the cascade that
    is planned runs over with_measures(), so a rule costs what it does on columns that are there.
    """
    n = docs.count()
    if not n:
        return [Estimate(r, 0.0, 0.0) for r in rules]
    text, words = F.col("text"), F.col("words")
    measures = Measures(text, words, **{c: F.col(c) for c in MEASURED}) if measured else Measures(text, words)
    drawn = docs.select("text").sample(min(1.0, sample_rows / n), 7).limit(4 * sample_rows)
    sample = written(drawn).withColumn("words", words_of(text))
    if measured:
        sample = written(with_measures(sample))
    n_sample = max(sample.count(), 1)

    def timed(condition: Column, copies: int) -> tuple[float, int]:
        query = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies)))).agg(F.count_if(condition).alias("n"))
        began = time.perf_counter()
        found = query.first()["n"]
        return time.perf_counter() - began, found

    idle: dict[int, float] = {}

    def idle_for(copies: int) -> float:
        if copies not in idle:
            idle[copies] = min(timed(F.size(words) < 0, copies)[0] for _ in range(2))
        return idle[copies]

    idle_for(1)
    found = []
    for rule in rules:
        condition, copies = rule.rejects(measures), 1
        timed(condition, copies)  # compiles it
        while True:
            seconds, rejected = timed(condition, copies)
            if seconds - idle_for(copies) >= least_seconds or copies >= 64:
                break
            copies *= 8
        found.append(Estimate(rule, max(seconds - idle_for(copies), 0.0) / copies, rejected / copies / n_sample))
    return sorted(found, key=lambda e: (-e.gain, e.seconds, e.rule.name))


def cascade(measures: Measures, rules: list[Rule]) -> Column:
    """Name of the first rule, in this order, that rejects; null if none. Later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(measures), F.lit(rule.name)).otherwise(out)
    return out


def quality_filter(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 256) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects.

    Null and empty texts have no words and are rejected as too short; repeated rows get equal
    verdicts; an empty table stays empty; other columns are carried along untouched.
    """
    order = [e.rule for e in plan_cascade(docs, rules or default_rules(), sample_rows)]
    # Bound, not a column: a filter on a column is moved below it, and its lambdas would split the text anew.
    text = F.col("text")
    return docs.where(bind(words_of(text), lambda words: cascade(Measures(text, words), order)).isNull())


#: The columns that with_measures() adds, named as in Measures.
MEASURED = ("n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")


def with_measures(docs: DataFrame) -> DataFrame:
    """docs (text, words, …) with what the rules measure."""
    text, words = F.col("text"), F.col("words")
    return docs.select(
        "*", F.size(words).cast("long").alias("n_words"), word_chars(words).alias("word_chars"), n_symbols(text).alias("n_symbols"), line_counts(text).alias("lines"),
        n_repeat_words(words).alias("n_repeat_words"),
    )


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document.

    Null, empty and blank texts have no words and fail the base rules; a null doc_id is kept; repeated
    rows get equal rows; no rows give none. The cascade takes the counts measured already.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text, words = F.col("text"), F.col("words")
    own = [r for r in default_rules() if r.name not in ("too_short", "repeated_words")]
    order = [e.rule for e in plan_cascade(docs, own, measured=True)]
    measured = with_measures(docs.withColumn("words", words_of(text)))
    known = {c: F.col(c) for c in MEASURED}
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.dups").alias("n_dup_lines"), "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(Measures(text, words, **known), order).isNull()).alias("kept"),
    )
