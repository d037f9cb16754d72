"""Line deduplication over a corpus by a join of deletion neighbourhoods.

A line is its words in lower case; an edit inserts, deletes or replaces one word. Two lines within
one edit become equal when one word is deleted from each (from the longer only, if they differ in
length). Every such variant is emitted as a hashed key; lines that share a key are compared word by
word with the earliest of them, and all but the earliest go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE_CLASS, bind, free_name, own_name, table, written

#: Shorter lines are dropped only if equal to an earlier one: an edit would change too much of them.
MIN_EDIT_WORDS = 8
#: Words between two kept XORs of a line's hashes.
BLOCK = 32


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.lit(1), F.coalesce(text, F.lit("")))


def tidy(line: Column) -> Column:
    """The line in lower case, its words joined by single spaces."""
    low = F.lower(line)
    odd = low.rlike(r"[\x09-\x0D]|\x20\x20|^\x20|\x20$")
    return F.when(odd, F.btrim(F.regexp_replace(low, WHITE_CLASS + "+", " "), F.lit(" "))).otherwise(low)


def _half_keys(line: Column, n: Column) -> Column:
    """Struct array (head, half): hashes of the first and the last half of a tidy line of n words.

    Cut as for a partner of n words and of n - 1. One edit leaves a half untouched, so lines without
    a common key have no partner; a common head puts the edit behind it, a common tail before it.
    """
    p1, p2 = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")

    def head(k: Column) -> Column:
        return F.struct(F.lit(True).alias("head"), F.xxhash64(F.lit(0), k, F.call_function("substring_index", line, F.lit(" "), k)).alias("half"))

    def tail(k: Column) -> Column:
        return F.struct(F.lit(False).alias("head"), F.xxhash64(F.lit(1), k, F.call_function("substring_index", line, F.lit(" "), -k)).alias("half"))

    return F.array_distinct(F.array(head(p1), head(p2), tail(n - p1), tail(n - 1 - p2)))


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line with a word: doc, text_key, pos, the line's key (a, b), n and halves. No text."""
    lines = docs.select(
        F.col("doc_id").alias("doc"), _text_key(F.col("text")).alias("text_key"),
        F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line"),
    ).where(F.col("line").rlike(WHITE_CLASS.replace("[", "[^")))
    line = F.col("line")
    keyed = lines.withColumn("line", tidy(line)).select(
        "*", (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("n")
    )
    return keyed.select(
        "doc", "text_key", "pos", F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"), "n",
        F.when(F.col("n") >= MIN_EDIT_WORDS, _half_keys(line, F.col("n"))).alias("halves"),
    )


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One row per different line: key, its earliest place, how often it occurs, n and halves."""
    return lines.groupBy("a", "b").agg(
        F.min(F.struct("doc", "pos")).alias("first"), F.count(F.lit(1)).alias("times"),
        F.first("n").alias("n"), F.first("halves").alias("halves"),
    )


def _candidates(distinct: DataFrame) -> DataFrame:
    """(a, b, head, tail): lines that share a half with another line, and which of their halves."""
    halves = distinct.where(F.col("halves").isNotNull()).select("a", "b", F.inline("halves"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("half")
    met = halves.join(written(shared), "half", "left_semi")
    return met.groupBy("a", "b").agg(F.bool_or("head").alias("head"), F.bool_or(~F.col("head")).alias("tail"))


def _candidate_texts(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b, doc, pos, n, head, tail, words) of the candidates, each read at its earliest place."""
    chosen = _candidates(distinct).join(distinct.select("a", "b", "first", "n"), ["a", "b"])
    wanted = chosen.groupBy(F.col("first.doc").alias("doc")).agg(
        F.collect_list(F.struct("a", "b", F.col("first.pos").alias("pos"), "n", "head", "tail")).alias("lines")
    )
    # merge: wanted grows with the corpus, and its files are far smaller than its rows in memory.
    found = docs.select("doc_id", "text").join(written(wanted).hint("merge"), F.col("doc_id").eqNullSafe(F.col("doc")))
    parts = found.select("doc", F.split("text", "\n").alias("parts"), "lines").select("doc", "parts", F.inline("lines"))
    line = parts.select("a", "b", "doc", "pos", "n", "head", "tail", tidy(F.get("parts", F.col("pos"))).alias("line"))
    # Rows that share a doc_id may have other texts; dropDuplicates is for rows repeated whole.
    return line.where((F.xxhash64("line") == F.col("a")) & (F.xxhash64(F.lit(7), "line") == F.col("b"))).dropDuplicates(["a", "b"]).select(
        "a", "b", "doc", "pos", "n", "head", "tail", F.split("line", " ").alias("words")
    )


def _xor(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """Hashed keys of each line's variants: (variant, proof, shortened, doc, pos, a, b).

    A line of n words gives its own key as (n, -1); for each word j that an edit may have touched,
    the key (n, j), which it shares with lines that have another word there, and the key (n - 1, -1),
    which it shares with the line that lacks the word. A hash is the XOR of the hashes of (place,
    word), so it keeps the order; words behind a deleted one count at the place before theirs. proof
    is a second hash of the same with another seed. XORs up to each BLOCK-th word are kept, so a
    variant reads at most BLOCK words.
    """
    n, w = F.col("n"), F.col("words")
    middle = F.floor((n - 1) / 2).cast("int")
    touched = F.sequence(F.when(F.col("tail"), 0).otherwise(middle), F.when(F.col("head"), n - 1).otherwise(middle))

    def placed(seed: int, shift: int) -> Column:
        return F.transform(w, lambda x, i: F.xxhash64(F.lit(seed), i - shift, x))

    def scanned(terms: Column) -> Column:
        """terms, their XORs up to each BLOCK-th and the XOR of all."""
        starts = F.sequence(F.lit(0), F.floor(n / BLOCK).cast("int"))
        upto = lambda t: F.transform(starts, lambda i: _xor(F.slice(t, F.lit(1), i * BLOCK)))
        return bind(terms, lambda t: F.struct(t.alias("terms"), upto(t).alias("upto"), _xor(t).alias("all")))

    def before(s: Column, j: Column) -> Column:
        """The XOR of the first j terms."""
        whole = F.floor(j / BLOCK).cast("int")
        return F.get(s["upto"], whole).bitwiseXOR(_xor(F.slice(s["terms"], whole * BLOCK + 1, j % BLOCK)))

    def hashes(seed: int) -> Column:
        """The line's hash, then one for each touched word: the hash without it."""
        return bind(
            F.struct(scanned(placed(seed, 0)).alias("here"), scanned(placed(seed, 1)).alias("ahead")),
            lambda s: F.concat(
                F.array(s["here"]["all"]),
                F.transform(touched, lambda j: before(s["here"], j).bitwiseXOR(before(s["ahead"], j + 1)).bitwiseXOR(s["ahead"]["all"])),
            ),
        )

    def key(n: Column, j: Column, v: Column, short: bool) -> Column:
        return F.struct(F.xxhash64(n, j, v["v1"]).alias("variant"), F.xxhash64(F.lit(7), n, j, v["v2"]).alias("proof"), F.lit(short).alias("shortened"))

    places = F.concat(F.array(F.lit(-1)), touched)
    cut = F.zip_with(F.zip_with(hashes(1), hashes(2), lambda x, y: F.struct(x.alias("v1"), y.alias("v2"))), places, lambda v, j: F.struct(v["v1"].alias("v1"), v["v2"].alias("v2"), j.alias("j")))
    variants = F.flatten(F.transform(cut, lambda v: F.when(v["j"] < 0, F.array(key(n, v["j"], v, False))).otherwise(
        F.array(key(n, v["j"], v, False), key(n - 1, F.lit(-1), v, True))
    )))
    return lines.select("doc", "pos", "a", "b", F.inline(variants))


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one insertion, deletion or replacement apart."""
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    unequal = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    backwards = F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: ~x.eqNullSafe(y))

    def run(flags: Column) -> Column:
        at = F.array_position(flags, True)
        return F.when(at > 0, at - 1).otherwise(F.size(flags).cast("long"))

    return (long - short <= 1) & (
        F.least(run(unequal), short.cast("long")) + F.least(run(backwards), short.cast("long")) >= long - 1
    )


def near_duplicates(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b) of the lines with an earlier line within one edit (and another wording).

    Of a group of lines with a variant in common only the earliest is compared with the others:
    lines with one word replaced at the same place are all within one edit of each other, and a
    line lacking a word is within one edit of all lines that have it. So no group is paired out.
    """
    texts = written(_candidate_texts(docs, distinct))
    variants = _neighbourhood(texts)
    line = F.struct("doc", "pos", "a", "b")
    heads = variants.groupBy("variant", "proof").agg(
        F.count(F.lit(1)).alias("lines"),
        F.min(F.when(~F.col("shortened"), line)).alias("plain"),
        F.min(F.when(F.col("shortened"), line)).alias("short"),
    ).where("lines > 1").drop("lines")
    # A shortened line answers to the plain one; a plain line to the earliest plain or shortened one.
    rival = F.when(F.col("shortened"), F.col("plain")).otherwise(F.least("plain", "short"))
    pairs = written(
        variants.join(written(heads), ["variant", "proof"]).withColumn("rival", rival)
        .where((F.struct("doc", "pos") > F.struct("rival.doc", "rival.pos")) & ((F.col("a") != F.col("rival.a")) | (F.col("b") != F.col("rival.b"))))
        .select("a", "b", F.col("rival.a").alias("a2"), F.col("rival.b").alias("b2")).distinct()
    )
    return (
        pairs.join(texts.select("a", "b", F.col("words").alias("words_a")), ["a", "b"])
        .join(texts.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("words").alias("words_b")), ["a2", "b2"])
        .where(_within_one_edit(F.col("words_a"), F.col("words_b")))
        .select("a", "b").distinct()
    )


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc, text_key and the array drops of line numbers that go, for the documents that lose lines."""
    lines = written(line_table(docs))
    distinct = written(distinct_lines(lines))
    near = written(near_duplicates(docs, distinct))
    # Only lines that occur again or are near an earlier one matter to any document.
    marked = written(
        distinct.select("a", "b", "first", "times").join(near.withColumn("near", F.lit(True)), ["a", "b"], "left")
        .where((F.col("times") > 1) | F.col("near"))
        .select("a", "b", "first", F.coalesce("near", F.lit(False)).alias("near"))
    )
    here = F.struct("doc", "pos")
    return (
        lines.select("doc", "text_key", "pos", "a", "b").join(marked, ["a", "b"])
        .where(F.col("near") | ~here.eqNullSafe(F.col("first")))
        .groupBy("doc", "text_key").agg(F.collect_set("pos").alias("drops"))
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without the lines that repeat an earlier line of the corpus, up to one edited word.

    Lines are in order of (doc_id, place in the text); equal means equal words after lower-casing.
    Lines of at least MIN_EDIT_WORDS words also go if an earlier line is one word edit away. Lines
    without words stay. Adds n_lines and n_dropped, under free names if those are taken. A null text
    stays null with no lines; rows repeated whole (same doc_id and text) count as one document and
    get equal results; a null doc_id sorts first; an empty table stays empty; other columns are
    carried along. A text all of whose lines go becomes empty.
    """
    text_key, drops, doc, lost_key = (free_name(docs, stem) for stem in ("text_key", "drops", "doc", "lost_key"))
    lost = written(dropped_lines(docs.select("doc_id", "text"))).select(
        F.col("doc").alias(doc), F.col("text_key").alias(lost_key), F.col("drops").alias(drops)
    )
    joined = docs.withColumn(text_key, _text_key(F.col("text"))).join(
        lost.hint("merge"), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(text_key) == F.col(lost_key)), "left"
    )
    lines = F.split(F.col("text"), "\n")
    last = F.size(lines) - 1
    kept = F.array_except(F.sequence(F.lit(0), last), F.col(drops))
    rest = F.element_at(
        F.transform(F.array(lines), lambda a: F.array_join(F.transform(kept, lambda i: F.get(a, i)), "\n")), 1
    )
    return joined.select(
        *[F.when(F.col(drops).isNull(), F.col("text")).otherwise(rest).alias("text") if c == "text" else docs[c] for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(own_name(docs, "n_lines")),
        F.coalesce(F.size(F.col(drops)), F.lit(0)).cast("long").alias(own_name(docs, "n_dropped")),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, those dropped, and a digest of what dedup_lines() keeps.

    Null texts have no lines and the digest of an empty text; empty texts have one line without a
    word, which stays; rows repeated whole are one document; no rows give none.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"),
    )
