"""From raw documents to packed training sequences.

STAGES are (name, function) in order; each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the last return
the columns of documents. run() applies them to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrid.llm import line_dedup, packing, pii, quality_rules, simhash
from labelgrid.llm.common import WHITE_CLASS, table, written


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """out with docs' columns alone, and n_chars, where there is one, made of the new text."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out.select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null, empty and short texts go; repeated rows go or stay together; no rows give none; columns of
    any other name are carried along.
    """
    return quality_rules.quality_filter(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur earlier in the corpus; those left without a word go.

    So null and empty texts go. Rows repeated whole are one document and stay together; a null doc_id
    comes first; no rows give none; columns of any other name are carried along.
    """
    out = line_dedup.dedup_lines(docs).where(F.col("text").rlike(WHITE_CLASS.replace("[", "[^")))
    return _like(docs, out)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group linked by similarity 0.8 or more of 5-word shingles.

    Texts without words are one group; rows without a doc_id, and rows that repeat the one that is kept,
    stay; no rows give none; columns of any other name are carried along.
    """
    return simhash.drop_similar(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the names of its kinds.

    Null texts stay null; repeated rows give equal rows; no rows give none; columns of any other name
    are carried along.
    """
    return _like(docs, pii.redact_personal_data(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences, with their token ids.

    Null and empty texts are an end mark alone; repeated rows are packed one by one; no rows give none;
    other columns end here.
    """
    return packing.pack_documents(docs, "doc_id", "text", keep_ids=True)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("personal data", redact),
    ("packing", pack),
]

#: Fingerprints, the tagger and the tokenizer have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
