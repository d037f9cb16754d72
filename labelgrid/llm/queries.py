"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive, bpe, byte_cnn, exact_dedup, fill_middle, line_dedup, media, oracle, packing, pii, prefix_trie, quality_rules, sharding, simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        sharding.op1_hash_tree_sharding,
        simhash.op2_trie_simhash,
        quality_rules.op3_quality_cascade,
        line_dedup.op4_line_dedup,
        byte_cnn.op5_byte_cnn_quality,
        packing.op6_online_packing,
        pii.op7_bilstm_crf_pii,
        media.op8_interleaved_media,
        archive.op9_content_archive,
        bpe.op10_prefix_dp_bpe,
        fill_middle.op11_fill_in_middle,
        prefix_trie.op12_prefix_trie,
        exact_dedup.op13_exact_dedup,
    ]
    return {f.__name__: f for f in found} | {"pipeline": _pipeline}


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
