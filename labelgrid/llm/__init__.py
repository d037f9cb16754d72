"""Training-data operators: sharding, deduplication, quality, PII, packing, media, archives, BPE.

Nothing outside this subpackage (and corpus_pipeline.py) imports it.
"""
