"""Operators for preparing training corpora: sharding, search, deduplication, scoring, encoding.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
