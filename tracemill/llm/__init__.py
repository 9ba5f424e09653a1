"""Operators for preparing training data: search, scoring, deduplication, packing and tokenisation.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
