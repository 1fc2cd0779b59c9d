"""Operators of a training-data pipeline: packing, similarity joins, toxicity,
quality rules, token files, mixing, token counts, personal data, embedding
near-duplicates and main-text extraction.  Nothing outside this package (and
``corpus_pipeline.py``) imports it."""
