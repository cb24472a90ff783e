"""Training-data operators: quality, scoring, formatting, scanning, deduplication, packing, archives.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.  Every
operator takes and returns DataFrames; module docstrings state the defined
result for nulls, empty texts, ties, repeated rows and empty tables.
"""
