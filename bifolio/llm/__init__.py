"""Operators of a large training-data pipeline.

Nothing outside this folder and ``corpus_pipeline.py`` imports it; the folder
can be deleted and the rest of the library still works.
"""
