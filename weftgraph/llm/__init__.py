"""Operators of a large-scale training-data pipeline.

Self-contained: nothing outside this folder imports it, apart from the guarded
registration in ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
