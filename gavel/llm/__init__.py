"""Operators for training-data pipelines: one module per operator, queries in ``queries``.

Nothing outside this folder (but the guarded part of ``__spark_entry__`` and ``corpus_pipeline``)
imports it.
"""
