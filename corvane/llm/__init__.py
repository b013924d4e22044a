"""Operators of a training-data pipeline, each a Spark job of its own.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` and the
queries in :mod:`corvane.llm.queries` build on it.
"""
