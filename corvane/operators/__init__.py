"""Retrieval, ranking, evaluation and ingestion operators on DataFrames."""
