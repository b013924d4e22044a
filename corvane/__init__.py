"""Retrieval analytics on Spark: scoped search, fusion, packing, evaluation and governance as DataFrame jobs."""
