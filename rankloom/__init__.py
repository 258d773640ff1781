"""Relevance search and retrieval evaluation as Spark jobs."""
