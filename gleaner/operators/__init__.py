"""Operators on DataFrames: paragraphs, rankings, fusion, retrieval, catalog, evaluation."""
