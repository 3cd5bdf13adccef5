"""Operators on DataFrames: sectioning, chunking, indexing, retrieval, layout, results, library, estimates."""
