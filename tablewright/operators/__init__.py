"""Relational, testing, profiling, lineage and rating operators: DataFrames in, DataFrames out."""
