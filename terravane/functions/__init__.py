"""Scalar expressions as SQL text that Spark and DuckDB both evaluate."""
