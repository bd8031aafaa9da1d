"""Terrain operations: each function returns a plan (SQL text with macros)."""
