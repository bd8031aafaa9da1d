"""Terrain sources."""
