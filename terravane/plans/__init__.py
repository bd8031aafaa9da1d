"""Rendering of plans for an engine."""
