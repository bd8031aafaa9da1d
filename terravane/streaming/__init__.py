"""Batches of requests, from files or as a stream."""
