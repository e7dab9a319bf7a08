"""Operators for training-data pipelines: filtering, deduplication, extraction, scoring and mixing.

Nothing outside this folder imports it; ``registry.py`` lists its queries.
"""
