"""Operators for training-data pipelines: extraction, filtering, deduplication, tokens, scores and media.

Nothing outside this subpackage imports it."""
