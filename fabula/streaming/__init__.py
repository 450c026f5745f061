"""Utterances and caches over event streams."""
