"""Operators on lines, legends and speakers."""
