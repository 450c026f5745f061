"""Fabula: analytics over narrative scripts, line tables and dialogs, on Spark."""
