"""Operators in the order in which a manuscript runs through them."""
