"""Operators for preparing training text, each with the query that applies it to a whole table."""
