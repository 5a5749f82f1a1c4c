"""Queries over the driver tables, each with equivalent SQL where SQL can express it."""
