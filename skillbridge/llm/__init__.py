"""Operators for preparing training text: filtering, deduplication, tokens, sharding, search."""
