"""Operators for preparing training text: deduplication, filters, extraction, privacy, quality, search, tokens."""
