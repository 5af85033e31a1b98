"""Operators for preparing training text: filters, deduplication, mixing, counting, packing and formatting."""
