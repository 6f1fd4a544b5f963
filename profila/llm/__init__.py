"""Operators for preparing training text: cleaning, deduplication, search, mixing and packing."""
