"""Operators for large training-corpus preparation (packing, dedup, filters, mixing, token stores)."""
