"""Training-data operators: formatting, deduplication, extraction, packing, filters and language ID.

Nothing outside this subpackage imports it.
"""
