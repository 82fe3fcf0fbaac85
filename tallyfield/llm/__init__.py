"""Training-data operators: deduplication, filtering, tokenising, packing and media over document tables.

Nothing outside this subpackage imports it.
"""
