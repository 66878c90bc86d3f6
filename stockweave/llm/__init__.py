"""Training-data operators: deduplication, scanning, tokenising, packing, search.

Nothing outside this subpackage imports it.
"""
