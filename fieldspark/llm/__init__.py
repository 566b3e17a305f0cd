"""Training-data operators: quality, deduplication, decontamination, mixing, encoding.

Nothing outside this subpackage imports it.
"""
