"""Training-data operators: dedup, archives, scoring, mixing, search and packing.

Nothing outside this subpackage imports it.
"""
