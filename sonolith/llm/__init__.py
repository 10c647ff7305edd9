"""Training-data operators: scoring, deduplication, mixing, archives and token output.

Nothing outside this subpackage imports it.
"""
