"""Training-data operators: dedup, mixing, sharding, filters, search and archives.

Nothing outside this subpackage imports it.
"""
