"""Training-data operators: scans, near-duplicate joins, search, language ID, counts, mixing.

Nothing outside this subpackage imports it.
"""
