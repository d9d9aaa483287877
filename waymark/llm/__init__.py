"""Training-data operators: quality, near-duplicates, packing, fingerprints, search, scoring, mixing, WARC, sharding, substrings.

Nothing else in the package imports this subpackage.
"""
