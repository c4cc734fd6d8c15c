"""Operators for building training corpora: deduplication, extraction, joins,
mixing, fingerprints, token files, vector search, quality, sharding, packing.

Nothing else in the library imports this subpackage.
"""
