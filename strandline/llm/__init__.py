"""Training-data operators: quality, deduplication, packing, token counts, privacy, sharding.

Nothing else in the library imports this subpackage.
"""
