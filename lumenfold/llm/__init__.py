"""Training-data operators: deduplication, scoring, tokens, packing, sharding.

Nothing outside this folder imports it.
"""
