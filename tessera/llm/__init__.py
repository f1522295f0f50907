"""Training-data operators: sharding, WARC, packing, deduplication, search, privacy,
toxicity, token stores and decontamination.

Nothing else in :mod:`tessera` imports this subpackage.
"""
