"""Operators for preparing training data: private data, near duplicates, languages, shards, tokens, packing, quality."""
