"""Training-data operators: dedup, quality, safety, tokens, search, packing, joins and language."""
