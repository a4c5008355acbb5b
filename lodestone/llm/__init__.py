"""Training-data operators: dedup, classifiers, tokenizers, search, packing, sharding, LM scoring."""
