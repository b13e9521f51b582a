"""Training-data operators: tokens, filters, language models, near-duplicates, packing."""
