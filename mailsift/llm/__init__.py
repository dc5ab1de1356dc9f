"""Training-data operators: language, duplicates, quality, personal data, tokens, packing, scoring."""
