"""Training-data operators: quality, packing, scoring, near-dedup, language, mixing, toxicity, media, token store."""
