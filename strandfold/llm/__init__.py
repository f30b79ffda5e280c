"""Training-data operators: quality, near-duplicates, packing, toxicity, line dedup, decontamination, chat, shards, mixing, archives."""
