"""Training-data operators: quality, sharding, decontamination, secrets, duplicates, pages, language models, tokens."""
