"""Training-data operators: extraction, deduplication, filtering, formatting and encoding of large text corpora."""
