"""Training-data operators: dedup, filters, extraction, tokenization, mixing and vector search."""
