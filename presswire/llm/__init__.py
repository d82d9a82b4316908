"""Training-data operators: scans, filters, tokenizers, scoring and deduplication of documents."""
