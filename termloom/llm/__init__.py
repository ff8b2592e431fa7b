"""Training-data operators: tokenisation, deduplication, filtering and scoring of text corpora."""
