"""Training-data operators: filtering, deduplication, privacy and tokenisation over text tables."""
