"""Training-data operators: deduplication, formatting, encoding, archives, scans and filters."""
