"""Training-data operators: filters, mixing, scoring, search, archives, tagging, near-duplicates, encoding."""
