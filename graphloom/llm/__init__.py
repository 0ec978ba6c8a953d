"""Training-data operators: tokenising, near-duplicates, scans, filters, decontamination."""
