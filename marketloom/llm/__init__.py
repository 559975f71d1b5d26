"""Training-data operators: decontamination, extraction, tokenisation, near duplicates, scans, models and search."""
