"""Training-data operators: personal data, page extraction, mixing, toxicity, deduplication,
decontamination, token counts and license scans. Nothing outside this folder imports it."""
