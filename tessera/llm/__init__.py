"""Training-data operators: token counts, LM scoring, decontamination, quality, dedup, encoding."""
