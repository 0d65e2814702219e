"""Training-data operators: extraction, language, deduplication, decontamination, formatting, packing."""
