"""Operators for preparing training text: dedup, language, toxicity, quality, scoring, decontamination, packing."""
