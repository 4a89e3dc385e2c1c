"""Corpus operators for training data: deduplication, filtering, decontamination, tokenising."""
