"""Preparing text for training: deduplication, filtering, language, mixing, tokens, scoring."""
