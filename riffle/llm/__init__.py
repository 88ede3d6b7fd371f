"""Operators for training-data pipelines: scoring, language, duplicates, rules, tokens, leaks, personal data."""
