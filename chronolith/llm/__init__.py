"""Operators for training-data pipelines: language, quality, toxicity, duplicates, leaks, licences, personal data, mixing."""
