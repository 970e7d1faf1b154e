"""Operators of a training-data pipeline: quality, languages, duplicates, contamination, licences, tokens, personal data."""
