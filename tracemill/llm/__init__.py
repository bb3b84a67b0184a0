"""Operators of a training-data pipeline: deduplication, scoring, extraction, formatting, tokenizing."""
