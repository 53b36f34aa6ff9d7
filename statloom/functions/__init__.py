"""Shared building blocks: missing values, ordered totals, moments, tail probabilities."""
