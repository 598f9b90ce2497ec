"""Operators for preparing training data: search, scoring, filtering, mixing and tokens."""
