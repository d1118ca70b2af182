"""Operators for training data: text extraction, cleaning, near-duplicates, linking, packing, leakage and personal data."""
