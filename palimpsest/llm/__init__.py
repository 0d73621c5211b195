"""Operators for preparing training data from the store and its scanned pages."""
