"""Operators over image, feature and prediction tables."""
