"""Spark jobs over labelled image, feature and prediction tables."""
