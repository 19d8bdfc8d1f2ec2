"""Fixtures, composed jobs and the catalogue of queries."""
