"""Streams of images: scoring is a map job, so it takes a streaming DataFrame unchanged."""
