"""Streams of a model's steps."""
