"""Operators over trials, tokens and timelines."""
