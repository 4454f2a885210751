"""Structured Streaming forms of per-channel operators."""
