"""Structured Streaming variants, an extension."""
