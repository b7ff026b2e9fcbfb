"""Report tables and their text forms."""
