"""Row windows, cross-sections, as-of joins, aggregates, selection."""
