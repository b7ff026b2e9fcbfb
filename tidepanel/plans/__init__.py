"""Named queries over the supplied tables."""
