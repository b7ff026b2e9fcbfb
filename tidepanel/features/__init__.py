"""Feature families and their builder."""
