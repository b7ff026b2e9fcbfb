"""Column functions: nulls and division, calendar, text."""
