"""Splits, scores and learners."""
