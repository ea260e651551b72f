"""Readers of the notice tables and the views that carry printed values and geometry, in both SQL dialects."""
