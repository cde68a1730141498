"""Whole jobs: data preparation, training, scoring."""
