"""Compositions of operators: features, datasets, splits, models, reports."""
