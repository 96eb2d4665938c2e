"""Coastal station time series on Spark: features, labels, folds, models, scores."""
