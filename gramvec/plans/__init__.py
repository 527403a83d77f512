"""Composite plans: the registered query catalogue, preprocessing, training, inference."""
