"""Crop-yield regression: features, split, training, evaluation and batch scoring."""
