"""Compositions of operators: layers, models with given weights, objectives, metrics and training."""
