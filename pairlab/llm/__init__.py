"""Operators for training-data pipelines; nothing else in pairlab imports this subpackage."""
