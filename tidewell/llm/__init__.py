"""Operators for training data: tokenizing, packing, percentiles of huge columns, offensive content."""
