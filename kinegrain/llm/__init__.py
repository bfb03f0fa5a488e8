"""Operators for corpora of texts and for splits and statistics of training data. Nothing outside imports this package."""
