"""Operators for training data made of texts and very large columns. Nothing outside imports this."""
