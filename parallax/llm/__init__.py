"""Operators for preparing language-model training data. Nothing else in parallax imports this."""
