"""Operators for preparing language-model training data; nothing else here imports them."""
