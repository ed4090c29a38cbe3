"""Operators for large training-corpus pipelines; nothing outside this folder imports them."""
