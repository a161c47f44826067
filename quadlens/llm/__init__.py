"""Operators for large-scale training-text pipelines; nothing outside this subpackage imports it."""
