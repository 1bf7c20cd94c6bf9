"""Scalar column expressions: reading log fields, writing report texts."""
