"""Queries on the sample tables and their SQL counterparts."""
