"""Whole pipelines built from sources, functions and operators."""
