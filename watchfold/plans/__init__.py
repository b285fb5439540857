"""Whole pipelines and their command line."""
