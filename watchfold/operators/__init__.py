"""Operators: each takes DataFrames and returns one, without actions unless it says so."""
