"""Scalar functions: normalising, parsing, formatting and similarity of address text."""
