"""Operators on tables of addresses and queries: DataFrame in, DataFrame out."""
