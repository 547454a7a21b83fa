"""Operators on change-history tables: DataFrame in, DataFrame out."""
