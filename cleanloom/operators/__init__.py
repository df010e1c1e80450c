"""Cleaning operators: DataFrame in, DataFrame out."""
