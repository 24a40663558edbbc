"""Operators: DataFrame in, DataFrame out, rows never cut short."""
