"""Spark operators for radio-frequency survey analytics.

Every operator is a function from DataFrames to a DataFrame; nothing runs until
the caller asks for rows, except where a docstring names a driver loop.
"""
