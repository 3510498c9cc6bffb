"""Operators of a training-data pipeline: cleaning, scoring, joining, packing and encoding.

Every operator takes DataFrames and column names, selects the columns it needs
first (further columns, whatever their names, never clash) and returns a new
DataFrame. Rows are never dropped unless dropping is the operator's decision.
"""
