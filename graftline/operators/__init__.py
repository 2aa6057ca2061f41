"""Operators over DataFrames that hold JSON text."""
