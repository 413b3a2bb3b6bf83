"""Finds and redacts sensitive data in text, tables and markup, on Spark DataFrames."""
