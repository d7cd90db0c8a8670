"""Equity analytics on Spark DataFrames: every operator works on a table of tickers."""
