"""Code-corpus review analytics as Spark jobs.

Everything here is a function from DataFrames to DataFrames; sessions are
always the caller's.  See README.md for the layout.
"""
