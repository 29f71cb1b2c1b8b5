"""Longitudinal text-corpus analytics on Spark DataFrames.

Operators are functions from DataFrames to DataFrames.  The caller owns the
session; nothing in the package creates one outside the command line.
"""
