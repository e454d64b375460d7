"""Matching, conflict and review operators over DataFrames."""
