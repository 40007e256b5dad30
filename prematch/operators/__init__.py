"""Operators on DataFrames: links, history, ratings, evaluation."""
