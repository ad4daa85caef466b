"""Bibliographic metadata resolution jobs on Spark DataFrames."""
