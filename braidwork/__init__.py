"""Braidwork: sequence and structure comparison on Spark DataFrames."""
