"""Orrery: profiling, cleaning, sampling, splitting and auditing of annotated datasets on Spark DataFrames."""
