"""Property graphs of code-like symbols as Spark DataFrames."""
