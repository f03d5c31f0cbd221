"""Code and repository knowledge graphs as Spark DataFrames."""
