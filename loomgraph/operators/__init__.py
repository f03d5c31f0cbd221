"""Graph, join and resolution operators over DataFrames."""
