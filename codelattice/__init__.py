"""Code-graph and training-corpus analytics, expressed on Spark DataFrames."""
