"""Set operators: DataFrames in, DataFrame out."""
