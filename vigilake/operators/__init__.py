"""Table-to-table operators: DataFrames in, DataFrame out."""
